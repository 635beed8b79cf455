"""The engine over DataFrames: codec, providers, failed rows, streaming."""

import base64
import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymill import model as m
from waymill import queries
from waymill.functions import kernels as k
from waymill.plans import engine
from waymill.plans import track as one
from waymill.plans.roads import AnalyticRoads, HttpRoads, Route, TableRoads
from waymill.sources import codec
from waymill.streaming import tasks

SF = "/root/testdata/sf0.001"


def wire(items) -> str:
    return base64.b64encode(zlib.compress(json.dumps(items).encode())).decode()


def drive(n, step_s=30, lon0=37.0, dlon=0.005, t0=1_700_000_000):
    return [((t0 + i * step_s) * 1_000_000, 0, lon0 + i * dlon, 55.0 + 0.001 * (i % 3)) for i in range(n)]


def frame(spark, tracks: dict, snap=5.0):
    rows = [(name, i, t, off, lon, lat, None if snap is None else float(snap)) for name, pts in tracks.items() for i, (t, off, lon, lat) in enumerate(pts)]
    return spark.createDataFrame(rows, "track_id string, seq int, t_us long, tz_off_s int, lon double, lat double, snap_m double")


# ---------------------------------------------------------------- codec


def test_codec_round_trip_and_zones():
    points = [(1_700_000_000_000_000, 10_800, 37.6, 55.7), (1_700_000_060_500_000, -12_600, -180.0, -90.0), (0, 0, 180.0, 90.0)]
    back = codec.decode(codec.encode(points))
    assert back == [(t // 1_000_000 * 1_000_000, o, x, y) for t, o, x, y in points]
    assert codec.parse_time("2024-01-02T03:04:05.123456789+03:00") == (1_704_153_845_123_456, 10_800)


@pytest.mark.parametrize(
    "route, kind",
    [
        ("?", "invalid"), (base64.b64encode(b"no zlib").decode(), "invalid"), (base64.b64encode(zlib.compress(b"[]")[:-3]).decode(), "invalid"), (wire({}), "invalid"), (wire([1]), "invalid"),
        (wire([{"t": "2024-01-01", "pos": {"x": 1, "y": 1}}]), "invalid"), (wire([{"pos": {"x": 1, "y": 1}}]), "invalid"), (wire([{"t": "2024-01-01T00:00:00Z", "pos": {"x": 181, "y": 1}}]), "invalid"),
        (wire([{"t": "2024-01-01T00:00:00Z", "pos": {"x": float("nan"), "y": 1}}]), "invalid"), (base64.b64encode(zlib.compress(b"[] x")).decode(), "invalid"), (base64.b64encode(zlib.compress(b"[")).decode(), "invalid"),
        (wire([{"t": "2024-01-01T00:00:00Z", "pos": {}}] * 4), "too_many"), (base64.b64encode(zlib.compress(b"[" + b" " * 5000 + b"]")).decode(), "too_large"),
    ],
)
def test_codec_errors(route, kind):
    with pytest.raises(codec.CodecError) as e:
        codec.decode(route, 4000, 3)
    assert e.value.kind == kind


def test_codec_leniency():
    assert codec.decode(wire([{"t": "2024-01-01T00:00:00Z", "more": 1}])) == [(1_704_067_200_000_000, 0, 0.0, 0.0)]
    assert codec.decode(base64.b64encode(zlib.compress(b" [ ] \n")).decode()) == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_codec_never_panics(data):
    for text in (data.decode("latin-1"), base64.b64encode(data).decode(), base64.b64encode(zlib.compress(data)).decode()):
        try:
            codec.decode(text)
        except codec.CodecError:
            pass


def test_clamped_errors_stay_text():
    assert codec.clamp_error("é" * 1000) == "é" * 512 and len(codec.clamp_error("x" * 5000)) == 1024


# ---------------------------------------------------------------- one track


def test_core_drops_a_forged_excursion():
    pts = drive(60)
    for i in range(30, 34):
        pts[i] = (pts[i][0], 0, 40.0, 58.0)
    p = k.Track(*(np.array(c) for c in zip(*[(t, x, y) for t, _, x, y in pts])))
    r = one.resolve(p, AnalyticRoads(), m.EngineConfig(), np.full(60, 5.0))
    assert not set(range(30, 34)) & set(r["own"].tolist()) and r["length_after_m"] < 60_000 < 500_000 < r["length_before_m"]
    assert r["gaps"] >= r["filled"] > 0 and r["added_points"] == r["synthetic"].sum() == (r["own"] < 0).sum() > 0
    assert [x["name"] for x in r["stages"]] == list(m.STAGES)


def test_snap_guard_and_small_tracks():
    p = k.Track(*(np.array(c) for c in zip(*[(t, x, y) for t, _, x, y in drive(20)])))
    snap = np.full(20, 5.0)
    snap[:2] = np.nan
    one.resolve(p, AnalyticRoads(), m.EngineConfig(), snap)
    snap[:3] = np.nan
    with pytest.raises(one.Rejected, match="85%"):
        one.resolve(p, AnalyticRoads(), m.EngineConfig(), snap)
    with pytest.raises(one.Rejected, match="too few"):
        one.resolve(p.take([0]), AnalyticRoads(), m.EngineConfig(), snap[:1])
    with pytest.raises(one.Rejected, match="too many"):
        one.resolve(p, AnalyticRoads(), m.EngineConfig(max_points=19), snap)
    none = one.resolve(p, None, m.EngineConfig())
    assert none["degraded"] and none["warnings"] == [one.NO_ENGINE, one.NO_ROUTES] and none["guarded"] == 0


def test_fill_verdicts_and_snapped_ends():
    assert one.verdict(None, 1000, 60) == "no route"
    assert one.verdict(Route(1300, []), 1000, 1) == "accepted" and one.verdict(Route(1300.1, []), 1000, 1) == "physics"
    assert one.verdict(Route(3000, []), 1000, 120) == "accepted" and one.verdict(Route(3000.1, []), 1000, 1e6) == "detour"

    class Roads:
        def route(self, p, i, j):
            return Route(1100, [(p.lon[i], 55.0), (p.lon[i] + 0.005, 55.002), (p.lon[j], 55.0)], (p.lon[i] + 1e-4, 55.0), (p.lon[j] - 1e-4, 55.0))

    p = k.Track(np.array([0, 60, 120]) * k.US, [37.0, 37.016, 37.032], [55.0, 55.0, 55.0])
    out, drawn, source, report = one.fill(p, Roads(), np.array([True, False, False]))
    assert source.tolist() == [0, -1, 1, -1, 2] and drawn.tolist() == [False, True, False, True, False]
    assert out.lon[0] == 37.0 and out.lon[2] == pytest.approx(37.016 + 1e-4) and out.lon[4] == pytest.approx(37.032 - 1e-4)
    assert report.filled == 2 and (np.diff(out.t) > 0).all()


# ---------------------------------------------------------------- tables of tracks


def test_resolve_isolates_bad_tracks(spark):
    df = frame(spark, {"ok": drive(30), "one": drive(1), "big": drive(60)})
    rows = {r.track_id: r for r in engine.resolve(df, AnalyticRoads(), m.EngineConfig(max_points=40)).collect()}
    assert rows["ok"].status == "done" and rows["one"].error == "too few points after processing" and rows["big"].error == "too many points"

    class Broken(AnalyticRoads):
        def pairs(self, p, wanted):
            raise RuntimeError("router fell over")

        snap = pairs

    failed = engine.resolve(df, Broken(), m.EngineConfig()).where("track_id = 'ok'").first()
    assert failed.status == "failed" and "router fell over" in failed.error
    assert engine.resolve(df.limit(0), AnalyticRoads()).count() == 0


def test_order_of_rows_and_partitions_does_not_matter(spark):
    df = frame(spark, {str(i): drive(25, lon0=37 + i) for i in range(6)})
    a = engine.points_of(engine.resolve(df, AnalyticRoads())).orderBy("track_id", "seq").collect()
    b = engine.points_of(engine.resolve(df.orderBy("lat").repartition(3), AnalyticRoads())).orderBy("track_id", "seq").collect()
    assert a == b and len(a)


def test_one_shuffle_per_resolve(spark):
    plan = engine.resolve(frame(spark, {"a": drive(9)}), AnalyticRoads()).where("status = 'done'")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    single = plan.split("FlatMapGroupsInArrow")[1].split("HashAggregate")[0]
    assert single.count("Exchange hashpartitioning(track_id") == 1


def test_tables_give_what_the_function_gives(spark, tmp_path):
    pts = drive(40)
    for i in range(12, 15):
        pts[i] = (pts[i][0], 0, 38.5, 56.0)
    df = frame(spark, {"x": pts, "y": drive(20, lon0=30.0)})
    kept = [0]

    def keep(d):
        kept[0] += 1
        path = str(tmp_path / f"r{kept[0]}")
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    roads, asked = AnalyticRoads(), {"pair": {}, "route": {}}

    class Noting(AnalyticRoads):
        def pairs(self, p, wanted):
            out = super().pairs(p, wanted)
            asked["pair"] |= {(p.lon[i], p.lat[i], p.lon[j], p.lat[j]): d for (i, j), d in zip(wanted, out)}
            return out

        def route(self, p, i, j):
            r = super().route(p, i, j)
            asked["route"][(p.lon[i], p.lat[i], p.lon[j], p.lat[j])] = r
            return r

    for name, points in (("x", pts), ("y", drive(20, lon0=30.0))):
        one.resolve(k.Track(*(np.array(c) for c in zip(*[(t, x, y) for t, _, x, y in points]))), Noting(), m.EngineConfig(), np.full(len(points), 5.0))
    ends = "a_lon double, a_lat double, b_lon double, b_lat double"
    pairs = spark.createDataFrame([tuple(map(float, (*key, d))) for key, d in asked["pair"].items()], ends + ", dist_m double")
    routes = spark.createDataFrame([(*map(float, key), None, float(r.distance), [(float(a), float(b)) for a, b in r.coords]) for key, r in asked["route"].items()], ends + ", bearing int, distance double, coords array<struct<lon:double,lat:double>>")
    want = {r.track_id: (r.points_after, round(r.length_after_m, 1)) for r in engine.resolve(df, roads).collect()}
    got = engine.resolve_with_tables(df, keep, pairs=pairs, routes=routes).collect()
    assert {r.track_id: (r.points_after, round(r.length_after_m, 1)) for r in got} == want and kept[0] < 60
    # a table without answers leaves every gap straight
    alone = engine.resolve_with_tables(df, keep).collect()
    assert all(set(r.reasons or {}) <= {"no route"} and r.road_banned == 0 for r in alone)


def test_hinted_routes_and_shorter_direction():
    p = k.Track([0, k.US], [37.0, 37.01], [55.0, 55.0])
    line = p.to(0, 1)
    found = [{"hint": h, "distance": d, "coords": [], "snap_a": None, "snap_b": None} for h, d in ((False, line * 2), (True, line * 1.5))]
    key = "37.00000,55.00000;37.01000,55.00000"
    assert engine._route_of(found, key).distance == pytest.approx(line * 1.5)
    assert engine._route_of([{**found[0], "distance": line * 1.2}, found[1]], key).distance == pytest.approx(line * 1.2)
    assert engine._route_of(None, key) is None
    assert TableRoads(distances={key: None}).pairs(p, [(0, 1)]) == [None]


# ---------------------------------------------------------------- live router and callback


class _Server(BaseHTTPRequestHandler):
    table, seen = True, []

    def do_GET(self):
        self.seen.append(self.path)
        nodes = [tuple(map(float, x.split(","))) for x in self.path.split("/driving/")[1].split("?")[0].split(";")]
        if "/table/" in self.path:
            if not self.table:
                return self._send(404, {})
            n = len(nodes)
            return self._send(200, {"distances": [[k.hav1(*a, *b) * (1.5 if i < n // 2 else 1.4) for b in nodes] for i, a in enumerate(nodes)]})
        if len(nodes) > 6:
            return self._send(414, {})
        coords = [list(x) for x in nodes]
        self._send(200, {"routes": [{"distance": k.hav1(*nodes[0], *nodes[-1]) * (1.2 if "bearings" in self.path else 1.5), "geometry": {"coordinates": coords}}], "waypoints": [{"distance": 3.0, "location": c} for c in coords]})

    def do_POST(self):
        self.seen.append(self.path + self.rfile.read(int(self.headers["Content-Length"])).decode())
        code = 500 if self.path.endswith("/flaky") and sum("/flaky" in s for s in self.seen) < 3 else 404 if self.path.endswith("/gone") else 200
        self._send(code, {})

    def _send(self, code, body):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture()
def server():
    _Server.table, _Server.seen = True, []
    s = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_roads(server):
    p = k.Track(np.arange(20) * k.US, 37 + np.arange(20) * 0.01, np.full(20, 55.0))
    roads = HttpRoads(server, retries=0, parallel=2)
    assert (roads.snap(p, None) == 3.0).all()
    assert roads.pairs(p, [(0, 1), (3, 9)]) == pytest.approx([p.to(0, 1) * 1.4, p.to(3, 9) * 1.4], rel=1e-3)
    _Server.table = False
    assert roads.pairs(p, [(0, 1)]) == pytest.approx([p.to(0, 1) * 1.5], rel=1e-3)
    assert roads.route(p, 0, 5).distance == pytest.approx(p.to(0, 5) * 1.2, rel=1e-3)
    dead = HttpRoads("http://127.0.0.1:9", retries=0, timeout_s=0.2)
    assert np.isnan(dead.snap(p, None)).all() and dead.pairs(p, [(0, 1)]) == [None] and dead.route(p, 0, 1) is None


def test_ping_tells_whether_routes_are_built(server):
    assert HttpRoads(server, retries=0).ping()
    assert not HttpRoads("http://127.0.0.1:9", retries=0, timeout_s=0.2).ping()


def test_settings_of_router_and_callback():
    found = m.EngineConfig.load({"WAYMILL_ROUTER_URL": "http://r", "WAYMILL_ROUTER_REQUESTS": "4", "WAYMILL_ROUTER_TIMEOUT_S": "x", "WAYMILL_CALLBACK_URL": "http://c/{taskKey}"})
    roads, provider = tasks.roads_of(found), tasks.provider_of(found)
    assert (roads.url, roads.parallel, roads.timeout_s) == ("http://r", 4, 30.0) and (provider.url, provider.requests) == ("http://r", 4)
    assert tasks.callback_of(found).url == "http://c/{taskKey}" and tasks.roads_of(m.EngineConfig()) is None and tasks.provider_of(m.EngineConfig()) is None


def test_the_stage_that_failed_says_why(spark):
    """Half of the snaps are missing: the core refuses the track."""
    points = frame(spark, {"bad": drive(30), "good": drive(30)}).withColumn("snap_m", F.when((F.col("track_id") == "good") | (F.col("seq") % 2 == 0), F.col("snap_m")))
    rows = engine.stage_stats(engine.resolve(points, AnalyticRoads())).orderBy("track_id", "at").collect()
    bad = [(r.stage, r.points_after, r.error) for r in rows if r.track_id == "bad"]
    assert [x[0] for x in bad] == ["sort_by_time", "core"] and bad[1][1] == 0 and "snaps are known for 50%" in bad[1][2]
    assert all(r.error is None for r in rows if r.track_id == "good")


def test_submit_returns_its_own_keys(spark, tmp_path):
    queue = str(tmp_path / "queue")
    kind = "task_key string, route_compressed string"
    first = {r.task_key for r in tasks.submit(spark.createDataFrame([("a", "x"), (None, "y")], kind), queue).collect()}
    again = {r.task_key for r in tasks.submit(spark.createDataFrame([("a", "x"), ("b", "z")], kind), queue).collect()}
    assert "a" in first and len(first) == 2 and again == {"a", "b"}
    assert spark.read.parquet(queue).count() == 4


def test_callback(server):
    call = lambda path: tasks.Callback(server + path, pause_s=0.01).send("k1", "done")
    assert call("/ok/{taskKey}") and call("/flaky") and not call("/gone") and not tasks.Callback("").send("k", "done")
    assert sum("/flaky" in s for s in _Server.seen) == 3 and sum("/gone" in s for s in _Server.seen) == 1 and any("/ok/k1" in s for s in _Server.seen)


# ---------------------------------------------------------------- streaming


def test_stream_end_to_end(spark, tmp_path):
    queue, results, check = (str(tmp_path / x) for x in ("queue", "results", "check"))
    config = m.EngineConfig(max_attempts=2)
    routes = [("good", codec.encode(drive(30))), ("bad", "?"), ("empty", codec.encode([])), ("none", None)]
    keys = tasks.submit(spark.createDataFrame(routes, "task_key string, route_compressed string"), queue)
    assert {r.task_key for r in keys.collect()} == {"good", "bad", "empty", "none"}
    assert tasks.status(spark, queue, results, "good")["status"] == "pending" and tasks.status(spark, queue, results, "who") is None
    told = []
    notify = lambda df: told.extend(map(tuple, df.select("task_key", "status").collect()))

    class Snapped(AnalyticRoads):
        def snap(self, p, snap_m):
            return np.full(len(p), 5.0)

    q = tasks.start(spark, queue, results, check, Snapped(), config, notify, once=True)
    q.awaitTermination()
    cards = {r.task_key: r for r in tasks.cards(spark, results).collect()}
    assert {x: c.status for x, c in cards.items()} == {"good": "done", "bad": "failed", "empty": "failed", "none": "failed"} and sorted(told) == sorted((x, c.status) for x, c in cards.items())
    assert cards["good"].length_m > 5000 and len(codec.decode(cards["good"].route_compressed)) == cards["good"].points_after and cards["bad"].error_kind == "invalid"
    # a finished task that comes again is skipped, a repeated batch overwrites its own cards
    tasks.submit(spark.createDataFrame([("good", "?"), (None, codec.encode(drive(20)))], "task_key string, route_compressed string"), queue)
    tasks.start(spark, queue, results, check, Snapped(), config, None, once=True).awaitTermination()
    after = {r.task_key: r for r in tasks.cards(spark, results).collect()}
    assert len(after) == 5 and after["good"].status == "done"
    process = tasks.processor(results, Snapped(), config)
    for _ in range(2):
        process(spark.createDataFrame([("late", codec.encode(drive(20)), 0)], "task_key string, route_compressed string, attempt int"), 7)
    assert spark.read.parquet(f"{results}/batch=7").count() == 1
    # what nobody finished comes back once, then fails
    tasks.submit(spark.createDataFrame([("lost", "?")], "task_key string, route_compressed string"), queue)
    assert tasks.reclaim(spark, queue, results, 3600, config) == (0, 0)
    assert tasks.reclaim(spark, queue, results, 0, config) == (1, 0) and tasks.reclaim(spark, queue, results, 0, config) == (0, 1)
    assert tasks.status(spark, queue, results, "lost")["error_kind"] == "poisoned"
    assert tasks.trim(spark, queue, results) > 0 and spark.read.schema(tasks.QUEUE).parquet(queue).count() == 0
    assert tasks.cards(spark, results).count() == 7


def test_cards_are_made_in_one_pass(spark):
    routes = [("a", codec.encode([(1_700_000_000_000_000 + i * k.US, 3600, 37 + i * 0.001, 55.0) for i in range(30)])), ("bad", "?"), ("none", codec.encode([])), ("one", codec.encode([(0, 0, 37.0, 55.0)])), ("null", None)]
    made = tasks.solve(spark.createDataFrame(routes, "task_key string, route_compressed string"))
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("FlatMapGroupsInArrow") == 1
    got = {r.task_key: r for r in made.collect()}
    assert {key: (r.status, r.error_kind) for key, r in got.items()} == {"a": ("done", None), "bad": ("failed", "invalid"), "none": ("failed", "too_few"), "one": ("failed", "unprocessable"), "null": ("failed", "invalid")}
    kept = codec.decode(got["a"].route_compressed)
    assert len(kept) == got["a"].points_after and kept[0] == (1_700_000_000_000_000, 3600, 37.0, 55.0) and got["a"].length_m > 0
    assert got["bad"].length_m == 0 and got["bad"].degraded is False and got["bad"].warnings is None


def test_expired_cards_are_purged(spark, tmp_path):
    queue, results, check = (str(tmp_path / x) for x in ("queue", "results", "check"))
    old, new = m.EngineConfig(ttl_s=-200_000), m.EngineConfig()
    one_task = lambda key: spark.createDataFrame([(key, codec.encode(drive(20)), 0)], "task_key string, route_compressed string, attempt int")
    tasks.submit(one_task("queued"), queue)
    for number, (key, config) in enumerate([("gone", old), ("queued", old), ("kept", new)]):
        tasks.processor(results, None, config)(one_task(key), number)
    assert [r.task_key for r in tasks.cards(spark, results).collect()] == ["kept"]
    assert {r.task_key for r in tasks.cards(spark, results, expired=True).collect()} == {"gone", "queued", "kept"}
    # only the task that isn't queued loses its card; once it is off the queue, the other one does
    assert tasks.purge(spark, queue, results) == 1 and tasks.reclaim(spark, queue, results, 0) == (0, 0)
    assert tasks.trim(spark, queue, results) == 1 and tasks.purge(spark, queue, results) == 1
    assert [r.task_key for r in tasks.cards(spark, results, expired=True).collect()] == ["kept"]
    assert sorted(p.name for p in (tmp_path / "results").iterdir()) == ["batch=2"]
    # an expired card's task may come again, a kept one's may not
    again = one_task("gone").unionAll(one_task("kept"))
    told = []
    tasks.processor(results, None, new, lambda df: told.extend(r.task_key for r in df.collect()))(again, 3)
    assert told == ["gone"]


def test_tend_reclaims_beside_the_stream(spark, tmp_path):
    queue, results, check = (str(tmp_path / x) for x in ("queue", "results", "check"))
    tasks.submit(spark.createDataFrame([("lost", "?")], "task_key string, route_compressed string"), queue)

    class Twice:
        """A stream that ends after two waits."""

        left = 2

        def awaitTermination(self, timeout):
            self.left -= 1
            return self.left < 0

    assert tasks.tend(spark, Twice(), queue, results, 0, 0, m.EngineConfig(max_attempts=2)) == 2
    assert tasks.status(spark, queue, results, "lost")["error_kind"] == "poisoned"
    assert spark.read.schema(tasks.QUEUE).parquet(queue).count() == 0


def test_config():
    c = m.EngineConfig.load({"WAYMILL_DEDUP_M": "3.5", "WAYMILL_STOP_POINTS": "x", "WAYMILL_MAX_POINTS": "-1"})
    assert c.dedup_m == 3.5 and c.stop_points == 5 and c.max_points == 50_000


def test_resolve_route_debug_and_pass_cap(spark, tmp_path):
    card = tasks.resolve_route(spark, codec.encode(drive(20)))
    assert card["http_status"] == 200 and card["removed_points"] == 20 - card["points_after"] and card["degraded"]
    assert tasks.resolve_route(spark, "?")["http_status"] == 400 and tasks.resolve_route(spark, codec.encode(drive(1)))["http_status"] == 422
    assert tasks.resolve_route(spark, codec.encode(drive(20)), config=m.EngineConfig(max_points=5))["http_status"] == 413
    results = str(tmp_path / "cards")
    tasks.processor(results)(spark.createDataFrame([("a", codec.encode(drive(20)), 0)], "task_key string, route_compressed string, attempt int"), 0)
    assert [r.stage for r in tasks.debug(spark, results, "a").orderBy("at").collect()] == list(m.STAGES)
    # a single far point that is reached and left at a plausible speed: a stub
    pts = drive(20) + [(1_700_000_720_000_000, 0, 37.155, 55.0)] + drive(20, lon0=37.1, t0=1_700_000_870)
    p = k.Track(*(np.array(c) for c in zip(*[(t, x, y) for t, _, x, y in pts])))
    capped = one.resolve(p, AnalyticRoads(), m.EngineConfig(), np.full(41, 5.0), passes=1)
    assert capped["degraded"] and one.CUT_SHORT in capped["warnings"]
    whole = one.resolve(p, AnalyticRoads(), m.EngineConfig(), np.full(41, 5.0))
    assert not whole["degraded"] and 20 not in whole["own"]


def test_in_polygon(spark):
    from waymill.operators import sequence

    rows = [(0.5, 0.5, 1.0), (1.5, 0.5, 0.0), (0.5, -0.1, 0.0), (0.9, 0.9, 0.0), (0.1, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, want double")
    assert all(r.airfield == r.want for r in sequence.mark_airfields(df, [[(0.0, 0.0), (1.0, 0.0), (1.0, 0.7), (0.0, 0.8)]]).collect())


# ---------------------------------------------------------------- plans


@pytest.mark.parametrize("name", ["simplify", "split_sources", "find_stops", "build_chain"])
def test_rules_run_on_many_partitions_after_one_exchange(spark, name):
    """The view's own shuffle, then the one by track; nothing merges it again."""
    out = queries.queries()[name](spark, "/root/testdata/sf0.1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    assert below.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_NUM" in below


def test_rule_rows_stay_dealt_out(spark):
    out = queries.queries()["find_stops"](spark, "/root/testdata/sf0.1")
    assert len(out.select(F.spark_partition_id().alias("p")).distinct().collect()) >= 8


def test_a_track_beyond_the_bound_is_named(spark, monkeypatch):
    monkeypatch.setattr(engine, "MOST_POINTS", 3)
    rows = [("long", i, i * 1_000_000, 37.0 + i, 55.0) for i in range(4)] + [("short", 0, 0, 37.0, 55.0)]
    points = spark.createDataFrame(rows, "track_id string, seq int, t_us long, lon double, lat double")
    with pytest.raises(Exception, match="track long has more than 3 points"):
        engine.kept(points, lambda p: np.arange(len(p))).collect()
    assert engine.kept(points.where("track_id = 'short'"), lambda p: np.arange(len(p))).count() == 1
