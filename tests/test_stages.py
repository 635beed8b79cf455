"""The engine with its roads in stages: the choice in rounds, providers, drawn gaps."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill import model as m
from waymill import queries as q
from waymill import stage_queries
from waymill.functions import kernels as k
from waymill.operators import sequence as s
from waymill.plans import engine, rounds, staged, weave
from waymill.plans import track as one
from waymill.plans.providers import FormulaProvider, HttpProvider, TableProvider
from waymill.plans.roads import HttpRoads, Route, TableRoads, pair_key, point_key
from waymill.sources.events import track_view

POINT = "track_id string, seq int, t_us long, lon double, lat double"


class KeyedRoads:
    """Roads of a kernel that answer as FormulaProvider does, from the keys alone."""

    def __init__(self, provider: FormulaProvider):
        self.p = provider

    def snap(self, p, snap_m):
        return np.full(len(p), self.p.snap_m)

    def pairs(self, p, wanted):
        at = lambda i, j: [float(v) for e in pair_key(p, i, j).split(";") for v in e.split(",")]
        return [k.hav1(*at(i, j)) * self.p.factor for i, j in wanted]

    def route(self, p, i, j):
        n = self.p.corners + 1
        along = lambda a, x: a[i] + (a[j] - a[i]) * x / n
        bend = lambda x: self.p.north * (1 + x % 2) if 0 < x < n else 0.0
        return Route(p.to(i, j) * self.p.factor, [(along(p.lon, x), along(p.lat, x) + bend(x)) for x in range(n + 1)])


def wandering(seed, tracks=12, most=200):
    """Tracks with leaps, equal times, silences and points off the way."""
    rng, out = np.random.default_rng(seed), {}
    for n in range(tracks):
        size = int(rng.integers(1, most))
        t = 1_700_000_000_000_000 + np.cumsum(rng.choice([0, 1, 20, 30, 60, 600, 2400], size, p=[0.03, 0.2, 0.3, 0.3, 0.13, 0.03, 0.01])) * k.US
        lon, lat = 37 + np.cumsum(rng.normal(0, 0.004, size)), 55 + np.cumsum(rng.normal(0, 0.003, size))
        far = rng.random(size) < 0.06
        lon[far] += rng.choice([0.4, 0.02, 0.05], int(far.sum()))
        out[f"t{n:02d}"] = k.Track(t, lon, lat)
    return out


def frame(spark, tracks, **more):
    names, rows = list(more), []
    for name, p in tracks.items():
        columns = [p.t.tolist(), p.lon.tolist(), p.lat.tolist(), *(more[c][name].tolist() for c in names)]
        rows += [(name, i, *values) for i, values in enumerate(zip(*columns))]
    kind = {"w": "double", "trusted": "boolean", "is_stop": "boolean", "snap_m": "double"}
    return spark.createDataFrame(rows, ", ".join([POINT, *(f"{c} {kind[c]}" for c in names)]))


# ---------------------------------------------------------------- rounds


@pytest.mark.parametrize("factor", [4.0])
def test_rounds_choose_the_chain_that_the_loop_over_one_track_chooses(spark, factor):
    tracks, rng = wandering(5, 7, 130), np.random.default_rng(1)
    w = {n: np.round(rng.uniform(-0.3, 1, len(p)), 6) for n, p in tracks.items()}
    trusted = {n: rng.random(len(p)) < 0.03 for n, p in tracks.items()}
    provider, asked = FormulaProvider(factor), []

    def distances(wanted):
        asked.append([r.key for r in wanted.select("key").collect()])
        return provider.distances(wanted)

    got = rounds.pick(frame(spark, tracks, w=w, trusted=trusted), distances, rounds.keeper(spark), passes=4)
    chain = got.chain.groupBy("track_id").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()
    chain, report = {r.track_id: r.s for r in chain}, {r.track_id: r for r in got.report.collect()}
    passes = []
    for name, p in tracks.items():
        want, roads = one.CoreReport(), KeyedRoads(provider)
        assert one.pick(p, w[name], trusted[name], lambda pairs: roads.pairs(p, pairs), want, 4).tolist() == chain[name], name
        r = report[name]
        assert (r.road_passes, r.loops, r.road_asked, r.road_banned, r.cut_short) == (want.road_passes, want.loops, want.road_asked, want.road_banned, want.cut_short)
        passes.append(want.road_passes)
    # a round handles the tracks that had faults in the one before, and no others
    open_tracks = [sum(n > x for n in passes) for x in range(max(passes))]
    assert max(passes) > 2 and [r["tracks"] for r in got.rounds] == open_tracks
    size = {n: len(p) for n, p in tracks.items()}
    assert [r["points"] for r in got.rounds] == [sum(size[n] for n, x in zip(tracks, passes) if x > i) for i in range(max(passes))]
    # and no pair of places is asked for twice, by any track
    flat = [x for part in asked for x in part]
    assert len(flat) == len(set(flat)) and [len(x) for x in asked] == [r["asked"] for r in got.rounds]


def test_rounds_end_at_the_pass_cap(spark):
    tracks = wandering(5, 4, 80)
    w, trusted = {n: np.ones(len(p)) for n, p in tracks.items()}, {n: np.zeros(len(p), bool) for n, p in tracks.items()}
    got = rounds.pick(frame(spark, tracks, w=w, trusted=trusted), FormulaProvider(4.0).distances, rounds.keeper(spark), passes=1)
    report = {r.track_id: r for r in got.report.collect()}
    for name, p in tracks.items():
        want, roads = one.CoreReport(), KeyedRoads(FormulaProvider(4.0))
        chain = one.pick(p, w[name], trusted[name], lambda pairs: roads.pairs(p, pairs), want, 1)
        assert sorted(r.seq for r in got.chain.where(F.col("track_id") == name).collect()) == chain.tolist() and report[name].cut_short == want.cut_short
    assert any(r.cut_short for r in report.values())


def test_registered_rounds_go_on_until_a_track_has_no_faults(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("event_id < 500").crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    e = e.withColumns({"event_id": F.col("event_id") + F.col("copy") * 100_000, "ts": F.col("ts") + F.make_dt_interval(secs=F.col("copy"))}).drop("copy")
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.track_id: r for r in q.queries()["stage_rounds"](spark, str(tmp_path)).collect()}
    v = s.weights(stage_queries._snapped_view(track_view(spark, str(tmp_path)))).orderBy("t_us", "seq").toPandas()
    passes = []
    for name, own in v.groupby("track_id"):
        p, want, roads = k.Track(own.t_us, own.lon, own.lat), one.CoreReport(), KeyedRoads(FormulaProvider(1.3))
        chain = one.pick(p, own.weight.to_numpy(), np.zeros(len(p), bool), lambda pairs: roads.pairs(p, pairs), want)
        r = got.pop(name)
        assert (r.kept, r.road_passes, r.loops, r.road_asked, r.road_banned) == (len(chain), want.road_passes, want.loops, want.road_asked, want.road_banned)
        passes.append(want.road_passes)
    assert not got and max(passes) > 2


def test_rounds_without_roads_and_without_rows(spark):
    tracks = wandering(7, 3, 60)
    w, trusted = {n: np.ones(len(p)) for n, p in tracks.items()}, {n: np.zeros(len(p), bool) for n, p in tracks.items()}
    got = rounds.pick(frame(spark, tracks, w=w, trusted=trusted), None, rounds.keeper(spark))
    for name, p in tracks.items():
        want = one.pick(p, w[name], trusted[name], None, one.CoreReport())
        assert sorted(r.seq for r in got.chain.where(F.col("track_id") == name).collect()) == want.tolist()
    none = rounds.pick(frame(spark, tracks, w=w, trusted=trusted).limit(0), FormulaProvider().distances, rounds.keeper(spark))
    assert none.chain.count() == 0 and none.report.count() == 0


def test_half_hours_begin_behind_the_one_before(spark):
    tracks = wandering(11, 6)
    got = rounds.half_hours(frame(spark, tracks)).groupBy("track_id", "half").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).collect()
    for name, p in tracks.items():
        want = [(int(x[0]), int(x[-1])) for x in k.loop_windows(p, np.arange(len(p)))]
        assert sorted((r.a, r.b) for r in got if r.track_id == name) == want


# ---------------------------------------------------------------- drawn gaps


def plain_drawn(p, provider, stop):
    out, drawn, source, report = one.fill(p, KeyedRoads(provider), stop)
    return out, drawn, source, report


@pytest.mark.parametrize("corners", [0, 5])
def test_drawn_gaps_equal_the_plain_version(spark, corners):
    tracks = {n: p for n, p in wandering(3).items() if len(p) > 1}
    rng = np.random.default_rng(2)
    stop = {n: rng.random(len(p)) < 0.2 for n, p in tracks.items()}
    provider = FormulaProvider(1.2, 0.002, corners)
    got = weave.draw(frame(spark, tracks, is_stop=stop), provider.routes, rounds.keeper(spark))
    rows = got.points.orderBy("track_id", "seq", "corner").collect()
    for name, p in tracks.items():
        out, drawn, source, report = plain_drawn(p, provider, stop[name])
        mine = [r for r in rows if r.track_id == name]
        assert [r.corner > 0 for r in mine] == drawn.tolist() and [r.t_us for r in mine] == out.t.tolist()
        assert [r.lon for r in mine] == pytest.approx(out.lon.tolist()) and [r.lat for r in mine] == pytest.approx(out.lat.tolist())
        why = got.gaps.where(F.col("track_id") == name).groupBy("verdict").count().collect()
        assert {r.verdict: r["count"] for r in why} == report.reasons
    if corners == 5:
        assert sum(r.corner > 0 for r in rows) > 20


def test_ends_move_onto_the_road_but_for_stops(spark):
    """Two gaps meet in point 1: its own beginning counts. Point 3 is a stop."""
    p = k.Track(np.arange(4) * 600 * k.US, [37.0, 37.1, 37.2, 37.3], [55.0] * 4)
    corner = lambda i, d: (round(37.0 + i / 10, 5), round(55.0 + d, 5))
    rows = [(*corner(i, 0), *corner(i + 1, 0), None, p.to(i, i + 1) * 1.1, [corner(i, 0.001), corner(i + 0.3, 0.004), corner(i + 0.6, 0.001), corner(i + 0.8, 0.003), corner(i + 1, 0.002)], corner(i, 0.001), corner(i + 1, 0.002)) for i in range(3)]
    end = "struct<lon:double,lat:double>"
    routes = spark.createDataFrame(rows, f"a_lon double, a_lat double, b_lon double, b_lat double, bearing int, distance double, coords array<{end}>, snap_a {end}, snap_b {end}")
    stop = np.array([False, False, False, True])
    got = weave.draw(frame(spark, {"x": p}, is_stop={"x": stop}), TableProvider(route=routes).routes, rounds.keeper(spark)).points.orderBy("seq", "corner").collect()
    known = TableRoads(routes={f"{point_key(*r[:2])};{point_key(*r[2:4])}": Route(r[5], r[6], r[7], r[8]) for r in rows})
    out, drawn, _, _ = one.fill(p, known, stop)
    assert [r.t_us for r in got] == out.t.tolist()
    assert [x for r in got for x in (r.lon, r.lat)] == pytest.approx([x for xy in zip(out.lon.tolist(), out.lat.tolist()) for x in xy])
    at = {r.seq: r.lat for r in got if r.corner == 0}
    assert at == pytest.approx({0: 55.001, 1: 55.001, 2: 55.001, 3: 55.0}) and sum(r.corner > 0 for r in got) == 9


# ---------------------------------------------------------------- whole engine


REPORT = ["status", "error", "points_before", "points_after", "reordered", "stops_total", "stops_trusted", "stops_frozen", "collapsed", "split", "spread", "amnesty", "loops", "road_banned", "road_asked", "road_passes", "dropped", "guarded", "gaps", "filled", "added_points"]


def compare(spark, points, provider, roads, config=m.EngineConfig(), passes=3):
    got = staged.resolve_in_stages(points, provider, config=config, passes=passes)
    want = engine.resolve(points, roads, config, passes)
    a, b = ({r.track_id: r for r in df.collect()} for df in (got.report, want))
    assert set(a) == set(b)
    for name, r in b.items():
        names = REPORT if r.status == "done" else ["status", "error", "points_before"]
        assert {c: a[name][c] for c in names} == {c: r[c] if r[c] is not None or c == "error" else 0 for c in names}, name
        if r.status == "done":
            for c in ("length_before_m", "length_after_m", "km_before", "km_after", "added_m", "snap_fraction", "snap_median"):
                assert a[name][c] == pytest.approx(r[c] or 0.0, abs=1e-6), (name, c)
    rows = lambda df: [(r.track_id, r.seq, r.input_seq, r.t_us, r.tz_off_s, round(r.lon, 7), round(r.lat, 7), r.synthetic, r.is_stop) for r in df.orderBy("track_id", "seq").collect()]
    assert rows(got.points) == rows(engine.points_of(want))
    return a


def test_stages_equal_the_engine_on_wandering_tracks(spark):
    tracks = wandering(21, 5, 100)
    # one that stands for an hour between two drives
    t = np.concatenate([np.arange(40) * 30, 1200 + np.arange(60) * 60, 4800 + np.arange(40) * 30])
    lon = np.concatenate([37 + np.arange(40) * 0.004, 37.16 + np.arange(60) % 2 * 0.0004, 37.16 + np.arange(40) * 0.004])
    tracks["stop"] = k.Track(t * k.US, lon, np.full(len(t), 55.0))
    tracks["two"] = k.Track([0, 60 * k.US], [37.0, 37.001], [55.0, 55.0])
    tracks["long"] = k.Track(np.arange(300) * k.US, 37 + np.arange(300) * 1e-4, np.full(300, 55.0))
    provider = FormulaProvider(1.6, 0.003, 4)
    found = compare(spark, frame(spark, tracks), provider, KeyedRoads(provider), m.EngineConfig(max_points=290))
    assert {r.status for r in found.values()} == {"done", "failed"} and sum(r.filled or 0 for r in found.values()) > 5 and sum(r.stops_trusted or 0 for r in found.values()) > 0


def test_stages_take_the_points_own_snaps(spark):
    tracks = wandering(4, 3, 80)
    rng = np.random.default_rng(9)
    snaps = {n: np.where(rng.random(len(p)) < (0.3 if n == "t01" else 0.02), np.nan, rng.gamma(2, 20, len(p))) for n, p in tracks.items()}
    points = frame(spark, tracks, snap_m=snaps).withColumn("snap_m", F.when(~F.isnan("snap_m"), F.col("snap_m")))

    class Own(KeyedRoads):
        def snap(self, p, snap_m):
            return snap_m

    found = compare(spark, points, FormulaProvider(1.6), Own(FormulaProvider(1.6)))
    assert any("snaps are known" in (r.error or "") for r in found.values())


def test_stages_without_a_snapper(spark):
    """No place has a snap, and no track is held to lack them."""

    class NoSnaps(KeyedRoads):
        def snap(self, p, snap_m):
            return None

    # all weights are 0 but those of a trusted stop
    t = np.concatenate([np.arange(9) * 60, 540 + np.arange(40) * 60, 2940 + np.arange(9) * 60])
    lon = np.concatenate([37 + np.arange(9) * 0.004, 37.036 + np.arange(40) % 2 * 0.0006, 37.036 + np.arange(9) * 0.004])
    tracks = {"stop": k.Track(t * k.US, lon, np.full(len(t), 55.0)), **wandering(6, 2, 60)}
    found = compare(spark, frame(spark, tracks), FormulaProvider(1.6, snap_m=None), NoSnaps(FormulaProvider(1.6)))
    assert all("snaps" not in (r.error or "") and r.snap_fraction == 0 for r in found.values()) and found["stop"].stops_trusted == 1


def test_stages_of_no_tracks(spark):
    got = staged.resolve_in_stages(spark.createDataFrame([], POINT), FormulaProvider())
    assert got.report.count() == 0 and got.points.count() == 0


# ---------------------------------------------------------------- a router


class _Router(BaseHTTPRequestHandler):
    most, now, peak, seen, lock, broken = 10_000, 0, 0, [], threading.Lock(), False

    def do_GET(self):
        with self.lock:
            self.seen.append(self.path)
            _Router.now += 1
            _Router.peak = max(_Router.peak, _Router.now)
        time.sleep(0.01)
        code, body = self._answer()
        with self.lock:
            _Router.now -= 1
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _answer(self):
        nodes = [tuple(map(float, x.split(","))) for x in self.path.split("/driving/")[1].split("?")[0].split(";")]
        if len(nodes) > self.most:
            return 414, {}
        if "/table/" in self.path:
            if self.broken:
                return 500, {}
            n = len(nodes) // 2
            return 200, {"distances": [[k.hav1(*a, *b) * 1.3 for b in nodes] for a in nodes]} if n else {}
        a, b = nodes[0], nodes[-1]
        coords = [[a[0] + (b[0] - a[0]) * x / 4, a[1] + (b[1] - a[1]) * x / 4 + (0.002 if 0 < x < 4 else 0)] for x in range(5)]
        return 200, {"routes": [{"distance": k.hav1(*a, *b) * 1.2, "geometry": {"coordinates": coords}}], "waypoints": [{"distance": 4.0, "location": list(c)} for c in nodes]}

    def log_message(self, *a):
        pass


@pytest.fixture()
def router():
    _Router.most, _Router.now, _Router.peak, _Router.seen, _Router.broken = 10_000, 0, 0, [], False
    s = ThreadingHTTPServer(("127.0.0.1", 0), _Router)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_a_router_is_asked_once_for_a_place_and_within_its_limit(spark, router):
    tracks = {f"v{n}": p for n, p in enumerate([*wandering(8, 3, 70).values()] * 2)}  # three vehicles on each way
    points = frame(spark, tracks)
    got = staged.resolve_in_stages(points, HttpProvider(router, requests=3), passes=2)
    assert _Router.peak <= 3
    asked = [x for path in _Router.seen if "overview=false" in path and "/route/" in path for x in path.split("/driving/")[1].split("?")[0].split(";")]
    requests = sum("overview=false" in path and "/route/" in path for path in _Router.seen)
    places = {point_key(a, b) for p in tracks.values() for a, b in zip(p.lon, p.lat)}
    # each place once, but for the points that two requests share
    assert set(asked) <= places and len(asked) - len(set(asked)) <= requests
    pairs = [path.split("/driving/")[1].split("?")[0] for path in _Router.seen if "/table/" in path]
    asked_pairs = [(x[i], x[len(x) // 2 + i]) for x in (p.split(";") for p in pairs) for i in range(len(x) // 2)]
    assert len(asked_pairs) == len(set(asked_pairs)) > 0
    routes = [path for path in _Router.seen if "overview=full" in path and "bearings" not in path]
    assert len(routes) == len(set(routes)) > 0
    # and the answers are those that tracks get which ask for themselves
    want = {r.track_id: r for r in engine.resolve(points, HttpRoads(router), passes=2).collect()}
    report = got.report.collect()
    assert [r.status for r in report].count("done") >= 3 and all(r.status == want[r.track_id].status for r in report)
    for r in report:
        if r.status == "done":
            assert (r.status, r.road_asked, r.road_banned, r.filled, r.points_after) == tuple(want[r.track_id][c] for c in ("status", "road_asked", "road_banned", "filled", "points_after"))


def test_router_faults_mark_the_tracks_that_asked(spark, router):
    _Router.broken = True
    tracks = wandering(8, 2, 60)
    tracks["still"] = k.Track(np.arange(5) * 30 * k.US, 37 + np.arange(5) * 0.0005, np.full(5, 55.0))
    report = {r.track_id: r for r in staged.resolve_in_stages(frame(spark, tracks), HttpProvider(router, 2, {"retries": 0}), passes=1).report.collect()}
    assert not report["still"].degraded and any(r.degraded and "the router failed" in r.warnings[0] for r in report.values())


def test_too_long_snap_requests_shrink_to_a_floor(router):
    _Router.most = 8
    p = k.Track(np.arange(900) * k.US, 37 + np.arange(900) * 1e-3, np.full(900, 55.0))
    roads = HttpRoads(router, retries=0, parallel=1)
    for size in (450, 225, 112, 56, 28, 28):
        assert (roads.snap(p, None) == 4.0).all()
    first = len(_Router.seen)
    _Router.most = 10_000
    assert (roads.snap(p, None) == 4.0).all()
    assert len(_Router.seen) - first == 19  # 49 new points a request: the spell of long answers left 50, not 2
