"""What shows on larger tables only: rounding at halves, tracks of many points."""

import random
import statistics
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymill import model as m
from waymill import queries, stream_queries
from waymill.functions import geo
from waymill.functions import kernels as k
from waymill.operators import sequence as s
from waymill.sources import codec


def test_coordinate_keys_round_the_double_itself(spark):
    """Halves of the sixth decimal whose doubles lie above or below them, and exact ones."""
    rng = random.Random(4)
    values = [52.939465, 53.492095, 0.015625, 0.046875, -0.046875, -0.000001, 0.0, 1e7 + 0.000005, -179.999995, *(rng.randrange(-17_999_999, 18_000_000) / 1e5 + 5e-6 for _ in range(500))]
    got = spark.createDataFrame([(x, -x) for x in values], "lon double, lat double").select("lon", "lat", geo.coordinate_key(F.col("lon"), F.col("lat")).alias("key")).collect()
    assert [r.key for r in got] == [f"{r.lon:.5f},{r.lat:.5f}" for r in got]


def test_windows_in_time_equal_sliding_frames_without_reading_them(spark):
    """hot, spread and rush against sliding frames, with points of equal time."""
    rng = random.Random(9)
    rows, lon = [], 37.0
    for track in "abc":
        t = 0
        for i in range(400):
            t += rng.choice([0, 0, 7, 29, 60, 600, 1800])
            lon = 37.0 + rng.choice([0.0, 0.0, 0.0, 0.02, 0.5]) if rng.random() < 0.1 else lon
            rows.append((track, i, t * 1_000_000, lon + rng.random() * 0.004, 55.0, rng.random() < 0.02))
    p = spark.createDataFrame(rows, "track_id string, seq int, t_us long, lon double, lat double, bad boolean")
    around = lambda low, high: Window.partitionBy("track_id").orderBy("t_us").rangeBetween(low * s.US, high * s.US)
    st = s.steps(p).withColumn("leap", F.coalesce((F.col("step_m") >= m.JUMP_M) & (F.col("dt_s") <= m.JUMP_GAP_S), F.lit(False)))
    st = st.withColumn("mark", F.col("leap") | F.coalesce(F.lead("leap").over(s.order()), F.lit(False)))
    st = st.withColumn("run_m", F.sum(F.coalesce("step_m", F.lit(0.0))).over(s.order().rowsBetween(Window.unboundedPreceding, 0)))
    minute = around(0, m.RUSH_S)
    st = st.select("track_id", "seq", F.max(F.col("mark").cast("int")).over(around(-m.JUMP_NEAR_S, m.JUMP_NEAR_S)) == 1, F.max(F.col("bad").cast("int")).over(around(-m.SPREAD_S, m.SPREAD_S)) == 1, F.max("seq").over(minute), F.round(F.max("run_m").over(minute) - F.col("run_m"), 6), F.max("t_us").over(minute) - F.col("t_us"))
    want = {(r[0], r[1]): tuple(r)[2:] for r in st.collect()}
    frames = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in (("hot", s.hot(p)), ("spread", s.spread(p, "bad")), ("rush", s.rush(p)))}
    assert not any("RangeFrame, -" in plan or "RangeFrame, currentrow$(), 6" in plan or "RangeFrame, 0" in plan for plan in frames.values())
    assert {(r.track_id, r.seq): r.hot for r in s.hot(p).collect()} == {key: w[0] for key, w in want.items()}
    assert {(r.track_id, r.seq): r.spread for r in s.spread(p, "bad").collect()} == {key: w[1] for key, w in want.items()}
    rushed = {key: (w[2], w[3]) for key, w in want.items() if w[4] > 0 and w[3] > w[4] / s.US * m.CHAIN_KMH / 3.6 + m.CHAIN_SLACK_M}
    assert {(r.track_id, r.seq): (r.end_seq, round(r.path_m, 6)) for r in s.rush(p).collect()} == rushed and len(rushed) > 10


def _wander(n: int, seed: int = 3) -> k.Track:
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.integers(0, 120, n)) * k.US
    return k.Track(t, 37.0 + np.cumsum(rng.normal(0, 1e-3, n)) + rng.choice([0.0, 0.0, 0.0, 0.4], n), 55.0 + np.cumsum(rng.normal(0, 1e-3, n)))


def _peak(run) -> int:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_weights_hold_a_block_of_wide_rows_at_a_time():
    """A row of sixty numbers for each point of a track took 480 bytes and more a point, several times over."""
    p = _wander(100_000)
    snap = np.where(np.arange(len(p)) % 7 == 0, np.nan, np.arange(len(p)) % 50.0)
    assert _peak(lambda: k.point_weights(p, snap)) < 700 * len(p)
    part = k.Track(p.t[:20_000], p.lon[:20_000], p.lat[:20_000])
    raw, low = k.point_weights(part, snap[:20_000])
    for i in [0, 1, 5, *range(k.BLOCK - 3, k.BLOCK + 3), 19_999]:
        near = [raw[j] for j in range(max(0, i - m.SMOOTH_MOST), min(len(part), i + m.SMOOTH_MOST)) if abs(j - i) <= m.SMOOTH_LEAST or abs(part.t[j] - part.t[i]) <= m.SMOOTH_S * k.US]
        assert low[i] == min(raw[i], statistics.median(near))


def test_road_pairs_as_arrays():
    """In the order of the loop that they replace, of equal times the first; with memory of bans and questions."""
    p = _wander(3_000)
    b, chain = k.ChainBuilder(p), np.flatnonzero(np.arange(len(p)) % 5 != 2)
    memory = k.RoadMemory(len(p))
    memory.penalty[::50] = 1.0

    def plain():
        wanted, last = list(zip(chain[:-1].tolist(), chain[1:].tolist())), len(chain) - 1
        for at in k.hot_spots(p, chain, memory.penalty).tolist():
            wanted += [(int(chain[max(0, at - x)]), int(chain[min(last, at + x)])) for x in m.HOT_STEPS]
        out, seen = [], set()
        for i, j in wanted:
            key, d, dt = (b.t[i], b.t[j]), p.to(i, j), (b.t[j] - b.t[i]) / k.US
            if i >= j or key in seen or key in memory.asked or b.key(i, j) in memory.bans or d < m.ROAD_LEAST_M or d < m.ROAD_SHORT_M and dt > 0 and d / dt * 3.6 <= m.ROAD_SHORT_KMH:
                continue
            seen.add(key)
            out.append((i, j))
        return out

    first = plain()
    assert k.road_pairs(b, chain, memory) == first and len(first) > 1_000
    memory.asked |= {(b.t[i], b.t[j]) for i, j in first[::3]}
    memory.bans |= {b.key(i, j): 1.0 for i, j in first[1::3]}
    assert k.road_pairs(b, chain, memory) == plain()
    long = _wander(60_000)
    builder, empty = k.ChainBuilder(long), k.RoadMemory(len(long))
    assert _peak(lambda: k.asked_pairs(builder, np.arange(len(long)), empty)) < 700 * len(long)


@pytest.mark.parametrize("seed", range(4))
def test_teleports_skip_blocks_without_losing_a_return(seed):
    def plain(p, jump, back, wide):
        keep, i = [], 0
        while i < len(p):
            keep.append(i)
            nxt = i + 1
            if nxt < len(p) and p.to(i, nxt) > jump:
                near = np.flatnonzero(p.to(i, slice(nxt + 1, len(p))) < back)
                j = nxt + 1 + int(near[0]) if len(near) else -1
                nxt = j if j >= 0 and k.span(p, nxt, j - 1) < wide else nxt
            i = nxt
        return keep

    p = _wander(3_500, seed)
    for limits in ((20_000.0, 300.0, 60_000.0), (20_000.0, 60.0, 1e9), (20_000.0, 5000.0, 10_000.0)):
        assert k.remove_teleports(p, *limits).tolist() == plain(p, *limits)


def test_teleports_read_no_whole_track_for_each_jump(monkeypatch):
    """Every fortieth point jumps 30 km off and back: all points behind it were measured."""
    n = 40_000
    p = k.Track(np.arange(n) * k.US, 10.0 + np.arange(n) * 2e-4 + (np.arange(n) % 40 == 7) * 0.35, np.full(n, 40.0))
    read, to = [0], k.Track.to

    def counted(self, i, j):
        found = to(self, i, j)
        read[0] += np.size(found)
        return found

    monkeypatch.setattr(k.Track, "to", counted)
    k.remove_teleports(p, 20_000.0, 5000.0, 10_000.0)
    assert read[0] < 50 * n


def test_round_trip_of_a_track_beyond_the_cap_of_tasks(spark):
    """60,000 points came back as none: the round trip is of the wire form, not of a task."""
    rows = spark.range(60_000).select(F.lit("a").alias("track_id"), F.col("id").cast("int").alias("seq"), (F.col("id") * s.US).alias("t_us"), (F.lit(37.0) + F.col("id") * 1e-5).alias("lon"), F.lit(55.0).alias("lat"))
    made = rows.unionAll(rows.limit(3).withColumn("track_id", F.lit("b")))
    got = {(r.track_id, r.n, r.last) for r in queries._round_trip(made).groupBy("track_id").agg(F.count("*").alias("n"), F.max_by("lon", "seq").alias("last")).collect()}
    assert got == {("a", 60_000, 37.0 + 59_999 * 1e-5), ("b", 3, 37.0 + 2 * 1e-5)}


def test_decoding_holds_columns():
    route = codec.encode([(i * s.US, 0, 37.0 + i * 1e-5, 55.0) for i in range(50_000)])
    assert _peak(lambda: codec.decode_columns(route)) < 250 * 50_000


def test_places_are_dealt_out_in_blocks(monkeypatch):
    """The same places as point by point, with points of equal distance; no call for each point."""

    def plain(p):
        centre, home = [], []
        for i in range(len(p)):
            d = k.hav(p.lon[centre], p.lat[centre], p.lon[i], p.lat[i]) if centre else np.zeros(0)
            if not len(d) or not d.min() <= m.SPLIT_NEAR_M:
                centre.append(i)
                d = np.append(d, 0.0)
            home.append(int(d.argmin()) if centre[-1] != i else len(centre) - 1)
        return home, centre

    rng = np.random.default_rng(6)
    n = 2 * k.BLOCK + 77
    apart = np.degrees(m.SPLIT_NEAR_M / m.EARTH_M)
    p = k.Track(np.arange(n) * k.US, 37.0 + rng.integers(-40, 40, n) * apart / 4, 0.0 + rng.integers(-2, 3, n) * apart / 4)
    home, centre = k.homes(p.lon, p.lat)
    assert (home.tolist(), centre.tolist()) == plain(p) and len(centre) > 10
    made = k.places(p, np.arange(n))
    assert [x.centre for x in made] == centre.tolist() and [x.members for x in made] == [np.flatnonzero(home == x).tolist() for x in range(len(centre))]
    assert k.places(p, []) == [] and [x.members for x in k.places(p, [7, 3])][0][0] == 7
    calls, hav = [0], k.hav
    monkeypatch.setattr(k, "hav", lambda *a: (calls.__setitem__(0, calls[0] + 1), hav(*a))[1])
    k.homes(p.lon, p.lat)
    assert calls[0] < n / 10


def test_stream_queries_take_tracks_beyond_the_cap_of_tasks(spark):
    """60,000 points got a failed card, where the SQL has a done one."""
    rows = spark.range(60_000).select(F.lit("a").alias("track_id"), F.col("id").cast("int").alias("seq"), (F.col("id") * 10 * s.US).alias("t_us"), F.lit(0).alias("tz_off_s"), (F.lit(37.0) + F.col("id") * 1e-4).alias("lon"), F.lit(55.0).alias("lat"))
    cards, _ = stream_queries._twice(rows)
    assert [(r.task_key, r.status, r.points_before) for r in cards.collect()] == [("a", "done", 60_000)]


def test_a_chain_looks_up_few_bans_for_each_point():
    """Whatever the look back: a point far off has no drivable predecessor among hundreds of heavy ones."""
    rng = random.Random(7)
    n, calls = 3000, [0]
    t = np.arange(n) * 400_000
    lon = 37.6 + np.arange(n) * 0.00004 + np.where(np.arange(n) % 9 == 4, 0.35, 0.0)
    p = k.Track(t, lon, np.array([55.75 + rng.randrange(-3, 4) * 0.0002 for _ in range(n)]))
    w = np.array([rng.choice([-300.0, -2.5, 0.5, 0.9, 1.0]) for _ in range(n)])

    class Counted(k.ChainBuilder):
        def key(self, i, j):
            calls[0] += 1
            return super().key(i, j)

    b, bans = Counted(p), {}
    for _ in range(400):
        i = rng.randrange(n - 60)
        bans[b.key(i, i + rng.randrange(1, 60))] = rng.choice([5.0, 20.0, 600.0])
    calls[0] = 0
    got = b.build(w, bans).tolist()
    assert calls[0] < 12 * n
    # the plain rule over numbered cells: of the drivable predecessors the heaviest, the nearest of equals
    place = {c: q for q, c in enumerate(sorted(set(b.cell)))}
    at, need = np.array([place[c] for c in b.cell]), np.zeros((len(place), len(place)))
    for (ya, xa, yb, xb), s in bans.items():
        need[place[ya, xa], place[yb, xb]] = s
    best, prev, top = w.copy(), np.full(n, -1), [0]
    for j in range(1, n):
        i = np.arange(j - 1, max(0, j - 2000) - 1, -1)
        if j > 2000:
            i = np.append(i, top[j - 2001])
        dt = (t[j] - t[i]) / 1e6
        i = i[(best[i] > 0) & (dt >= need[at[i], at[j]]) & (p.to(j, i) <= 110 / 3.6 * dt + 300)]
        if len(i):
            prev[j] = i[int(best[i].argmax())]
            best[j] = best[prev[j]] + w[j]
        top.append(j if best[j] >= best[top[-1]] else top[-1])
    want = [int(best.argmax())]
    while prev[want[-1]] >= 0:
        want.append(int(prev[want[-1]]))
    assert got == want[::-1]
