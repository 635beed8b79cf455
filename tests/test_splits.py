"""Sources that take turns: the stages against the fold over one track."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import kernels as k
from waymill.operators import splits
from waymill.plans import rounds

POINT = "track_id string, seq int, t_us long, lon double, lat double"


def frame(spark, tracks):
    return spark.createDataFrame([(n, i, t, x, y) for n, p in tracks.items() for i, (t, x, y) in enumerate(zip(p.t.tolist(), p.lon.tolist(), p.lat.tolist()))], POINT)


def turning(seed, hours, apart=(0.3,), share=0.5, step=(60, 200), drive=0.0, gap=0):
    """A track whose points stand at one of some places by turns of a few minutes;
    ``share`` of the turns belong to the first, and some hours drive on instead."""
    rng = np.random.default_rng(seed)
    t, lon, lat, now, at, place = [], [], [], 0, 37.0, 0
    while now < hours * 3600:
        if rng.random() < 0.3:
            place = 0 if rng.random() < share else int(rng.integers(1, len(apart) + 1))
        on_way = drive and now % 14400 > 14400 * (1 - drive)
        at += 0.02 if on_way else 0.0
        t.append(now)
        lon.append(at + (0.0 if on_way or not place else apart[place - 1]) + rng.normal(0, 0.001))
        lat.append(55 + rng.normal(0, 0.001))
        now += int(rng.integers(*step)) + (gap if rng.random() < 0.01 else 0)
    return k.Track(np.array(t) * k.US + 1_700_000_000_000_000, lon, lat)


@pytest.fixture(scope="module")
def tracks():
    found = {f"even{i}": turning(i, 6 + i) for i in range(3)}
    found |= {f"rare{i}": turning(10 + i, 8, share=0.97) for i in range(3)}
    found |= {f"three{i}": turning(20 + i, 9, (0.2, 0.5), 0.4) for i in range(2)}
    found |= {f"drive{i}": turning(30 + i, 20, drive=0.4, gap=4000) for i in range(4)}
    found |= {"far": turning(40, 6, (4.0,)), "short": turning(41, 1), "few": k.Track([0, 1], [37.0, 38.0], [55.0, 55.0]), "one": k.Track([0], [37.0], [55.0])}
    # turns in the middle of a long stay at one of the places, so that episodes grow over it, and beyond a few points off the way
    base = turning(50, 12)
    lon = base.lon.copy()
    lon[: len(lon) // 3] = 37.0
    lon[len(lon) // 3 - 30 : len(lon) // 3 : 9] = 37.9
    found["grows"] = k.Track(base.t, lon, base.lat)
    lon = base.lon.copy()
    lon[-len(lon) // 3 :] = 37.3
    lon[-40::11] = 38.4
    found["grows_on"] = k.Track(base.t, lon, base.lat)
    return found


def test_suspects_equal_the_fold(spark, tracks):
    got = splits.suspects(frame(spark, tracks)).groupBy("track_id").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()
    want = {n: k._split_suspects(p).tolist() for n, p in tracks.items() if len(p) >= m.SPLIT_POINTS}
    assert {r.track_id: r.s for r in got} == {n: x for n, x in want.items() if x} and len(got) > 6


def test_episodes_equal_the_fold(spark, tracks):
    points = frame(spark, tracks)
    got = splits.episodes(points, splits.suspects(points)).orderBy("track_id", "low").collect()
    want = [(n, lo, hi, sorted(seed)) for n, p in sorted(tracks.items()) if len(p) >= m.SPLIT_POINTS and len(x := k._split_suspects(p)) for lo, hi, seed in k._split_episodes(p, x)]
    assert [(r.track_id, r.low, r.high, sorted(c.seq for c in r.seeds)) for r in got] == want and len(want) > 6
    for r in got:
        p, own = tracks[r.track_id], [c.seq for c in r.seeds]
        assert r.span_m == pytest.approx(max(p.to(a, b) for a in own for b in own), abs=1e-6)


def test_verdicts_equal_the_fold(spark, tracks, monkeypatch):
    handled = []
    real = splits.slot_shares
    monkeypatch.setattr(splits, "slot_shares", lambda points, spans: (handled.append(spans.count()), real(points, spans))[1])
    got = splits.find_split(frame(spark, tracks), rounds.keeper(spark)).groupBy("track_id").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()
    want = {n: k.indices(k.find_split(p)).tolist() for n, p in tracks.items()}
    assert {r.track_id: r.s for r in got} == {n: x for n, x in want.items() if x}
    # honest and guilty places both occur, and only open episodes are judged again
    assert any(0 < len(x) < len(tracks[n]) / 2 for n, x in want.items()) and any(len(x) > len(tracks[n]) * 0.9 for n, x in want.items())
    assert len(handled) >= 2 and handled == sorted(handled, reverse=True) and handled[1] < handled[0]


def test_split_of_nothing(spark):
    assert splits.find_split(spark.createDataFrame([], POINT), rounds.keeper(spark)).count() == 0


@settings(max_examples=15, deadline=None)
@given(ranges=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(0, 15)), min_size=1, max_size=25))
def test_merged_ranges_equal_a_walk(spark, ranges):
    rows = [(n, lo, lo + size, i) for i, (n, lo, size) in enumerate(ranges)]
    got = splits.merged_ranges(spark.createDataFrame(rows, "track_id string, low int, high int, id int"), "track_id", "low", "high", "id")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    unions = sorted((r.track_id, r.low, r.high, r.n) for r in got.groupBy("track_id", "merged").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).collect())
    want = []
    for name, lo, hi, _ in sorted(rows):
        if want and want[-1][0] == name and lo <= want[-1][2] + 1:
            want[-1] = (name, want[-1][1], max(want[-1][2], hi), want[-1][3] + 1)
        else:
            want.append((name, lo, hi, 1))
    assert unions == want
