"""Kernels against plain loops on random tracks, and thresholds on both sides."""

import math
import random
import statistics

import numpy as np
import pytest

from waymill import model as m
from waymill.functions import kernels as k

S = k.US


def track(rows):
    t, lon, lat = zip(*rows) if rows else ((), (), ())
    return k.Track([int(x * S) for x in t], lon, lat)


def dist(p, i, j):
    a, b = math.radians(p.lat[i]), math.radians(p.lat[j])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(p.lon[j] - p.lon[i]) / 2) ** 2
    return 2 * 6_371_008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def random_track(rng, n=None, places=3, wild=0.2):
    n = n if n is not None else rng.randint(0, 90)
    t, rows = 0, []
    homes = [(37 + rng.random(), 55 + rng.random() * 0.5) for _ in range(places)]
    x, y = homes[0]
    for _ in range(n):
        t += rng.choice([0, 1, 5, 20, 60, 240, 700, 2000])
        if rng.random() < wild:
            x, y = rng.choice(homes)
        x, y = x + rng.gauss(0, 1) * rng.choice([0, 1e-5, 1e-3, 1e-2]), y + rng.gauss(0, 1) * rng.choice([0, 1e-5, 1e-3])
        rows.append((t, x, y))
    return track(rows)


TRACKS = [random_track(random.Random(s), wild=random.Random(s).choice([0.02, 0.2, 0.6])) for s in range(120)]


def sec(p, i, j):
    return (int(p.t[j]) - int(p.t[i])) / S


def test_known_distances():
    pairs = [((0, 0), (1, 0), 111195.0802335329, 1e-6), ((0, 0), (0, 1), 111195.0802335329, 1e-6)]
    for a, b, want, tolerance in pairs:
        assert abs(k.hav1(*a, *b) - want) < tolerance and abs(float(k.hav(*a, *b)) - k.hav1(*a, *b)) < 1e-6


@pytest.mark.parametrize("p", TRACKS[:40])
def test_packing(p):
    keep = []
    for i in range(len(p)):
        if not keep or not (dist(p, keep[-1], i) < 300 and sec(p, keep[-1], i) < 60):
            keep.append(i)
    assert k.deduplicate(p, 300, 60).tolist() == keep
    keep, i, n = [], 0, len(p)
    while n >= 3 and i < n:
        keep.append(i)
        j = i
        while j + 1 < n and dist(p, i, j + 1) < 400:
            j += 1
        i = j if j - i >= 3 else i + 1
    assert k.collapse_stops(p, 400, 3).tolist() == (keep if n >= 3 else list(range(n)))

    def rdp(a, b):
        if b - a < 2:
            return []
        off = [float(k.cross_track(p.lon[i], p.lat[i], p.lon[a], p.lat[a], p.lon[b], p.lat[b])) for i in range(a + 1, b)]
        top = max(range(len(off)), key=lambda i: (off[i], -i))
        return rdp(a, a + 1 + top) + [a + 1 + top] + rdp(a + 1 + top, b) if off[top] > 50 else []

    if n > 2:
        assert k.simplify(p, 50).tolist() == [0, *rdp(0, n - 1), n - 1]
        must = np.zeros(n, bool)
        must[n // 2] = True
        assert k.simplify(p, 50, must).tolist() == sorted({0, *rdp(0, n // 2), n // 2, *rdp(n // 2, n - 1), n - 1})
    kept = k.simplify(p, 5000)
    full = k.guard(p, kept)
    assert set(kept) <= set(full)
    for a, b in zip(kept, kept[1:]):
        ok = sec(p, a, b) >= 0 and dist(p, a, b) <= 110 / 3.6 * sec(p, a, b) + 300
        assert ok == (not set(range(a + 1, b)) & set(full)) or b == a + 1


@pytest.mark.parametrize("p", TRACKS[:60])
def test_stops(p):
    out, i, n = [], 0, len(p)
    while i < n:
        if sec(p, i, n - 1) < 300:
            break
        xs, ys, j = [p.lon[i]], [p.lat[i]], i
        while j + 1 < n and k.hav1(sum(xs) / len(xs), sum(ys) / len(ys), p.lon[j + 1], p.lat[j + 1]) <= 150:
            j += 1
            xs.append(p.lon[j])
            ys.append(p.lat[j])
        if j > i and sec(p, i, j) >= 300:
            out.append((i, j))
            i = j + 1
        else:
            i += 1
    assert k.find_stops(p) == out
    for a, b in out:
        exits = []
        for q in range(b + 1, n):
            if sec(p, b, q) > 900 or len(exits) == 5:
                break
            if dist(p, b, q) >= 200:
                exits.append(dist(p, b, q) / max(sec(p, b, q), 1) * 3.6)
        assert k.plausible_exit(p, b) == (not exits or min(exits) <= 150)
        gaps = max(sec(p, q, q + 1) for q in range(a, b))
        want = sec(p, a, b) >= 900 and gaps <= 0.8 * sec(p, a, b) and k.span(p, a, b) >= 20 and k.plausible_exit(p, b)
        assert k.trusted_stop(p, a, b, None) == want and k.trusted_stop(p, a, b, 700.0) == want and not k.trusted_stop(p, a, b, 700.1)
    owner = k.stop_owner(n, out)
    assert [int(x) for x in owner] == [next((q for q, (a, b) in enumerate(out) if a <= i <= b), -1) for i in range(n)]


def still(t0, n, step, lon, lat, jitter=0.0):
    return [(t0 + i * step, lon + (jitter if i % 2 else -jitter), lat) for i in range(n)]


def test_stop_thresholds():
    assert k.find_stops(track(still(0, 6, 60, 37, 55))) == [(0, 5)] and k.find_stops(track(still(0, 6, 59, 37, 55))) == []
    p = track(still(0, 31, 30, 37, 55, 0.0002))
    assert k.trusted_stop(p, 0, 30, None) and not k.trusted_stop(p, 0, 29, None)
    assert not k.trusted_stop(track(still(0, 31, 30, 37, 55)), 0, 30, None) and k.is_frozen(track(still(0, 31, 30, 37, 55)), 0, 30)


@pytest.mark.parametrize("p", TRACKS)
def test_traps_and_islands(p):
    n, bad, i = len(p), set(), 0
    while i < n - 3:
        j = i
        while j + 1 < n and sec(p, i, j + 1) <= 600:
            j += 1
        if j - i >= 4:
            v = [dist(p, q - 1, q) / sec(p, q - 1, q) * 3.6 for q in range(i + 1, j + 1) if sec(p, q - 1, q) > 0]
            if v and statistics.median(v) > 50 and k.span(p, i, j) < 0.25 * statistics.median(v) / 3.6 * sec(p, i, j):
                bad |= set(range(i, j + 1))
        i = j if j > i else i + 1
    assert set(k.indices(k.find_traps(p))) == bad
    bad = set()
    cuts = [0, *(i + 1 for i in range(n - 1) if dist(p, i, i + 1) > 5000), n]
    for a, b in zip(cuts, cuts[1:]):
        if n >= 3 and b - a < 6 and sec(p, a, b - 1) < 180 and sum(dist(p, q, q + 1) for q in range(a, b - 1)) < 800:
            bad |= set(range(a, b))
    assert set(k.indices(k.find_islands(p))) == bad


def plain_dual(p):
    n, bad = len(p), set()
    jumps = [i for i in range(n - 1) if dist(p, i, i + 1) >= 3000 and sec(p, i, i + 1) >= 0 and dist(p, i, i + 1) / max(sec(p, i, i + 1), 1) * 3.6 > 200]
    if n < 20 or len(jumps) < 6:
        return bad
    groups = [[jumps[0]]]
    for j in jumps[1:]:
        if sec(p, groups[-1][-1], j) <= 3600:
            groups[-1].append(j)
        else:
            groups.append([j])
    for g in groups:
        if len(g) < 6:
            continue
        a, b = g[0], g[0] + 1
        ours = lambda i: dist(p, i, a) <= 3000 or dist(p, i, b) <= 3000  # noqa: E731, B023
        lo, hi = g[0], g[-1] + 1
        while lo > 0 and ours(lo - 1):
            lo -= 1
        while hi < n - 1 and ours(hi + 1):
            hi += 1
        total, cover = max(sec(p, lo, hi), 1), []
        for c in (a, b):
            idx = [i for i in range(lo, hi + 1) if dist(p, i, c) <= 3000]
            runs = []
            for i in idx:
                if runs and runs[-1][1] == i - 1:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
            cover.append((sum(sec(p, x, y) for x, y in runs) / total, idx))
        (ca, ia), (cb, ib) = cover
        if max(ca, cb) / max(min(ca, cb), 1e-6) >= 2:
            bad |= set(ia if cb >= ca else ib)
            continue
        homes = []
        for i in range(lo, hi + 1):
            for h in homes:
                if dist(p, h[0], i) <= 3000:
                    h.append(i)
                    break
            else:
                homes.append([i])
        if len(homes) >= 4 and max(sum(s for s in (sec(p, x, y) for x, y in zip(h, h[1:])) if s <= 300) / total for h in homes) < 0.35:
            bad |= set(range(lo, hi + 1))
    return bad


def weave(rng, n, homes, step=40):
    return track([(i * step, homes[i // rng.choice([1, 2, 3]) % len(homes)][0] + rng.gauss(0, 1e-3), homes[i // 2 % len(homes)][1]) for i in range(n)])


def test_dual_on_alternating_sources():
    hits = 0
    for s in range(60):
        rng = random.Random(s)
        homes = [(37 + 0.2 * i, 55.5) for i in range(rng.choice([2, 3, 5, 6]))]
        p = weave(rng, rng.randint(15, 80), homes, rng.choice([10, 40, 90]))
        got = set(k.indices(k.find_dual(p)))
        assert got == plain_dual(p)
        hits += bool(got)
    assert hits > 10
    for p in TRACKS:
        assert set(k.indices(k.find_dual(p))) == plain_dual(p)


def test_split_on_rotating_places():
    """Three places that take turns for hours are guilty, but for a clear leader."""
    rows, t = [], 0
    for turn in range(60):
        lon = 37 + 0.2 * (turn % 3)
        for _ in range(3):
            rows.append((t, lon, 55.5))
            t += 120
    p = track(rows)
    assert k.find_split(p).all()
    count, guilty = k.returns(p, np.arange(30), k.places(p, np.arange(30)))
    assert count == 7 and guilty == {0, 1, 2}
    honest = track([(i * 60, 37 + i * 0.005, 55.5) for i in range(200)])
    assert not k.find_split(honest).any()
    lead = [(i * 60, 37.0, 55.5) for i in range(300)]
    for a in range(100, 160, 10):
        lead[a : a + 3] = [(x[0], 37.3, 55.5) for x in lead[a : a + 3]]
    got = set(k.indices(k.find_split(track(lead))))
    assert got == {i for i, r in enumerate(lead) if r[1] == 37.3}
    assert not k.find_split(track(rows[:60])).any()  # under two hours


@pytest.mark.parametrize("p", TRACKS[:60])
def test_amnesty(p):
    rng, n = random.Random(len(p)), len(p)
    snap = np.array([rng.choice([5.0, 30.0, 31.0, float("nan")] if rng.random() < 0.2 else [10.0]) for _ in range(n)])
    suspect, bad = np.array([rng.random() < 0.7 for _ in range(n)], dtype=bool), np.array([rng.random() < 0.05 for _ in range(n)], dtype=bool)
    decoy = np.array([float(rng.random() < 0.02) for _ in range(n)])
    free = [not suspect[i] and not bad[i] for i in range(n)]
    road = [snap[i] <= 30 for i in range(n)]
    tied = lambda a, b: abs(sec(p, a, b)) <= 180 and dist(p, a, b) <= abs(sec(p, a, b)) * 110 / 3.6 + 300
    want = set()
    for order in (list(range(n)), list(range(n))[::-1]):
        trust = None
        for i in order:
            if free[i]:
                trust = i
            elif bad[i] or trust is None or not (road[i] and tied(trust, i)):
                trust = None
            else:
                want.add(i)
                trust = i
    run = []
    for i in [*range(n), None]:
        fits = i is not None and suspect[i] and not bad[i] and road[i]
        if run and (not fits or not tied(run[-1], i)):
            if len(run) >= m.AMNESTY_RUN and not any(decoy[j] > 0 for j in run):
                want |= set(run)
            run = []
        if fits:
            run.append(i)
    assert set(k.indices(k.find_amnesty(p, snap, suspect, bad, decoy))) == want


@pytest.mark.parametrize("p", TRACKS[:40])
def test_weights(p):
    rng, n = random.Random(len(p)), len(p)
    snap = np.array([rng.choice([float("nan"), 0.0, 10.0, 40.0, 200.0]) for _ in range(n)])
    known = [s for s in snap if not math.isnan(s)]
    sigma = min(60, max(25, 2 * statistics.median(known))) if known else 25
    raw = [0 if math.isnan(s) else 2 * math.exp(-s * s / (2 * sigma * sigma)) - 1 for s in snap]
    low = []
    for i in range(n):
        a, b = max(0, i - 2), min(n, i + 3)
        while a > 0 and sec(p, a - 1, i) <= 60 and i - a < 30:
            a -= 1
        while b < n and sec(p, i, b) <= 60 and b - i < 30:
            b += 1
        low.append(min(raw[i], statistics.median(raw[a:b])))
    got = k.point_weights(p, snap)
    assert np.allclose(got[0], raw) and np.allclose(got[1], low)


def test_weight_order():
    """Each step of the weights shows against its neighbours."""
    p = track([(0, 37, 55), (0.5, 37.01, 55), (100, 37.02, 55), (200, 37.02, 55), (300, 37.03, 55), (400, 37.04, 55)])
    none, off = np.zeros(6), np.zeros(6, bool)
    build = lambda **c: k.build_weights(p, np.full(6, 0.0), *[c.get(x, d) for x, d in (("trusted", off), ("observed", none.astype(int)), ("frozen", off), ("split", off), ("decoy", none), ("airfield", off))])[0]
    on = lambda i: np.arange(6) == i
    assert np.allclose(build(), [0.5, 0.5, 0.5, 0.5, 1, 1])
    assert np.allclose(build(observed=np.where(on(4), 10, 0)), [0.5, 0.5, 0.5, 0.5, 2, 1])
    assert np.allclose(build(observed=np.where(on(4), 10, 0), split=on(4))[4], 1 - 3)
    assert np.allclose(build(frozen=on(4))[4], -1.5)
    assert np.allclose(build(airfield=on(4)), np.array([0.5, 0.5, 0.5, 0.5, 1, 1]) - 5)
    assert np.allclose(build(airfield=on(4), trusted=on(3))[3], 0.5)
    assert np.allclose(build(decoy=np.where(on(5), 0.5, 0))[5], 1 if k.find_amnesty(p, none, on(5), off, np.where(on(5), 0.5, 0))[5] else -0.5)


def plain_chain(p, w, bans, lookback):
    n = len(p)
    best, prev = list(w), [-1] * n
    y, x = k.cells(p.lon, p.lat)

    def ok(i, j):
        dt = sec(p, i, j)
        return dt >= 0 and dt >= bans.get((y[i], x[i], y[j], x[j]), 0) and dist(p, i, j) <= 110 / 3.6 * dt + 300

    top = 0
    tops = [0]
    for j in range(1, n):
        lo, b, pj = max(0, j - lookback), w[j], -1
        for i in [*range(j - 1, lo - 1, -1), *([tops[lo - 1]] if lo > 0 else [])]:
            if best[i] + w[j] > b and ok(i, j):
                b, pj = best[i] + w[j], i
        best[j], prev[j] = b, pj
        top = j if b >= best[top] else top
        tops.append(top)
    end = best.index(max(best)) if n else -1
    out = []
    while end >= 0:
        out.append(end)
        end = prev[end]
    return out[::-1]


@pytest.mark.parametrize("p", TRACKS)
def test_chain(p):
    rng = random.Random(len(p))
    w = [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0, 1.0]) for _ in range(len(p))]
    bans, b = {}, k.ChainBuilder(p, 7)
    for _ in range(len(p)):
        i, j = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
        bans[b.key(i, j)] = rng.choice([10.0, 500.0, 1e6])
    for rules in ({}, bans):
        got = b.build(np.array(w), rules).tolist()
        want = plain_chain(p, w, rules, 7)
        assert got == want
    assert k.ChainBuilder(p).build(np.array(w)).tolist() == plain_chain(p, w, {}, 2000)


@pytest.mark.parametrize("p", TRACKS)
def test_chain_rules(p):
    rng, n = random.Random(len(p)), len(p)
    chain = np.array([i for i in range(n) if rng.random() < 0.8], dtype=np.int64)
    trusted = np.array([rng.random() < 0.1 for _ in range(n)], dtype=bool)
    q = p.take(chain)
    c = len(chain)
    d, s = (lambda i, j: dist(q, i, j)), (lambda i, j: sec(q, i, j))
    # stubs
    want, hits = [0.0] * n, 0
    cuts = [0, *(i + 1 for i in range(c - 1) if d(i, i + 1) >= 2000), c]
    for a, b in zip(cuts, cuts[1:]) if c >= 3 else ():
        travel = (s(a - 1, a) if a else 0) + (s(b - 1, b) if b < c else 0)
        inside = s(a, b - 1)
        if not any(trusted[chain[i]] for i in range(a, b)) and travel > 0 and inside / (inside + travel) <= 0.1 and sum(d(i, i + 1) for i in range(a, b - 1)) < 3500:
            hits += 1
            for i in range(a, b):
                want[chain[i]] += 2
    got = np.zeros(n)
    assert k.check_stubs(p, chain, got, trusted) == hits and got.tolist() == want
    # rush
    want, hits = [0.0] * n, 0
    for i in range(c - 1) if c >= 3 else ():
        j = i
        while j + 1 < c and s(i, j + 1) <= 60:
            j += 1
        if j > i and s(i, j) > 0 and sum(d(x, x + 1) for x in range(i, j)) > s(i, j) * 110 / 3.6 + 300:
            hits += 1
            for x in range(i, j + 1):
                want[chain[x]] += 2
    got = np.zeros(n)
    assert k.check_rush(p, chain, got) == hits and np.allclose(got, want)
    # lonely
    want, hits, groups = [0.0] * n, 0, []
    for i in range(c):
        if groups and s(groups[-1][-1], i) < 1800:
            groups[-1].append(i)
        else:
            groups.append([i])
    for before, g, after in zip(groups, groups[1:], groups[2:]):
        a, b = d(before[-1], g[0]), d(g[-1], after[0])
        if c >= 4 and len(g) <= 3 and min(a, b) >= 300 and d(before[-1], after[0]) < min(a, b):
            hits += 1
            for i in g:
                want[chain[i]] += 3
    got = np.zeros(n)
    assert k.check_lonely(p, chain, got) == hits and got.tolist() == want
    # sideways acceleration
    want = [0.0] * n
    for i in range(1, c - 1):
        d1, d2, d3 = d(i - 1, i), d(i, i + 1), d(i - 1, i + 1)
        if min(d1, d2) < 40 or s(i - 1, i) <= 0 or s(i, i + 1) <= 0 or (d1 + d2) / s(i - 1, i + 1) * 3.6 < 30:
            continue
        h = (d1 + d2 + d3) / 2
        sq = h * (h - d1) * (h - d2) * (h - d3)
        if sq > 0 and math.sqrt(sq) >= 1e-6:
            r = d1 * d2 * d3 / 4 / math.sqrt(sq)
            if r > 1e-6 and ((d1 + d2) / s(i - 1, i + 1)) ** 2 / r / 9.81 >= 0.35:
                want[chain[i]] += 2
    got = np.zeros(n)
    k.check_lateral(p, chain, got)
    assert got.tolist() == want


def test_loops_have_hysteresis_and_memory():
    rows = [(w * 1900 + i * 300, 37 + (0.05 if i % 2 else 0), 55.0) for w in range(4) for i in range(6)]
    p = track(rows)
    b, chain = k.ChainBuilder(p), np.arange(len(p))
    path = k.length(p.take(np.arange(6)))
    memory = k.RoadMemory(len(p))
    roads = iter([path / 3.5, path / 2.0, None, path / 1.8])
    assert k.check_loops(b, chain, memory, lambda pairs: [next(roads) for _ in pairs]) == 2
    assert [bool(memory.penalty[6 * w]) for w in range(4)] == [True, True, False, False]
    assert k.check_loops(b, chain, memory, lambda pairs: 1 / 0) == 0  # all are known by now


def test_road_bans_and_questions():
    p = track([(0, 37, 55), (60, 37.02, 55), (120, 37.04, 55), (180, 37.06, 55)])
    b, memory, chain = k.ChainBuilder(p), k.RoadMemory(4), np.arange(4)
    assert k.road_pairs(b, chain, memory) == []  # short and slow enough
    fast = track([(0, 37, 55), (30, 37.02, 55), (120, 37.05, 55), (180, 37.05, 55)])
    b, memory = k.ChainBuilder(fast), k.RoadMemory(4)
    pairs = k.road_pairs(b, chain, memory)
    assert pairs == [(0, 1)]
    assert k.check_road(b, chain, memory, lambda pairs: [3000.0 for _ in pairs]) == 1
    assert memory.bans[b.key(0, 1)] == pytest.approx(108) and memory.penalty.tolist() == [0.6, 0.6, 0, 0]
    assert (0, 1) not in k.road_pairs(b, chain, memory)


def test_reorder_is_a_permutation_that_never_lengthens():
    for s in range(60):
        rng = random.Random(s)
        rows = [(i // rng.choice([1, 3, 5, 14]) * 10, 37 + i * 0.001, 55.0) for i in range(50)]
        by_time = sorted(range(50), key=lambda i: (rows[i][0], rng.random()))
        p = track([rows[i] for i in by_time])
        perm = k.reorder(p)
        assert sorted(perm) == list(range(50)) and (p.t[perm] == p.t).all()
        assert k.length(p.take(perm)) <= k.length(p) + 1e-3
    p = track([(0, 37, 55), (10, 37.03, 55), (10, 37.02, 55), (10, 37.01, 55), (20, 37.04, 55)])
    assert k.reorder(p).tolist() == [0, 3, 2, 1, 4]


def test_retired_filters():
    p = track([(0, 37, 55), (10, 37.001, 55), (20, 37.5, 55), (30, 37.501, 55), (40, 37.002, 55), (50, 37.003, 55)])
    assert k.remove_teleports(p, 5000, 1000, 500).tolist() == [0, 1, 4, 5]
    assert k.filter_speed(p, 100).tolist() == [0, 1, 4, 5]
    assert k.filter_acceleration(p, 5).tolist() == [0, 1, 4, 5]
    q = track([(0, 37, 55), (10, 37.02, 55), (20, 37.01, 55), (30, 37.03, 55)])
    assert k.remove_backtrack(q, 100).tolist() == [0, 1, 3] and k.remove_backtrack(q, 0).tolist() == [0, 1, 2, 3]
    for f in (lambda t: k.remove_teleports(t, 1, 1, 1), lambda t: k.filter_speed(t, 1), lambda t: k.filter_acceleration(t, 1), lambda t: k.remove_backtrack(t, 1), k.deduplicate, k.collapse_stops, k.simplify):
        assert len(f(track([]))) == 0 and f(track([(0, 37, 55)])).tolist() == [0]


def test_large_inputs_stay_fast():
    import time

    n = 20_000
    began = time.time()
    k.find_stops(k.Track(np.arange(n) * 14_000, np.full(n, 37.0), np.full(n, 55.0)))
    k.ChainBuilder(k.Track(np.arange(n) * 5 * S, 37 + np.arange(n) * 1e-4, np.full(n, 55.0))).build((np.arange(n) % 7 - 3).astype(float))
    k.simplify(k.Track(np.arange(n), 37 + np.arange(n) * 1e-4, 55 + 0.01 * np.sin(np.arange(n))), 5)
    assert time.time() - began < 30


def jittered(n):
    """A way to the east with places at seven widths; it stands still by turns, and some points lie far ahead."""
    rng, i = np.random.default_rng(3), np.arange(n)
    run = n // 6
    at = (i // run) * (run * 2 // 3) + np.minimum(i % run, run * 2 // 3)
    return k.Track(i * S // 10, 37.6 + at * 3e-5 + np.where(rng.random(n) < 0.04, 0.35, 0.0), 55.75 + rng.integers(-3, 4, n) * 2e-4)


@pytest.mark.parametrize("n", [900, 4000])
def test_simplified_tracks_are_those_of_a_plain_division(n):
    p = jittered(n)

    def plain(a, b):
        if b - a < 2:
            return []
        off = k.cross_track(p.lon[a + 1 : b], p.lat[a + 1 : b], p.lon[a], p.lat[a], p.lon[b], p.lat[b])
        at = a + 1 + int(off.argmax())
        return [*plain(a, at), at, *plain(at, b)] if off.max() > 5 else []

    import sys

    deep = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert k.simplify(p, 5).tolist() == [0, *plain(0, n - 1), n - 1]
    finally:
        sys.setrecursionlimit(deep)


def test_simplification_does_not_look_at_all_points_at_each_division(monkeypatch):
    seen, real = [], k.cross_track
    monkeypatch.setattr(k, "cross_track", lambda *a: seen.append(len(a[0])) or real(*a))
    p = jittered(40_000)
    assert len(k.simplify(p, 5)) > 4000
    assert sum(seen) < 10 * len(p)
