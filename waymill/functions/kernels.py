"""Order-dependent rules over one track as NumPy kernels.

A track is three equal arrays: t (microseconds, int64), lon and lat (degrees).
Kernels take and return positions; none changes its arguments.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cached_property
from math import atan2, cos, radians, sin, sqrt

import numpy as np

from waymill import model as m

US = 1_000_000
#: Points whose wide rows are held at a time.
BLOCK = 16_384


class Track:
    __slots__ = ("t", "lon", "lat")

    def __init__(self, t, lon, lat):
        self.t, self.lon, self.lat = np.asarray(t, dtype=np.int64), np.asarray(lon, dtype=np.float64), np.asarray(lat, dtype=np.float64)

    def __len__(self) -> int:
        return len(self.t)

    def take(self, idx) -> Track:
        idx = np.asarray(idx, dtype=np.int64)
        return Track(self.t[idx], self.lon[idx], self.lat[idx])

    def steps(self) -> np.ndarray:
        """Lengths of the steps between consecutive points."""
        return hav(self.lon[:-1], self.lat[:-1], self.lon[1:], self.lat[1:])

    def gaps(self) -> np.ndarray:
        return np.diff(self.t) / US

    def to(self, i: int, j) -> np.ndarray | float:
        """Distances of point i to points j."""
        if isinstance(j, (int, np.integer)):
            return hav1(self.lon[i], self.lat[i], self.lon[j], self.lat[j])
        return hav(self.lon[i], self.lat[i], self.lon[j], self.lat[j])


def hav(lon1, lat1, lon2, lat2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * m.EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def hav1(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """``hav`` of two single points, without array overhead."""
    a, b = radians(lat1), radians(lat2)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon2 - lon1) / 2) ** 2
    return 2 * m.EARTH_M * atan2(sqrt(h), sqrt(max(1 - h, 0.0)))


def length(p: Track) -> float:
    return float(p.steps().sum()) if len(p) > 1 else 0.0


def azimuth(lon1, lat1, lon2, lat2):
    a, b, d = np.radians(lat1), np.radians(lat2), np.radians(np.subtract(lon2, lon1))
    return np.arctan2(np.sin(d) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d))


def cross_track(lon, lat, lon1, lat1, lon2, lat2) -> np.ndarray:
    away = hav(lon1, lat1, lon, lat) / m.EARTH_M
    turn = azimuth(lon1, lat1, lon, lat) - azimuth(lon1, lat1, lon2, lat2)
    return np.abs(np.arcsin(np.sin(away) * np.sin(turn))) * m.EARTH_M


def span(p: Track, lo: int, hi: int) -> float:
    """Diagonal of the bounding box of points lo to hi."""
    if lo < 0 or hi >= len(p) or lo > hi:
        return 0.0
    lon, lat = p.lon[lo : hi + 1], p.lat[lo : hi + 1]
    return hav1(lon.min(), lat.min(), lon.max(), lat.max())


def indices(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(flags)


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last positions of the runs of True."""
    edge = np.diff(np.concatenate(([0], np.asarray(flags, dtype=np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def cells(lon, lat) -> tuple[np.ndarray, np.ndarray]:
    return np.rint(np.asarray(lat) * m.CELL_DEGREE_M / m.CELL_M).astype(np.int64), np.rint(np.asarray(lon) * m.CELL_DEGREE_M * np.cos(np.radians(lat)) / m.CELL_M).astype(np.int64)


# ------------------------------------------------------------ order


def reorder(p: Track) -> np.ndarray:
    """Permutation that straightens batches of equal time: slot k gets point
    ``perm[k]``. Of the batch's own order, a nearest-first walk from the point
    before it and the reverse of one from the point after it, a later one is
    taken only if it is shorter."""
    n = len(p)
    perm = np.arange(n)
    if n < 3:
        return perm
    slots = defaultdict(list)
    for i, t in enumerate(p.t.tolist()):
        slots[t].append(i)

    def walk(members: list[int], at: int | None) -> list[int]:
        left, out = list(members), []
        while left:
            at = left[0] if at is None else min(left, key=lambda i: p.to(at, i))
            left.remove(at)
            out.append(at)
        return out

    for own in slots.values():
        if not 2 <= len(own) <= m.REORDER_MOST:
            continue
        before = own[0] - 1 if own[0] else None
        after = own[-1] + 1 if own[-1] + 1 < n else None
        best, least = None, 0.0
        for order in (own, walk(own, before), walk(own, after)[::-1]):
            path = [i for i in (before, *order, after) if i is not None]
            total = sum(p.to(a, b) for a, b in zip(path, path[1:]))
            if best is None or total < least - m.REORDER_GAIN_M:
                best, least = order, total
        perm[own] = best
    return perm


# ------------------------------------------------------------ packing


def deduplicate(p: Track, metres: float = 2.0, seconds: float = 60.0) -> np.ndarray:
    """Drops a point near the last kept one in both place and time."""
    if not len(p):
        return np.zeros(0, np.int64)
    keep, last = [0], 0
    for i in range(1, len(p)):
        if (p.t[i] - p.t[last]) < seconds * US and p.to(last, i) < metres:
            continue
        keep.append(i)
        last = i
    return np.array(keep)


def _reach(p: Track, i: int, metres: float) -> int:
    """Last point of the unbroken run nearer than ``metres`` to point i."""
    at, width = i + 1, 32
    while at < len(p):
        far = np.flatnonzero(p.to(i, slice(at, at + width)) >= metres)
        if len(far):
            return at + int(far[0]) - 1
        at, width = at + width, width * 2
    return len(p) - 1


def collapse_stops(p: Track, metres: float = 50.0, points: int = 5) -> np.ndarray:
    """Keeps the first of every run of ``points`` followers near it."""
    n = len(p)
    if points < 2 or n < points:
        return np.arange(n)
    # whether the next followers are near is told for a block of points at once; a run is walked from its first point alone
    keep, i = np.zeros(n, dtype=bool), 0
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        run = np.arange(a, b) < n - points
        for d in range(1, points + 1):
            at = a + np.flatnonzero(run)
            run[at - a] = ~(hav(p.lon[at], p.lat[at], p.lon[at + d], p.lat[at + d]) >= metres)
        for start in (a + np.flatnonzero(run)).tolist():
            if start >= i:
                keep[i : start + 1] = True
                j = _reach(p, start, metres)
                i = j if j - start >= points else start + 1
        if i < b:
            keep[i:b] = True
            i = b
    return indices(keep)


class _Farthest:
    """The point of a stretch that lies farthest off the line through the stretch's ends,
    for many stretches of one track. ``cross_track`` decides, but only between points that
    a plane through the line can't tell apart; whole blocks of points are skipped by their
    boxes, and by holding nothing but places that the stretch has had before."""

    #: Sines of equal points differ by far less, those that differ by more are in the order of ``cross_track``.
    NEAR = 1e-11

    def __init__(self, p: Track, size: int = 64):
        self.p, self.size = p, size
        a, b = np.radians(p.lat), np.radians(p.lon)
        self.sines = np.sin(a), np.cos(a), np.sin(b), np.cos(b)
        # axes east, north and up at the track's middle, where boxes lie close about their points
        mid = (float(f(c.mean())) for c in (a, b) for f in (np.sin, np.cos))
        self.axes = np.stack(self._axes(*mid))
        self.at = np.stack((self.sines[1] * self.sines[3], self.sines[1] * self.sines[2], self.sines[0]), axis=1) @ self.axes.T
        self.plain = not np.isfinite(self.at).all()
        order = np.lexsort((p.lat, p.lon))
        same = (p.lon[order[1:]] == p.lon[order[:-1]]) & (p.lat[order[1:]] == p.lat[order[:-1]])
        #: The point before with the same place, -1 if there is none.
        self.before = np.full(len(p), -1)
        self.before[order[1:][same]] = order[:-1][same]
        cut = np.arange(0, len(p), size)
        low, high = np.minimum.reduceat(self.at, cut), np.maximum.reduceat(self.at, cut)
        self.centre, self.half, self.new = (low + high) / 2, (high - low) / 2, np.minimum.reduceat(self.before, cut)

    @staticmethod
    def _axes(sa: float, ca: float, sb: float, cb: float) -> tuple[tuple[float, float, float], ...]:
        """East, north and up, by sines and cosines of a place's latitude and longitude."""
        return (-sb, cb, 0.0), (-sa * cb, -sa * sb, ca), (ca * cb, ca * sb, sa)

    def _side(self, a: int, b: int) -> np.ndarray:
        """The direction square to the line from a to b at a; the line's angle is that of ``azimuth``."""
        sines = [c.item(a) for c in self.sines]
        sa, ca, *_ = sines
        sb, cb, d = self.sines[0].item(b), self.sines[1].item(b), np.radians(self.p.lon[b] - self.p.lon[a])
        turn = float(np.arctan2(np.sin(d) * cb, ca * sb - sa * cb * np.cos(d)))
        east, north, _ = self._axes(*sines)
        x, y = cos(turn), sin(turn)
        return self.axes @ np.array([x * e - y * n for e, n in zip(east, north)])

    def _plain(self, a: int, b: int, metres: float) -> int:
        p = self.p
        off = cross_track(p.lon[a + 1 : b], p.lat[a + 1 : b], p.lon[a], p.lat[a], p.lon[b], p.lat[b])
        k = int(off.argmax())
        return a + 1 + k if off[k] > metres else -1

    def _farthest(self, lo: int, hi: int, side: np.ndarray, least: float) -> tuple[float, np.ndarray | None]:
        """The largest sine of points lo to hi - 1, and the points that come near it; none if it is below ``least``."""
        if hi - lo <= 8 * self.size:
            s = np.abs(self.at[lo:hi] @ side)
            top = s.item(s.argmax())
            return top, None if top < least else lo + (s >= top - self.NEAR).nonzero()[0]
        size = self.size
        a, b = -(-lo // size), hi // size
        most = np.abs(self.centre[a:b] @ side) + self.half[a:b] @ np.abs(side)
        most[self.new[a:b] >= lo] = -1.0
        parts = [np.arange(lo, a * size), np.arange(b * size, hi)]
        top, found = 0.0, []
        while True:
            own = np.concatenate(parts)
            s = np.abs(self.at[own] @ side)
            top = max(top, float(s.max())) if len(s) else top
            found.append((own, s))
            blocks = np.flatnonzero(most >= top - self.NEAR)
            if not len(blocks):
                break
            if len(blocks) > 16:  # the highest boxes first: what they hold rules out most of the others
                blocks = blocks[np.argpartition(most[blocks], -8)[-8:]]
            most[blocks] = -1.0
            parts = [((a + blocks)[:, None] * size + np.arange(size)).ravel()]
        return top, np.sort(np.concatenate([own[s >= top - self.NEAR] for own, s in found]))

    def beyond(self, a: int, b: int, metres: float) -> int:
        """The first of the points between a and b that lie farthest off their line, -1 if that is ``metres`` at most."""
        p = self.p
        if self.plain:
            return self._plain(a, b, metres)
        least = sin(min(metres / m.EARTH_M, 1.0))
        top, near = self._farthest(a + 1, b, self._side(a, b), least - self.NEAR)
        if max(top, least) > 0.4:  # so far off the sine says little
            return self._plain(a, b, metres)
        if near is None or top < least - self.NEAR:
            return -1
        near = near[self.before[near] <= a]  # of equal places the first
        if len(near) == 1 and top > least + self.NEAR:
            return near.item(0)
        off = cross_track(p.lon[near], p.lat[near], p.lon[a], p.lat[a], p.lon[b], p.lat[b])
        k = int(off.argmax())
        return int(near[k]) if off[k] > metres else -1


def simplify(p: Track, metres: float = 5.0, must: np.ndarray | None = None) -> np.ndarray:
    """Douglas-Peucker between mandatory points; the farthest point divides,
    the first of equals."""
    n = len(p)
    if n <= 2:
        return np.arange(n)
    keep = np.zeros(n, dtype=bool) if must is None else np.asarray(must, dtype=bool).copy()
    keep[[0, -1]] = True
    anchors = indices(keep).tolist()
    todo, far = list(zip(anchors, anchors[1:])), _Farthest(p)
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        k = far.beyond(a, b, metres)
        if k >= 0:
            keep[k] = True
            todo += [(a, k), (k, b)]
    return indices(keep)


def drivable(p: Track, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dt = (p.t[b] - p.t[a]) / US
    return (dt >= 0) & (hav(p.lon[a], p.lat[a], p.lon[b], p.lat[b]) <= m.CHAIN_KMH / 3.6 * dt + m.CHAIN_SLACK_M)


def guard(p: Track, kept: np.ndarray) -> np.ndarray:
    """Restores all points of ``p`` between kept neighbours that packing made
    impossible to drive."""
    keep = np.zeros(len(p), dtype=bool)
    keep[kept] = True
    if len(kept) > 1:
        for a, b in zip(kept[:-1][bad := ~drivable(p, kept[:-1], kept[1:])], kept[1:][bad]):
            keep[a:b] = True
    return indices(keep)


def remove_backtrack(p: Track, metres: float) -> np.ndarray:
    """Drops points nearer to the start and farther from the end than the last
    kept one, both by more than the tolerance."""
    n = len(p)
    if metres <= 0 or n < 3:
        return np.arange(n)
    start, goal = p.to(0, slice(None)), p.to(n - 1, slice(None))
    keep = [0]
    for i in range(1, n - 1):
        last = keep[-1]
        if not (start[last] - start[i] > metres and goal[i] - goal[last] > metres):
            keep.append(i)
    return np.array([*keep, n - 1])


class _Boxes:
    """Bounding boxes of a track's blocks of points, to skip blocks unread."""

    def __init__(self, p: Track, size: int = 1024):
        self.p, self.size = p, size
        at = np.arange(0, len(p), size)
        self.low, self.high = ([f.reduceat(c, at) for c in (p.lon, p.lat)] for f in (np.minimum, np.maximum))

    def first_near(self, i: int, lo: int, metres: float) -> int:
        """The first point from ``lo`` on within ``metres`` of point i; -1 if there is none."""
        p, hi = self.p, min(lo + 64, len(self.p))
        while lo < len(p):  # nearly always soon
            near = np.flatnonzero(p.to(i, slice(lo, hi)) < metres)
            if len(near):
                return lo + int(near[0])
            lo, hi = hi, min((hi // self.size + 1) * self.size, len(p))
            if lo % self.size == 0:
                break
        if lo >= len(p):
            return -1
        # a box that lies farther off by its latitude alone holds no near point
        b = lo // self.size
        off = np.maximum(np.maximum(self.low[1][b:] - p.lat[i], p.lat[i] - self.high[1][b:]), 0.0)
        close = ~(np.radians(off) * m.EARTH_M > metres * (1 + 1e-9) + 1e-3)
        if abs(p.lat[i]) < 80:  # and so does one by its longitude: points within ``metres`` differ by few degrees of it
            reach = np.degrees(metres * 1.01 / m.EARTH_M) + 1e-6
            if reach < 5 and abs(p.lat[i]) + reach < 85:
                far = reach / np.cos(np.radians(abs(p.lat[i]) + reach)) * 1.01
                lon0, lon1 = self.low[0][b:], self.high[0][b:]
                if far < 90 and np.abs(lon0).max() <= 180 and np.abs(lon1).max() <= 180 and abs(p.lon[i]) < 180 - far:
                    close &= (lon0 <= p.lon[i] + far) & (lon1 >= p.lon[i] - far)
        for x in (b + np.flatnonzero(close)).tolist():
            a = x * self.size
            near = np.flatnonzero(p.to(i, slice(a, a + self.size)) < metres)
            if len(near):
                return a + int(near[0])
        return -1

    def span(self, lo: int, hi: int) -> float:
        """``span`` of points lo to hi, whole blocks by their boxes."""
        a, b = -(-lo // self.size), (hi + 1) // self.size
        if a >= b:
            return span(self.p, lo, hi)
        ends = []
        for f, boxes in ((np.min, self.low), (np.max, self.high)):
            for c, box in ((self.p.lon, boxes[0]), (self.p.lat, boxes[1])):
                parts = [x for x in (c[lo : a * self.size], box[a:b], c[b * self.size : hi + 1]) if len(x)]
                ends.append(f(np.array([f(x) for x in parts])))
        return hav1(*ends)


def remove_teleports(p: Track, jump_m: float, return_m: float, span_m: float) -> np.ndarray:
    """Cuts a detour that begins with a jump, comes back near its origin and
    stays small meanwhile."""
    n, keep, i = len(p), [], 0
    boxes = _Boxes(p) if n else None
    while i < n:
        keep.append(i)
        nxt = i + 1
        if nxt < n and p.to(i, nxt) > jump_m:
            j = boxes.first_near(i, nxt + 1, return_m)
            if j >= 0 and boxes.span(nxt, j - 1) < span_m:
                nxt = j
        i = nxt
    return np.array(keep, dtype=np.int64)


def _kmh(p: Track, a: int, b: int) -> float:
    dt = (p.t[b] - p.t[a]) / US
    return p.to(a, b) / (dt if dt > 0 else 1.0) * 3.6


def filter_speed(p: Track, kmh: float) -> np.ndarray:
    keep = list(range(min(1, len(p))))
    for i in range(1, len(p)):
        if _kmh(p, keep[-1], i) <= kmh:
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def filter_acceleration(p: Track, most: float) -> np.ndarray:
    """``most`` in km/h per second, against the speed of the last kept step."""
    keep = list(range(min(2, len(p))))
    if len(p) > 2:
        speed = _kmh(p, 0, 1)
        for i in range(2, len(p)):
            new, dt = _kmh(p, keep[-1], i), (p.t[i] - p.t[keep[-1]]) / US
            if abs(new - speed) / (dt if dt > 0 else 1.0) <= most:
                keep.append(i)
                speed = new
    return np.array(keep, dtype=np.int64)


# ------------------------------------------------------------ stops


def find_stops(p: Track, metres: float = m.STOP_RADIUS_M, stay_s: float = m.STOP_STAY_S) -> list[tuple[int, int]]:
    """Runs that stay near their own running centre for ``stay_s``."""
    n, out, i = len(p), [], 0
    while i < n and p.t[-1] - p.t[i] >= stay_s * US:
        if i + 1 < n and hav1(p.lon[i], p.lat[i], p.lon[i + 1], p.lat[i + 1]) > metres:
            i += 1
            continue
        j, width, lon, lat = i, 16, p.lon[i], p.lat[i]
        while j + 1 < n:
            more = slice(j + 1, j + 1 + width)
            lons, lats = np.cumsum(np.concatenate(([lon], p.lon[more]))), np.cumsum(np.concatenate(([lat], p.lat[more])))
            count = np.arange(j - i + 1, j - i + 1 + len(lons))
            off = hav(lons[:-1] / count[:-1], lats[:-1] / count[:-1], p.lon[more], p.lat[more]) > metres
            if off.any():
                j += int(off.argmax())
                break
            j, lon, lat, width = j + len(off), lons[-1], lats[-1], width * 2
        if j > i and p.t[j] - p.t[i] >= stay_s * US:
            out.append((i, j))
            i = j + 1
        else:
            i += 1
    return out


def stop_owner(n: int, stops: list[tuple[int, int]]) -> np.ndarray:
    """Ordinal of each point's stop, -1 outside."""
    owner = np.full(n, -1)
    for k, (a, b) in enumerate(stops):
        owner[max(a, 0) : b + 1] = k
    return owner


def is_frozen(p: Track, a: int, b: int) -> bool:
    return span(p, a, b) < m.FROZEN_SPAN_M


def plausible_exit(p: Track, end: int) -> bool:
    """Of the first points beyond the stop's surroundings, the slowest was not too fast."""
    to = int(np.searchsorted(p.t, p.t[end] + m.EXIT_S * US, side="right"))
    after = np.arange(end + 1, max(to, end + 1))
    d = p.to(end, after) if len(after) else np.zeros(0)
    left = after[d >= m.EXIT_M][: m.EXIT_LOOK]
    if not len(left):
        return True
    return bool((d[left - end - 1] / np.maximum((p.t[left] - p.t[end]) / US, 1) * 3.6).min() <= m.EXIT_KMH)


def trusted_stop(p: Track, a: int, b: int, snap: float | None) -> bool:
    if a < 0 or b >= len(p) or a > b:
        return False
    stay = (p.t[b] - p.t[a]) / US
    if stay < m.TRUST_STAY_S or (snap is not None and snap > m.TRUST_SNAP_M):
        return False
    if b > a and np.diff(p.t[a : b + 1]).max() / US / stay > m.TRUST_GAP:
        return False
    return span(p, a, b) >= m.TRUST_SPAN_M and plausible_exit(p, b)


# ------------------------------------------------------------ forgery before the chain


def find_traps(p: Track) -> np.ndarray:
    n, bad, i = len(p), np.zeros(len(p), dtype=bool), 0
    if n < 4:
        return bad
    last = np.searchsorted(p.t, p.t + m.TRAP_S * US, side="right") - 1
    step, gap = p.steps(), p.gaps()
    while i < n - 3:
        j = int(last[i])
        if j - i >= m.TRAP_POINTS:
            d, dt = step[i:j], gap[i:j]
            if (dt > 0).any():
                v = float(np.median(d[dt > 0] / dt[dt > 0])) * 3.6
                if v > m.TRAP_KMH and span(p, i, j) < m.TRAP_SPAN * v / 3.6 * (p.t[j] - p.t[i]) / US:
                    bad[i : j + 1] = True
        i = max(j, i + 1)
    return bad


def find_islands(p: Track) -> np.ndarray:
    n = len(p)
    if n < 3:
        return np.zeros(n, dtype=bool)
    step = p.steps()
    part = np.concatenate(([0], np.cumsum(step > m.ISLAND_GAP_M)))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    size = np.diff(np.append(first, n))
    stay = (p.t[first + size - 1] - p.t[first]) / US
    path = np.bincount(part[1:], weights=np.where(np.diff(part) == 0, step, 0.0), minlength=len(first))
    return ((size < m.ISLAND_POINTS) & (stay < m.ISLAND_STAY_S) & (path < m.ISLAND_PATH_M))[part]


def find_jumps(p: Track) -> np.ndarray:
    if len(p) < 2:
        return np.zeros(0, np.int64)
    step, gap = p.steps(), p.gaps()
    return indices((step >= m.DUAL_JUMP_M) & (gap >= 0) & (step / np.maximum(gap, 1) * 3.6 > m.DUAL_KMH))


def chained(t: np.ndarray, idx: np.ndarray, gap_s: float) -> list[np.ndarray]:
    """Groups of positions whose consecutive times are at most gap_s apart."""
    idx = np.asarray(idx)
    return [g for g in np.split(idx, np.flatnonzero(np.diff(t[idx]) > gap_s * US) + 1) if len(g)]


def find_dual(p: Track) -> np.ndarray:
    """Two sources that alternate in one track: the place that is held less is
    forged; many places of which none is held are all forged."""
    n, bad = len(p), np.zeros(len(p), dtype=bool)
    jumps = find_jumps(p)
    if n < m.DUAL_POINTS or len(jumps) < m.DUAL_SWITCHES:
        return bad
    for episode in chained(p.t, jumps, m.DUAL_GAP_S):
        if len(episode) < m.DUAL_SWITCHES:
            continue
        a, b = int(episode[0]), int(episode[0]) + 1
        if p.to(a, b) < m.DUAL_JUMP_M:
            continue
        at_a, at_b = p.to(a, slice(None)) <= m.DUAL_NEAR_M, p.to(b, slice(None)) <= m.DUAL_NEAR_M
        lo, hi = a, int(episode[-1]) + 1
        foreign = indices(~(at_a | at_b))
        k = int(np.searchsorted(foreign, lo))
        lo = int(foreign[k - 1]) + 1 if k else 0
        k = int(np.searchsorted(foreign, hi, side="right"))
        hi = int(foreign[k]) - 1 if k < len(foreign) else n - 1
        window = slice(lo, hi + 1)
        total = max((p.t[hi] - p.t[lo]) / US, 1.0)

        def held(flags: np.ndarray) -> float:
            return sum(p.t[lo + e] - p.t[lo + s] for s, e in stretches(flags[window])) / US / total

        share_a, share_b = held(at_a), held(at_b)
        if not at_a[window].any() or not at_b[window].any():
            continue
        if max(share_a, share_b) / max(min(share_a, share_b), 1e-6) >= m.DUAL_RATIO:
            bad[window] |= (at_a if share_b >= share_a else at_b)[window]
            continue
        # the first point without a place makes one, and all points near it are its own
        left, crowd = np.arange(lo, hi + 1), []
        while len(left):
            near = p.to(int(left[0]), left) <= m.DUAL_NEAR_M
            crowd.append(left[near])
            left = left[~near]
        if len(crowd) < m.DUAL_PLACES:
            continue
        stays = [np.diff(p.t[own]) / US for own in crowd]
        if max(s[s <= m.DUAL_HELD_S].sum() / total for s in stays) < m.DUAL_SHARE:
            bad[window] = True
    return bad


class Place:
    """Points around a centre, which is the first of them."""

    __slots__ = ("centre", "members")

    def __init__(self, centre: int):
        self.centre, self.members = centre, [centre]


def places(p: Track, idx) -> list[Place]:
    """Assigns each point to its nearest centre within reach, or makes it one."""
    idx = np.asarray(idx, dtype=np.int64)
    found, centre = homes(p.lon[idx], p.lat[idx])
    out = [Place(int(i)) for i in idx[centre]]
    order = np.argsort(found, kind="stable")
    for place, own in zip(out, np.split(order, np.cumsum(np.bincount(found, minlength=len(centre)))[:-1])):
        place.members = idx[own].tolist()
    return out


def homes(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's place, and the places' centres as positions. Points are dealt out in
    blocks to the centres so far; a block is gone through anew, against the new
    centre alone, behind a point that lies within reach of none."""
    home, centre = np.zeros(len(lon), np.int32), []
    for a in range(0, len(lon), BLOCK):
        x, y = lon[a : a + BLOCK], lat[a : a + BLOCK]
        near, best = np.full(len(x), np.inf), np.zeros(len(x), np.int32)

        def meet(n: int, at: int) -> None:
            d = hav(lon[centre[n]], lat[centre[n]], x[at:], y[at:])
            closer = d < near[at:]  # of equal distances the earlier centre's counts
            near[at:][closer] = d[closer]
            best[at:][closer] = n

        for n in range(len(centre)):
            meet(n, 0)
        at = 0
        while len(far := np.flatnonzero(~(near[at:] <= m.SPLIT_NEAR_M))[:1]):
            at += int(far[0])
            centre.append(a + at)
            best[at], near[at] = len(centre) - 1, 0.0
            meet(len(centre) - 1, at + 1)
            at += 1
        home[a : a + BLOCK] = best
    return home, np.array(centre, dtype=np.int64)


def returns(p: Track, idx, found: list[Place]) -> tuple[int, set[int]]:
    """How often the track comes back to a known, distant place, and which
    places take part."""
    home = np.full(len(p), -1)
    for k, c in enumerate(found):
        home[c.members] = k
    visits = home[np.asarray(idx, dtype=np.int64)]
    visits = visits[visits >= 0]
    visits = visits[np.diff(visits, prepend=-1) != 0]  # one entry a stay
    if len(visits) < 2:
        return 0, set()
    first = np.full(len(found), len(visits))
    np.minimum.at(first, visits, np.arange(len(visits)))
    centre = np.array([c.centre for c in found])
    a, b = centre[visits[:-1]], centre[visits[1:]]
    back = (first[visits[1:]] < np.arange(1, len(visits))) & (hav(p.lon[a], p.lat[a], p.lon[b], p.lat[b]) >= m.SPLIT_APART_M)
    return int(back.sum()), {*visits[:-1][back].tolist(), *visits[1:][back].tolist()}


def _split_suspects(p: Track) -> np.ndarray:
    flags = np.zeros(len(p), dtype=bool)
    for start in range(int(p.t[0]), int(p.t[-1]) + 1, m.SPLIT_STEP_S * US):
        lo, hi = np.searchsorted(p.t, [start, start + m.SPLIT_WINDOW_S * US + 1])
        if hi - lo < 2 * m.SPLIT_MEMBERS:
            continue
        idx = np.arange(lo, hi)
        found = [c for c in places(p, idx) if len(c.members) >= m.SPLIT_MEMBERS]
        if len(found) < 2:
            continue
        count, guilty = returns(p, idx, found)
        if count >= m.SPLIT_RETURNS:
            for k in guilty:
                flags[found[k].members] = True
    return indices(flags)


def _around(p: Track, centres: list[int]) -> np.ndarray:
    """Which points lie within reach of any centre."""
    out = np.zeros(len(p), dtype=bool)
    for c in centres:
        out |= p.to(c, slice(None)) <= m.SPLIT_NEAR_M
    return out


def _split_episodes(p: Track, suspects: np.ndarray) -> list[tuple[int, int, list[int]]]:
    found = []
    for group in chained(p.t, suspects, m.SPLIT_WINDOW_S):
        seed = [c.centre for c in places(p, group) if len(c.members) >= m.SPLIT_MEMBERS]
        if len(seed) < 2:
            continue
        near, lo, hi = _around(p, seed), int(group[0]), int(group[-1])
        while lo > 0 and near[lo - 1]:
            lo -= 1
        while hi < len(p) - 1 and near[hi + 1]:
            hi += 1
        found.append((lo, hi, seed))
    merged: list[tuple[int, int, list[int]]] = []
    for lo, hi, seed in sorted(found, key=lambda e: e[0]):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], hi), merged[-1][2] + seed)
        else:
            merged.append((lo, hi, seed))
    return merged


def slot_share(p: Track, members: list[int], lo: int, hi: int) -> float:
    """Share of the quarter hours between two points in which members occur."""
    slots = int((p.t[hi] - p.t[lo]) // (m.SPLIT_SLOT_S * US)) + 1
    own = (p.t[members] - p.t[lo]) // (m.SPLIT_SLOT_S * US)
    return len(np.unique(own[(own >= 0) & (own < slots)])) / slots


def _extended(near: np.ndarray, at: int, step: int) -> int:
    """Moves an end outwards over guilty points, stepping across a few others:
    to the last guilty one before the first run of more than SPLIT_SKIP others."""
    hits = np.flatnonzero(near[at + 1 :] if step > 0 else near[:at][::-1]) + 1
    wide = np.flatnonzero(np.diff(hits, prepend=0) > m.SPLIT_SKIP + 1)
    reach = hits[: wide[0]] if len(wide) else hits
    return at + step * int(reach[-1]) if len(reach) else at


def _split_guilty(p: Track, lo: int, hi: int, seed: list[int]) -> list[int]:
    if p.t[hi] - p.t[lo] < m.SPLIT_SLOTS * m.SPLIT_SLOT_S * US:
        return []
    found = places(p, np.arange(lo, hi + 1))
    if len(found) < 2 or max(p.to(a, b) for k, a in enumerate(seed) for b in seed[k:]) > m.SPLIT_SPAN_M:
        return []
    guilty: list[Place] = []
    for _ in range(m.SPLIT_GROWTH):
        share = {id(c): slot_share(p, c.members, lo, hi) for c in found}
        found.sort(key=lambda c: -share[id(c)])
        if share[id(found[0])] >= m.SPLIT_RATIO * max(share[id(found[1])], 1e-9):
            guilty = found[1:]
            break
        guilty = found
        near = _around(p, [c.centre for c in guilty])
        new = _extended(near, lo, -1), _extended(near, hi, 1)
        if new == (lo, hi):
            break
        lo, hi = new
        found = places(p, np.arange(lo, hi + 1))
        if len(found) < 2:
            break
    return [i for c in guilty for i in c.members]


def find_split(p: Track) -> np.ndarray:
    """Places that take turns within the hour for two hours and more."""
    bad = np.zeros(len(p), dtype=bool)
    if len(p) >= m.SPLIT_POINTS and len(suspects := _split_suspects(p)):
        for episode in _split_episodes(p, suspects):
            bad[_split_guilty(p, *episode)] = True
    return bad


def find_amnesty(p: Track, snap: np.ndarray, suspect: np.ndarray, bad: np.ndarray, decoy: np.ndarray) -> np.ndarray:
    """Suspected points that a chain of on-road points ties to a free one, or
    that form a long on-road run of their own. snap: NaN where unanswered."""
    n = len(p)
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    road = np.nan_to_num(snap, nan=np.inf) <= m.AMNESTY_SNAP_M
    gap = np.abs(np.diff(p.t)) / US
    tied = (gap <= m.AMNESTY_GAP_S) & (p.steps() <= gap * m.AMNESTY_KMH / 3.6 + m.CHAIN_SLACK_M) if n > 1 else np.zeros(0, bool)
    free = ~suspect & ~bad
    # trust only ever passes between neighbours, so each scan is a run of ties
    passes = road & ~bad & ~free
    for order in (range(n), range(n - 1, -1, -1)):
        trust = False
        for i in order:
            if free[i]:
                trust = True
            elif trust:
                link = i - 1 if order.step > 0 else i
                trust = bool(passes[i] and tied[link])
                out[i] |= trust
    fits = suspect & ~bad & road
    cut = np.zeros(n, dtype=np.int64)
    cut[1:] = np.cumsum(~(fits[1:] & fits[:-1] & tied))
    for part in np.split(np.arange(n), np.flatnonzero(np.diff(cut)) + 1):
        if len(part) >= m.AMNESTY_RUN and fits[part].all() and not (decoy[part] > 0).any():
            out[part] = True
    return out


# ------------------------------------------------------------ weights


def point_weights(p: Track, snap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw, smoothed down) weights from the distances to the road."""
    known = ~np.isnan(snap)
    sigma = min(m.SIGMA_MAX_M, max(m.SIGMA_MIN_M, float(np.median(snap[known])) * m.SIGMA_FACTOR)) if known.any() else m.SIGMA_M
    raw = np.where(known, 2 * np.exp(-np.square(np.where(known, snap, 0.0)) / (2 * sigma * sigma)) - 1, 0.0)
    n = len(raw)
    smooth = np.empty(n)
    # one sorted row per point, padded at its end; a block at a time, since a row is sixty times its point
    for a in range(0, n, BLOCK):
        i = np.arange(a, min(a + BLOCK, n))
        lo = np.clip(np.searchsorted(p.t, p.t[i] - m.SMOOTH_S * US, side="left"), i - m.SMOOTH_MOST, i - m.SMOOTH_LEAST)
        hi = np.clip(np.searchsorted(p.t, p.t[i] + m.SMOOTH_S * US, side="right"), i + m.SMOOTH_LEAST + 1, i + m.SMOOTH_MOST)
        lo, hi = np.maximum(lo, 0), np.minimum(hi, n)
        at = lo[:, None] + np.arange(2 * m.SMOOTH_MOST)
        row = np.sort(np.where(at < hi[:, None], raw[np.minimum(at, n - 1)], np.inf), axis=1)
        k, size = np.arange(len(i)), hi - lo
        smooth[i] = (row[k, (size - 1) // 2] + row[k, size // 2]) / 2
    return raw, np.minimum(raw, smooth)


def build_weights(p: Track, snap: np.ndarray, trusted: np.ndarray, observed: np.ndarray, frozen: np.ndarray, split: np.ndarray, decoy: np.ndarray, airfield: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Weights of all points, and how many are under suspicion and pardoned.
    The order of the steps is part of the result."""
    raw, w = point_weights(p, snap)
    honest = trusted & (decoy <= 0)
    w = np.where(honest, np.maximum(raw, m.TRUST_W), w)
    bonus = (observed > 0) & (w > 0) & ~split
    w = np.where(bonus, w * (1 + np.log10(np.maximum(observed, 1))), w)
    _, at, count = np.unique(p.t // US, return_inverse=True, return_counts=True)
    w = np.where(w > 0, w / count[at], w)
    start = 0
    for i in range(1, len(p) + 1):
        if i < len(p) and abs(p.lon[i] - p.lon[start]) < m.SAME_SPOT_DEG and abs(p.lat[i] - p.lat[start]) < m.SAME_SPOT_DEG:
            continue
        if i - start > 1:
            part = w[start:i]
            w[start:i] = np.where(part > 0, part / (i - start), part)
        start = i
    w = np.where(frozen, np.minimum(w, 0) - m.FROZEN_W, w)
    bad = airfield | find_traps(p) | find_islands(p) | find_dual(p)
    spread = np.zeros(len(p), dtype=bool)
    for a, b in zip(np.searchsorted(p.t, p.t[bad] - m.SPREAD_S * US), np.searchsorted(p.t, p.t[bad] + m.SPREAD_S * US, side="right")):
        spread[a:b] = True
    decoyed = decoy > 0
    pardoned = find_amnesty(p, snap, spread | decoyed, bad, decoy) | (honest & ~bad)
    w = w - np.where(spread & ~pardoned, m.BAD_W, 0.0) - np.where(decoyed & ~pardoned, m.DECOY_W * decoy, 0.0) - np.where(split, m.SPLIT_W, 0.0)
    return w, int(spread.sum()), int(pardoned.sum())


# ------------------------------------------------------------ chain

Bans = dict[tuple[int, int, int, int], float]


def _code(y, x):
    """A cell as one number."""
    return (y << 32) + x


def _by_target(bans: Bans) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bans by the code of the cell that they lead to: the cells they come from, sorted, and their needs."""
    found: dict[int, list[tuple[int, float]]] = {}
    for (ya, xa, yb, xb), need in bans.items():
        found.setdefault(_code(int(yb), int(xb)), []).append((_code(int(ya), int(xa)), need))
    return {cell: (np.array([c for c, _ in sorted(rows)], dtype=np.int64), np.array([n for _, n in sorted(rows)], dtype=np.float64)) for cell, rows in found.items()}


class ChainBuilder:
    """The heaviest drivable chain of a track, for changing weights and bans."""

    def __init__(self, p: Track, lookback: int = m.LOOKBACK):
        self.p, self.lookback = p, lookback
        self.t, self.lon, self.lat = p.t.tolist(), p.lon.tolist(), p.lat.tolist()

    @cached_property
    def cell(self) -> list[tuple[int, int]]:
        y, x = cells(self.p.lon, self.p.lat)
        return list(zip(y.tolist(), x.tolist()))

    def key(self, i: int, j: int) -> tuple[int, int, int, int]:
        return self.cell[i] + self.cell[j]

    @cached_property
    def place(self) -> np.ndarray:
        """Points in space, in metres: a straight line there is no longer than ``hav``."""
        a, b = np.radians(self.p.lat), np.radians(self.p.lon)
        return m.EARTH_M * np.stack((np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)))

    @cached_property
    def code(self) -> np.ndarray:
        y, x = cells(self.p.lon, self.p.lat)
        return _code(y, x)

    def _drivable(self, i: int, j: int, bans: Bans) -> bool:
        dt = (self.t[j] - self.t[i]) / US
        if dt < 0 or bans and dt < bans.get(self.key(i, j), 0.0):
            return False
        return hav1(self.lon[i], self.lat[i], self.lon[j], self.lat[j]) <= m.CHAIN_KMH / 3.6 * dt + m.CHAIN_SLACK_M

    def _reachable(self, i: np.ndarray | slice, j: int, into: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which of the points i may lead to j: all drivable ones, and such as miss by
        little, as the line through space is shorter than the way over ground."""
        dt = (self.t[j] - self.p.t[i]) / US
        x, y, z = self.place
        reach = m.CHAIN_KMH / 3.6 * dt + (m.CHAIN_SLACK_M + 0.01)
        ok = ((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 + (z[i] - z[j]) ** 2 <= reach * reach) & (dt >= 0)
        if into and (found := into.get(int(self.code[j]))):
            source, need = found
            code = self.code[i]
            at = np.minimum(np.searchsorted(source, code), len(source) - 1)
            ok &= (source[at] != code) | (dt >= need[at])
        return ok

    def _heaviest(self, best: np.ndarray, lo: int, j: int, bans: Bans, into: dict[int, tuple[np.ndarray, np.ndarray]]) -> int:
        """Of the drivable predecessors with positive sums the heaviest, the
        nearest of equals; -1 if there is none."""
        back = best[lo:j][::-1].copy()
        tries = 0
        while True:
            k = int(back.argmax())
            if not back[k] > 0:
                return -1
            if self._drivable(j - 1 - k, j, bans):
                return j - 1 - k
            back[k] = -np.inf
            tries += 1
            if tries == 2 and len(back) > 2 * m.CHAIN_FIRST:  # the heaviest is nearly always drivable, or one of the next
                some = np.argpartition(back, -m.CHAIN_FIRST)[-m.CHAIN_FIRST :]
                back[some[~self._reachable(j - 1 - some, j, into)]] = -np.inf
            elif tries == 4:
                back[~self._reachable(slice(lo, j), j, into)[::-1]] = -np.inf

    def build(self, w: np.ndarray, bans: Bans | None = None) -> np.ndarray:
        """Positions of the chain. Beyond ``lookback`` points only the heaviest
        end so far can be continued, the latest of equals."""
        n, bans = min(len(self.p), len(w)), bans or {}
        if not n:
            return np.zeros(0, np.int64)
        best, came = np.array(w[:n], dtype=np.float64), np.full(n, -1)
        top, into = np.zeros(n, dtype=np.int64), _by_target(bans)
        for j in range(1, n):
            lo = max(0, j - self.lookback)
            i = self._heaviest(best, lo, j, bans, into)
            total = best[i] + w[j] if i >= 0 else w[j]
            if lo > 0:
                far = int(top[lo - 1])
                if best[far] + w[j] > total and self._drivable(far, j, bans):
                    i, total = far, best[far] + w[j]
            best[j], came[j] = total, i
            top[j] = j if total >= best[top[j - 1]] else top[j - 1]
        chain = [int(best.argmax())]
        while came[chain[-1]] >= 0:
            chain.append(int(came[chain[-1]]))
        return np.array(chain[::-1])


def check_stubs(p: Track, chain: np.ndarray, penalty: np.ndarray, trusted: np.ndarray) -> int:
    """Brief far visits without a trusted stop."""
    if len(chain) < 3:
        return 0
    c = p.take(chain)
    step, n = c.steps(), len(chain)
    part = np.concatenate(([0], np.cumsum(step >= m.STUB_GAP_M)))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], n) - 1
    inside = (c.t[last] - c.t[first]) / US
    travel = np.where(first > 0, (c.t[first] - c.t[np.maximum(first - 1, 0)]) / US, 0.0) + np.where(last < n - 1, (c.t[np.minimum(last + 1, n - 1)] - c.t[last]) / US, 0.0)
    path = np.bincount(part[1:], weights=np.where(np.diff(part) == 0, step, 0.0), minlength=len(first))
    safe = np.bincount(part, weights=trusted[chain], minlength=len(first)) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ~safe & (travel > 0) & (inside / (inside + travel) <= m.STUB_TIME) & (path < m.STUB_PATH_M)
    penalty[chain[hit[part]]] += m.STUB_W
    return int(hit.sum())


def lateral_g(p: Track) -> np.ndarray:
    """Sideways acceleration at every inner point, NaN where it isn't judged."""
    d1, d2, t1, t2 = p.steps()[:-1], p.steps()[1:], p.gaps()[:-1], p.gaps()[1:]
    d3 = hav(p.lon[:-2], p.lat[:-2], p.lon[2:], p.lat[2:])
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (d1 + d2) / (t1 + t2)
        s = (d1 + d2 + d3) / 2
        square = s * (s - d1) * (s - d2) * (s - d3)
        area = np.sqrt(np.maximum(square, 0))
        radius = d1 * d2 * d3 / (4 * area)
        g = np.where((square <= 0) | (area < 1e-6), 0.0, np.where(radius > 1e-6, v * v / radius / m.GRAVITY, np.nan))
        return np.where((np.minimum(d1, d2) >= m.LATERAL_LEG_M) & (t1 > 0) & (t2 > 0) & (v * 3.6 >= m.LATERAL_KMH), g, np.nan)


def check_lateral(p: Track, chain: np.ndarray, penalty: np.ndarray) -> int:
    if len(chain) < 3:
        return 0
    hit = np.nan_to_num(lateral_g(p.take(chain)), nan=0.0) >= m.LATERAL_G
    penalty[chain[1:-1][hit]] += m.LATERAL_W
    return int(hit.sum())


def check_rush(p: Track, chain: np.ndarray, penalty: np.ndarray) -> int:
    """Minutes whose path no vehicle drives; a point pays once for each."""
    n = len(chain)
    if n < 3:
        return 0
    c = p.take(chain)
    total = np.concatenate(([0.0], np.cumsum(c.steps())))
    i = np.arange(n - 1)
    j = np.searchsorted(c.t, c.t[:-1] + m.RUSH_S * US, side="right") - 1
    dt = (c.t[j] - c.t[:-1]) / US
    hit = (j > i) & (dt > 0) & (total[j] - total[i] > dt * m.CHAIN_KMH / 3.6 + m.CHAIN_SLACK_M)
    times = np.zeros(n + 1, dtype=np.int64)
    np.add.at(times, i[hit], 1)
    np.add.at(times, j[hit] + 1, -1)
    penalty[chain] += m.RUSH_W * np.cumsum(times)[:-1]
    return int(hit.sum())


def check_lonely(p: Track, chain: np.ndarray, penalty: np.ndarray) -> int:
    """Few points, long silence on both sides, and the way past them is shorter."""
    if len(chain) < 4:
        return 0
    c = p.take(chain)
    cut = np.flatnonzero(np.diff(c.t) >= m.LONELY_S * US)
    hits = 0
    for a, b in zip(cut, cut[1:]):  # points a+1 to b, silence before and after
        if b - a > m.LONELY_GROUP:
            continue
        side = min(c.to(int(a), int(a) + 1), c.to(int(b), int(b) + 1))
        if side >= m.LONELY_M and c.to(int(a), int(b) + 1) < side:
            penalty[chain[a + 1 : b + 1]] += m.LONELY_W
            hits += 1
    return hits


class RoadMemory:
    """What the passes have learned: bans, penalties, questions already asked."""

    def __init__(self, n: int):
        self.bans: Bans = {}
        self.penalty = np.zeros(n)
        self.asked: set[tuple[int, int]] = set()
        self.loops: set[tuple[int, int]] = set()


def hot_spots(p: Track, chain: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Positions of the chain that are penalised or near a long sudden jump of the track."""
    hot = penalty[chain] > 0
    if len(p) > 1:
        jump = (p.gaps() <= m.JUMP_GAP_S) & (p.steps() >= m.JUMP_M)
        marks = np.unique(np.concatenate([p.t[:-1][jump], p.t[1:][jump]]))
        if len(marks):
            k = np.searchsorted(marks, p.t[chain] - m.JUMP_NEAR_S * US)
            hot |= (k < len(marks)) & (marks[np.minimum(k, len(marks) - 1)] <= p.t[chain] + m.JUMP_NEAR_S * US)
    return indices(hot)


def road_pairs(builder: ChainBuilder, chain: np.ndarray, memory: RoadMemory) -> list[tuple[int, int]]:
    """Pairs of points whose road distance is worth asking for."""
    i, j, _ = asked_pairs(builder, chain, memory)
    return list(zip(i.tolist(), j.tolist()))


def asked_pairs(builder: ChainBuilder, chain: np.ndarray, memory: RoadMemory) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``road_pairs`` as arrays, with the pairs' distances: the steps, then those
    around each hot point; of pairs of equal times the first."""
    p, last = builder.p, len(chain) - 1
    hot = hot_spots(p, chain, memory.penalty)
    found = []

    def worth(i: np.ndarray, j: np.ndarray) -> None:
        i, j = i[i < j], j[i < j]
        d, dt = hav(p.lon[i], p.lat[i], p.lon[j], p.lat[j]), (p.t[j] - p.t[i]) / US
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = ~((d < m.ROAD_LEAST_M) | (d < m.ROAD_SHORT_M) & (dt > 0) & (d / dt * 3.6 <= m.ROAD_SHORT_KMH))
        i, j, d = i[ok], j[ok], d[ok]
        if memory.asked or memory.bans:
            new = [(builder.t[a], builder.t[b]) not in memory.asked and builder.key(a, b) not in memory.bans for a, b in zip(i.tolist(), j.tolist())]
            new = np.array(new, dtype=bool)
            i, j, d = i[new], j[new], d[new]
        found.append((i.astype(np.int32), j.astype(np.int32), d))

    for a in range(0, last, BLOCK):
        worth(chain[:-1][a : a + BLOCK], chain[1:][a : a + BLOCK])
    steps = np.array(m.HOT_STEPS)
    for a in range(0, len(hot), BLOCK):
        at = hot[a : a + BLOCK, None]
        worth(chain[np.maximum(at - steps, 0)].ravel(), chain[np.minimum(at + steps, last)].ravel())
    i, j, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    order = np.lexsort((p.t[j], p.t[i]))  # stable: of equal times the first comes first
    t_a, t_b = p.t[i[order]], p.t[j[order]]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (t_a[1:] != t_a[:-1]) | (t_b[1:] != t_b[:-1])
    keep = np.sort(order[first])
    return i[keep], j[keep], d[keep]


def check_road(builder: ChainBuilder, chain: np.ndarray, memory: RoadMemory, ask) -> int:
    """Bans pairs that the road makes too long for their time."""
    if ask is None or len(chain) < 2:
        return 0
    pairs = road_pairs(builder, chain, memory)
    hits = 0
    for (i, j), metres in zip(pairs, ask(pairs) if pairs else []):
        memory.asked.add((builder.t[i], builder.t[j]))
        dt = (builder.t[j] - builder.t[i]) / US
        if metres is None or dt > 0 and metres / dt * 3.6 <= m.ROAD_KMH:
            continue
        key = builder.key(i, j)
        memory.bans[key] = max(memory.bans.get(key, 0.0), metres / (m.ROAD_KMH / 3.6))
        memory.penalty[[i, j]] += m.ROAD_W
        hits += 1
    return hits


def loop_windows(p: Track, chain: np.ndarray) -> list[np.ndarray]:
    """Positions of the chain by half hours, each from the first point after the last."""
    t, out, a = p.t[chain], [], 0
    while a < len(chain):
        b = int(np.searchsorted(t, t[a] + m.LOOP_S * US, side="right"))
        out.append(np.arange(a, b))
        a = b
    return out


def check_loops(builder: ChainBuilder, chain: np.ndarray, memory: RoadMemory, ask) -> int:
    """Half hours that wind far more than the road between their ends."""
    if ask is None or len(chain) < m.LOOP_POINTS:
        return 0
    p, windows = builder.p, []
    for at in loop_windows(p, chain):
        own = chain[at]
        if len(own) < m.LOOP_POINTS:
            continue
        path = length(p.take(own))
        key = (builder.t[own[0]], builder.t[own[-1]])
        if path >= m.LOOP_PATH_M and key not in memory.loops:
            windows.append((own, path, key))
    hits, hot = 0, False
    answers = ask([(int(own[0]), int(own[-1])) for own, _, _ in windows]) if windows else []
    for (own, path, key), metres in zip(windows, answers):
        memory.loops.add(key)
        if metres is None:
            continue
        hot = path / max(metres, m.LOOP_FLOOR_M) > (m.LOOP_STAY if hot else m.LOOP_ENTER)
        if hot:
            memory.penalty[own] += m.LOOP_W
            hits += 1
    return hits
