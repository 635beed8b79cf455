"""Where the engine's questions about roads are answered.

A provider works on one track. ``snap`` gives each point's distance to the
road (NaN: no answer; None for all: there is no source of snaps), ``pairs`` the road distance of point pairs (None: no
answer) and ``route`` the drawn way between two points.
"""

from __future__ import annotations

import json
import logging
import random
import threading
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

from waymill import model as m
from waymill.functions import kernels as k

log = logging.getLogger("waymill")

#: Fixed value: points of a snap request that answers of "too long" don't go below.
BATCH_FLOOR = 50


@dataclass
class Route:
    distance: float
    coords: list[tuple[float, float]]
    snap_a: tuple[float, float] | None = None
    snap_b: tuple[float, float] | None = None


class NeedAnswers(Exception):
    """A provider lacks answers; ``wanted`` says which, for the next round."""

    def __init__(self, kind: str, wanted: list):
        super().__init__(kind)
        self.kind, self.wanted = kind, wanted


def shorter(plain: Route | None, hinted, line: float) -> Route | None:
    """The plain route; if that is a detour, the hinted one where it is shorter."""
    if plain is None or line <= 0 or plain.distance / line <= m.FREE_DETOUR:
        return plain
    other = hinted()
    return other if other is not None and other.distance < plain.distance else plain


@dataclass
class AnalyticRoads:
    """Roads as a function: ``factor`` times the straight distance, drawn over a
    midpoint that lies ``north`` degrees off; snaps come with the points."""

    factor: float = 1.2
    north: float = 0.01

    def snap(self, p: k.Track, snap_m: np.ndarray | None) -> np.ndarray | None:
        return None if snap_m is None else np.asarray(snap_m, dtype=np.float64)

    def pairs(self, p: k.Track, wanted: list[tuple[int, int]]) -> list[float | None]:
        i, j = np.array(wanted).T
        return (k.hav(p.lon[i], p.lat[i], p.lon[j], p.lat[j]) * self.factor).tolist()

    def route(self, p: k.Track, i: int, j: int) -> Route | None:
        middle = ((p.lon[i] + p.lon[j]) / 2, (p.lat[i] + p.lat[j]) / 2 + self.north)
        return Route(p.to(i, j) * self.factor, [(p.lon[i], p.lat[i]), middle, (p.lon[j], p.lat[j])])


def point_key(lon: float, lat: float) -> str:
    return f"{lon:.5f},{lat:.5f}"


def pair_key(p: k.Track, i: int, j: int) -> str:
    return f"{point_key(p.lon[i], p.lat[i])};{point_key(p.lon[j], p.lat[j])}"


@dataclass
class TableRoads:
    """Answers known so far, by coordinate keys; asks for the rest by raising
    ``NeedAnswers``. The engine joins what is wanted with its tables and runs
    the track again, so no table has to fit in memory."""

    snaps: dict[str, float | None] = field(default_factory=dict)
    distances: dict[str, float | None] = field(default_factory=dict)
    routes: dict[str, Route | None] = field(default_factory=dict)
    snapper: bool = True

    def snap(self, p: k.Track, snap_m: np.ndarray | None) -> np.ndarray | None:
        if snap_m is not None:
            return np.asarray(snap_m, dtype=np.float64)
        if not self.snapper:
            return None
        keys = [point_key(a, b) for a, b in zip(p.lon, p.lat)]
        if missing := sorted({x for x in keys if x not in self.snaps}):
            raise NeedAnswers("snap", missing)
        return np.array([np.nan if self.snaps[x] is None else self.snaps[x] for x in keys], dtype=np.float64)

    def pairs(self, p: k.Track, wanted: list[tuple[int, int]]) -> list[float | None]:
        keys = [pair_key(p, i, j) for i, j in wanted]
        if missing := sorted({x for x in keys if x not in self.distances}):
            raise NeedAnswers("pair", missing)
        return [self.distances[x] for x in keys]

    def route(self, p: k.Track, i: int, j: int) -> Route | None:
        return self.all_routes(p, [(i, j)])[0]

    def all_routes(self, p: k.Track, wanted: list[tuple[int, int]]) -> list[Route | None]:
        keys = [pair_key(p, i, j) for i, j in wanted]
        if missing := sorted({x for x in keys if x not in self.routes}):
            raise NeedAnswers("route", missing)
        return [self.routes[x] for x in keys]


class _Known:
    """What a process knows of a server, and its limit of requests."""

    def __init__(self, parallel: int):
        self.limit, self.batch, self.no_table = threading.BoundedSemaphore(parallel), None, False


_servers: dict[str, _Known] = {}
_servers_lock = threading.Lock()


def _process(url: str, parallel: int) -> _Known:
    with _servers_lock:
        return _servers.setdefault(url, _Known(parallel))


@dataclass
class HttpRoads:
    """A routing server with the usual /route and /table services. Answers that
    fail are missing answers, and are logged and told as ``complaints``. Faults
    are tried again after growing pauses with jitter; at most ``parallel``
    requests of a process are under way. A too long request is halved; later ones
    are halved too, down to BATCH_FLOOR points. A server without /table is asked
    pair by pair from then on."""

    url: str
    timeout_s: float = 30.0
    parallel: int = 16
    retries: int = 2
    batch: int = 400
    chunk: int = 150
    pause_s: float = 0.1

    def __post_init__(self):
        self._failed: dict[str, int] = {}

    def complaints(self) -> list[str]:
        """What failed since the last call, with counts."""
        found, self._failed = [f"{text} ({n}x)" for text, n in sorted(self._failed.items())], {}
        return found

    def _complain(self, error: Exception | str) -> None:
        text = str(error)[:200]
        self._failed[text] = self._failed.get(text, 0) + 1
        log.warning("router %s: %s", self.url, text)

    def _get(self, path: str) -> dict:
        error: Exception | None = None
        known = _process(self.url, self.parallel)
        for n in range(self.retries + 1):
            if n:
                time.sleep(self.pause_s * 2 ** (n - 1) * random.uniform(0.5, 1.5))
            try:
                with known.limit, urllib.request.urlopen(f"{self.url.rstrip('/')}{path}", timeout=self.timeout_s) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code in (400, 404, 414):
                    raise
                error = e
            except (OSError, ValueError) as e:
                error = e
        self._complain(error)
        raise ConnectionError(str(error))

    def ping(self, a: tuple[float, float] = (37.6173, 55.7558), b: tuple[float, float] = (37.6273, 55.7658)) -> bool:
        """Whether the server answers and builds routes, tried between two places that a road joins."""
        return self._route(f"{point_key(*a)};{point_key(*b)}") is not None

    def _snap_run(self, keys: list[str], depth: int = 0) -> list[float | None]:
        if len(keys) < 2:
            return [None] * len(keys)
        try:
            got = self._get(f"/route/v1/driving/{';'.join(keys)}?overview=false")["waypoints"]
            if len(got) == len(keys):
                return [w.get("distance") for w in got]
        except urllib.error.HTTPError as e:
            if e.code == 414:
                known = _process(self.url, self.parallel)
                now = known.batch or self.batch
                if len(keys) >= now > BATCH_FLOOR:  # else another request has told so already
                    known.batch = now // 2
        except (OSError, KeyError, ValueError):
            pass
        if depth >= 12 or len(keys) == 2:
            return [None] * len(keys)
        half = len(keys) // 2
        left, right = self._snap_run(keys[: half + 1], depth + 1), self._snap_run(keys[half:], depth + 1)
        return [*left[:half], left[half] if left[half] is not None else right[0], *right[1:]]

    def snap_keys(self, keys: list[str]) -> list[float | None]:
        """Distances to the road of points in order; requests share a point at their seam."""
        size = _process(self.url, self.parallel).batch or self.batch
        parts = [keys[max(0, a - 1) : a + size - 1] for a in range(0, len(keys), size - 1)]
        with ThreadPoolExecutor(self.parallel) as pool:
            got = list(pool.map(self._snap_run, parts))
        out = got[0] + [x for part in got[1:] for x in part[1:]] if got else []
        return out[: len(keys)]

    def snap(self, p: k.Track, snap_m: np.ndarray | None) -> np.ndarray:
        found = self.snap_keys([point_key(a, b) for a, b in zip(p.lon, p.lat)])
        return np.array([np.nan if x is None else x for x in found], dtype=np.float64)

    def _one_pair(self, keys: tuple[str, str]) -> float | None:
        found = []
        for a, b in (keys, keys[::-1]):
            try:
                found.append(float(self._get(f"/route/v1/driving/{a};{b}?overview=false")["routes"][0]["distance"]))
            except (OSError, KeyError, IndexError, ValueError):
                pass
        return min(found, default=None)

    def _table(self, part: list[tuple[str, str]]) -> list[float | None]:
        n = len(part)
        nodes = ";".join([a for a, _ in part] + [b for _, b in part])
        cells = self._get(f"/table/v1/driving/{nodes}?annotations=distance")["distances"]
        if len(cells) < 2 * n or any(len(row) < 2 * n for row in cells):
            return [None] * n
        return [min((x for x in (cells[i][n + i], cells[n + i][i]) if x), default=None) for i in range(n)]

    def pairs(self, p: k.Track, wanted: list[tuple[int, int]]) -> list[float | None]:
        return self.pair_keys([tuple(pair_key(p, i, j).split(";")) for i, j in wanted])

    def pair_keys(self, keys: list[tuple[str, str]]) -> list[float | None]:
        """Road distances of pairs of points, the shorter direction of each."""
        known = _process(self.url, self.parallel)
        with ThreadPoolExecutor(self.parallel) as pool:
            if known.no_table:
                return list(pool.map(self._one_pair, keys))

            def ask(part):
                try:
                    return self._table(part)
                except urllib.error.HTTPError as e:
                    return None if e.code == 404 else [None] * len(part)
                except (OSError, KeyError, ValueError):
                    return [None] * len(part)

            parts = [keys[a : a + self.chunk] for a in range(0, len(keys), self.chunk)]
            got = list(pool.map(ask, parts))
            if None in got:
                known.no_table = True
                return list(pool.map(self._one_pair, keys))
        return [x for part in got for x in part]

    def _route(self, key: str, hint: str = "") -> Route | None:
        try:
            got = self._get(f"/route/v1/driving/{key}?overview=full&geometries=geojson{hint}")
            r, ends = got["routes"][0], [w.get("location") for w in got.get("waypoints", [])]
            ends = [tuple(e) if e else None for e in [*ends, None, None][:2]]
            return Route(float(r["distance"]), [tuple(c) for c in r["geometry"]["coordinates"]], *ends)
        except (OSError, KeyError, IndexError, TypeError, ValueError):
            return None

    def route(self, p: k.Track, i: int, j: int) -> Route | None:
        turn = int(np.degrees(k.azimuth(p.lon[i], p.lat[i], p.lon[j], p.lat[j])) + 360) % 360
        return self.route_key(pair_key(p, i, j), p.to(i, j), turn)

    def route_key(self, key: str, line: float, turn: int) -> Route | None:
        """The drawn way of a pair; a detour is asked for again with the bearing from end to end."""
        return shorter(self._route(key), lambda: self._route(key, f"&bearings={turn},45;{turn},45"), line)

    def all_routes(self, p: k.Track, wanted: list[tuple[int, int]]) -> list[Route | None]:
        """The routes of all gaps, asked side by side."""
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(lambda ij: self.route(p, *ij), wanted))
