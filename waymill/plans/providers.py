"""Road answers as stages over DataFrames.

A provider answers questions of all tracks at once. It takes a DataFrame of
distinct questions and gives one row an answer:

* ``snaps``: (key, lon, lat, track_id, seq) to (key, snap_m, fault),
* ``distances``: (key, a_lon, a_lat, b_lon, b_lat) to (key, dist_m, fault),
* ``routes``: the same with line_m and turn to (key, distance, coords, snap_a, snap_b, fault).

Keys are coordinates with five decimals, as a router is asked. A question
without answer has nulls; ``fault`` says what went wrong with the router.
``snapper`` tells whether there is a source of snaps at all: without one no
point is held to have none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import geo
from waymill.plans.roads import HttpRoads

CORNER = "struct<lon:double,lat:double>"
_ARROW_CORNER = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
SNAP = "key string, snap_m double, fault string"
DISTANCE = "key string, dist_m double, fault string"
ROUTE = f"key string, distance double, coords array<{CORNER}>, snap_a {CORNER}, snap_b {CORNER}, fault string"


def pair_key(a_lon: str = "a_lon", a_lat: str = "a_lat", b_lon: str = "b_lon", b_lat: str = "b_lat") -> Column:
    return F.concat_ws(";", geo.coordinate_key(F.col(a_lon), F.col(a_lat)), geo.coordinate_key(F.col(b_lon), F.col(b_lat)))


@dataclass
class FormulaProvider:
    """Roads as a formula over the coordinates of the keys: ``factor`` times the
    straight distance, drawn over ``corners`` inner points that bend ``north``
    degrees off it. Points are snapped where they stand, at ``snap_m`` metres."""

    factor: float = 1.2
    north: float = 0.01
    corners: int = 1
    snap_m: float | None = 5.0

    @property
    def snapper(self) -> bool:
        return self.snap_m is not None

    def snaps(self, wanted: DataFrame) -> DataFrame:
        return wanted.select("key", F.lit(self.snap_m).cast("double").alias("snap_m"), F.lit(None).cast("string").alias("fault"))

    def distances(self, wanted: DataFrame) -> DataFrame:
        at = lambda i: F.split("key", "[,;]")[i].cast("double")
        return wanted.select("key", (geo.haversine(at(0), at(1), at(2), at(3)) * self.factor).alias("dist_m"), F.lit(None).cast("string").alias("fault"))

    def routes(self, wanted: DataFrame) -> DataFrame:
        n = self.corners + 1
        corner = lambda k: F.struct((F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * k / n).alias("lon"), (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * k / n + F.when((k > 0) & (k < n), self.north * (1 + k % 2)).otherwise(0.0)).alias("lat"))
        none = F.lit(None).cast(CORNER)
        return wanted.select(
            "key", (geo.haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")) * self.factor).alias("distance"),
            F.transform(F.sequence(F.lit(0), F.lit(n)), corner).alias("coords"), none.alias("snap_a"), none.alias("snap_b"), F.lit(None).cast("string").alias("fault"),
        )


@dataclass
class TableProvider:
    """Answers from tables of any size, joined by key: ``snap`` (lon, lat, snap_m),
    ``pair`` (a_lon, a_lat, b_lon, b_lat, dist_m) in either direction, the shorter
    counts, and ``route`` (the pair, bearing, distance, coords[, snap_a, snap_b]):
    the shortest without bearing; where that is a detour, the shortest with one
    if it is shorter still."""

    snap: DataFrame | None = None
    pair: DataFrame | None = None
    route: DataFrame | None = None

    @property
    def snapper(self) -> bool:
        return self.snap is not None

    def snaps(self, wanted: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string").alias("fault")
        if self.snap is None:
            return wanted.select("key", F.lit(None).cast("double").alias("snap_m"), none)
        known = self.snap.groupBy(geo.coordinate_key(F.col("lon"), F.col("lat")).alias("key")).agg(F.min("snap_m").alias("snap_m"))
        return wanted.select("key").join(known, "key", "left").select("key", "snap_m", none)

    def distances(self, wanted: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string").alias("fault")
        if self.pair is None:
            return wanted.select("key", F.lit(None).cast("double").alias("dist_m"), none)
        both = self.pair.where("dist_m > 0").select(F.explode(F.array(pair_key(), pair_key("b_lon", "b_lat", "a_lon", "a_lat"))).alias("key"), F.col("dist_m").cast("double").alias("dist_m"))
        return wanted.select("key").join(both.groupBy("key").agg(F.min("dist_m").alias("dist_m")), "key", "left").select("key", "dist_m", none)

    def routes(self, wanted: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string").alias("fault")
        if self.route is None:
            return wanted.select("key", *(F.lit(None).cast(t).alias(c) for c, t in (("distance", "double"), ("coords", f"array<{CORNER}>"), ("snap_a", CORNER), ("snap_b", CORNER))), none)
        end = lambda c: F.col(c).cast(CORNER) if c in self.route.columns else F.lit(None).cast(CORNER)
        drawn = F.struct(F.col("distance").cast("double").alias("distance"), F.col("coords").cast(f"array<{CORNER}>").alias("coords"), end("snap_a").alias("snap_a"), end("snap_b").alias("snap_b"))
        known = self.route.select(pair_key().alias("key"), F.col("bearing").isNotNull().alias("hint"), drawn.alias("r"))
        best = lambda hint: F.min_by(F.when(F.col("hint") == hint, F.col("r")), F.when(F.col("hint") == hint, F.col("r.distance")))
        known = known.groupBy("key").agg(best(False).alias("plain"), best(True).alias("hinted"))
        detour = (F.col("line_m") > 0) & (F.col("plain.distance") / F.col("line_m") > m.FREE_DETOUR) & (F.col("hinted.distance") < F.col("plain.distance"))
        found = wanted.select("key", "line_m").join(known, "key", "left").withColumn("r", F.when(detour, F.col("hinted")).otherwise(F.col("plain")))
        return found.select("key", "r.*", none)


@dataclass
class HttpProvider:
    """A routing server. Questions are dealt over ``requests`` partitions and each
    task waits for one answer before it asks again, so no more requests than that
    are under way, however many executors the cluster has (speculative copies of a
    task would come on top). Neighbours on a track are asked together."""

    url: str
    requests: int = 16
    settings: dict = field(default_factory=dict)
    snapper: bool = True

    def _asked(self, wanted: DataFrame, order: list[str], ask: Callable[[HttpRoads, dict], list], schema: str, fields: list[tuple[str, pa.DataType]], size: int) -> DataFrame:
        url, settings = self.url, self.settings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = HttpRoads(url, parallel=1, **settings)
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    rows = batch.slice(at, size).to_pydict()
                    answers = ask(client, rows)
                    fault = "; ".join(client.complaints()) or None
                    columns = [[None if x is None else x[k] for x in answers] for k in range(len(fields))]
                    arrays = [pa.array(rows["key"], pa.string()), *(pa.array(c, t) for c, (_, t) in zip(columns, fields)), pa.array([fault if x is None else None for x in answers], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", *(n for n, _ in fields), "fault"])

        return wanted.repartitionByRange(self.requests, *order).sortWithinPartitions(*order).mapInArrow(run, schema)

    def snaps(self, wanted: DataFrame) -> DataFrame:
        # several requests' points at a time, so that seams within them are shared
        ask = lambda client, rows: [None if x is None else (x,) for x in client.snap_keys(rows["key"])]
        return self._asked(wanted.select("key", "track_id", "seq"), ["track_id", "seq", "key"], ask, SNAP, [("snap_m", pa.float64())], 4000)

    def distances(self, wanted: DataFrame) -> DataFrame:
        ask = lambda client, rows: [None if x is None else (x,) for x in client.pair_keys([tuple(key.split(";")) for key in rows["key"]])]
        return self._asked(wanted.select("key"), ["key"], ask, DISTANCE, [("dist_m", pa.float64())], 600)

    def routes(self, wanted: DataFrame) -> DataFrame:
        def ask(client: HttpRoads, rows: dict) -> list:
            found = [client.route_key(*x) for x in zip(rows["key"], rows["line_m"], rows["turn"])]
            corner = lambda c: None if c is None else {"lon": c[0], "lat": c[1]}
            return [None if r is None else (r.distance, [corner(c) for c in r.coords], corner(r.snap_a), corner(r.snap_b)) for r in found]

        fields = [("distance", pa.float64()), ("coords", pa.list_(_ARROW_CORNER)), ("snap_a", _ARROW_CORNER), ("snap_b", _ARROW_CORNER)]
        return self._asked(wanted.select("key", "line_m", "turn"), ["key"], ask, ROUTE, fields, 50)
