"""The engine over a table of tracks.

One shuffle by track_id, then one kernel per track. A track is bounded by
``EngineConfig.max_points``: longer ones are told apart by a count in the same
partitioning and become failed rows without being loaded.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import kernels as k
from waymill.plans import track as one
from waymill.plans.roads import NeedAnswers, Route, TableRoads
from waymill.sources.codec import clamp_error

log = logging.getLogger("waymill")

_POINT = "struct<seq:int,input_seq:int,t_us:long,tz_off_s:int,lon:double,lat:double,synthetic:boolean,is_stop:boolean>"
_INTS = ("points_before", "points_after", "reordered", "collapsed", "stops_total", "stops_trusted", "stops_frozen", "split", "spread", "amnesty", "loops", "road_banned", "road_asked", "road_passes", "dropped", "guarded", "gaps", "filled", "added_points")
_DOUBLES = ("length_before_m", "length_after_m", "snap_median", "snap_fraction", "km_before", "km_after", "added_m")
RESULT = (
    "track_id string, status string, error string, degraded boolean, warnings array<string>, "
    + ", ".join(f"{c} int" for c in _INTS) + ", " + ", ".join(f"{c} double" for c in _DOUBLES)
    + f", reasons map<string,int>, stages string, points array<{_POINT}>, wanted array<struct<kind:string,key:string>>"
)


def _arrow_schema() -> pa.Schema:
    point = pa.struct([("seq", pa.int32()), ("input_seq", pa.int32()), ("t_us", pa.int64()), ("tz_off_s", pa.int32()), ("lon", pa.float64()), ("lat", pa.float64()), ("synthetic", pa.bool_()), ("is_stop", pa.bool_())])
    return pa.schema(
        [("track_id", pa.string()), ("status", pa.string()), ("error", pa.string()), ("degraded", pa.bool_()), ("warnings", pa.list_(pa.string()))]
        + [(c, pa.int32()) for c in _INTS] + [(c, pa.float64()) for c in _DOUBLES]
        + [("reasons", pa.map_(pa.string(), pa.int32())), ("stages", pa.string()), ("points", pa.list_(point)), ("wanted", pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string())])))]
    )


def _row(track_id: str, found: dict) -> pa.Table:
    schema = _arrow_schema()
    full = dict.fromkeys(schema.names) | {x: found[x] for x in schema.names if x in found} | {"track_id": track_id}
    full["reasons"] = sorted((found.get("reasons") or {}).items())
    full["stages"] = json.dumps(found.get("stages") or [])
    points = full.pop("points")
    names = [x for x in schema.names if x != "points"]
    row = pa.Table.from_pylist([full], schema=pa.schema([schema.field(x) for x in names]))
    kind = schema.field("points").type
    if points is None:
        return row.append_column("points", pa.nulls(1, kind)).select(schema.names)
    parts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(points, kind.value_type)], fields=list(kind.value_type))
    return row.append_column("points", pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts).cast(kind)).select(schema.names)


def _resolved(table: pa.Table, roads, config: m.EngineConfig, passes: int) -> dict:
    order = np.argsort(table.column("seq").to_numpy(), kind="stable")
    column = lambda c: table.column(c).to_numpy()[order] if c in table.column_names else None
    p, off, seq = k.Track(column("t_us"), column("lon"), column("lat")), column("tz_off_s"), column("seq")
    try:
        found = one.resolve(p, roads, config, column("snap_m"), column("decoy"), column("airfield"), passes)
    except one.Rejected as e:
        return {"status": "failed", "error": clamp_error(str(e)), "points_before": len(p), "stages": e.stages}
    t, own = found["track"], found["own"]
    # a drawn point takes the zone of the observed one before it
    zone = off[own[np.maximum.accumulate(np.where(own >= 0, np.arange(len(own)), 0))]]
    # columns in the order of the point's fields; a drawn point has no input
    input_seq = pa.array(np.where(own >= 0, seq[own], 0).astype(np.int32), mask=own < 0)
    found["points"] = (np.arange(len(own), dtype=np.int32), input_seq, t.t, zone.astype(np.int32), t.lon, t.lat, found["synthetic"].astype(bool), found["stop"].astype(bool))
    return found


def _guarded_call(table: pa.Table, roads, config, passes) -> dict:
    """A fault in one track becomes its failed row."""
    try:
        return _resolved(table, roads, config, passes)
    except NeedAnswers:
        raise
    except Exception as e:
        log.exception("track failed")
        return {"status": "failed", "error": clamp_error(f"internal error: {e}"), "points_before": table.num_rows}


def solved(table: pa.Table, roads=None, config: m.EngineConfig = m.EngineConfig()) -> dict:
    """One track, for functions over groups: what a row of ``resolve`` holds, ``points`` as arrays in the order of its fields."""
    return _guarded_call(table, roads, config, m.PASSES)


def _tracks(points: DataFrame) -> DataFrame:
    extra = [c for c in ("snap_m", "decoy", "airfield") if c in points.columns]
    cast = [F.col("track_id").cast("string").alias("track_id"), F.col("seq").cast("int").alias("seq"), F.col("t_us").cast("long").alias("t_us"), F.coalesce(F.col("tz_off_s").cast("int"), F.lit(0)).alias("tz_off_s") if "tz_off_s" in points.columns else F.lit(0).alias("tz_off_s")]
    return points.select(*cast, *(F.col(c).cast("double").alias(c) for c in ("lon", "lat", *extra)))


def _by_track(points: DataFrame) -> DataFrame:
    """Rows dealt out by track. The number is given, since kernels cost far more
    than their bytes suggest and adaptive plans would merge small partitions."""
    spark = points.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return points.repartition(n, "track_id")


def resolve(points: DataFrame, roads=None, config: m.EngineConfig = m.EngineConfig(), passes: int = m.PASSES) -> DataFrame:
    """One row (RESULT) per track of ``points`` (track_id, seq, t_us, lon, lat[,
    tz_off_s, snap_m, decoy, airfield]). Without ``roads`` cleaning is skipped
    and the row marked degraded."""
    counted = _by_track(_tracks(points)).withColumn("_n", F.count("*").over(Window.partitionBy("track_id")))
    fits = counted.where(F.col("_n") <= config.max_points).drop("_n")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _row(key[0].as_py(), _guarded_call(table, roads, config, passes))

    done = fits.groupBy("track_id").applyInArrow(run, RESULT)
    large = counted.where(F.col("_n") > config.max_points).groupBy("track_id").agg(F.count("*").cast("int").alias("points_before"))
    failed = large.withColumns({"status": F.lit("failed"), "error": F.lit("too many points")})
    return done.unionByName(failed, allowMissingColumns=True).drop("wanted")


def resolve_with_tables(points: DataFrame, keep: Callable[[DataFrame], DataFrame], snaps: DataFrame | None = None, pairs: DataFrame | None = None, routes: DataFrame | None = None, config: m.EngineConfig = m.EngineConfig(), passes: int = m.PASSES, rounds: int = 40) -> DataFrame:
    """``resolve`` against look-up tables of any size: ``snaps`` (lon, lat,
    snap_m), ``pairs`` (a_lon, a_lat, b_lon, b_lat, dist_m) and ``routes`` (the
    pair, bearing, distance, coords[, snap_a, snap_b]), keyed by coordinates
    with five decimals. Tracks run until they lack an answer; what they lack is joined
    and they run again with all answers so far, until none lacks any. ``keep``
    writes a DataFrame and reads it back, once a round. A coordinate pair that
    no table holds is a missing answer, in either direction the shorter counts."""
    from waymill.functions import geo

    spark = points.sparkSession
    tracks, schema = keep(_tracks(points)), "track_id string, kind string, key string, snap double, routes array<struct<hint:boolean,distance:double,coords:array<struct<lon:double,lat:double>>,snap_a:struct<lon:double,lat:double>,snap_b:struct<lon:double,lat:double>>>"
    pair_key = F.concat_ws(";", geo.coordinate_key(F.col("a_lon"), F.col("a_lat")), geo.coordinate_key(F.col("b_lon"), F.col("b_lat")))
    back_key = F.concat_ws(";", geo.coordinate_key(F.col("b_lon"), F.col("b_lat")), geo.coordinate_key(F.col("a_lon"), F.col("a_lat")))
    parts = []
    if snaps is not None:
        parts.append(snaps.groupBy(F.lit("snap").alias("kind"), geo.coordinate_key(F.col("lon"), F.col("lat")).alias("key")).agg(F.min("snap_m").alias("value")))
    if pairs is not None:
        valid = pairs.select(F.explode(F.array(pair_key, back_key)).alias("key"), F.when(F.col("dist_m") > 0, F.col("dist_m")).alias("dist_m"))
        parts.append(valid.groupBy(F.lit("pair").alias("kind"), "key").agg(F.min("dist_m").alias("value")))
    whole, values = tracks, None
    for part in parts:
        values = part if values is None else values.unionByName(part)
    answers = spark.createDataFrame([], schema)
    finished, snapper = None, snaps is not None

    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _arrow_schema().empty_table()
        local = TableRoads(snapper=snapper)
        for r in known.to_pylist():
            if r["kind"] == "route":
                local.routes[r["key"]] = _route_of(r["routes"], r["key"])
            else:
                (local.snaps if r["kind"] == "snap" else local.distances)[r["key"]] = r["snap"]
        try:
            return _row(key[0].as_py(), _guarded_call(table, local, config, passes))
        except NeedAnswers as e:
            return _row(key[0].as_py(), {"status": "asking", "wanted": [{"kind": e.kind, "key": x} for x in e.wanted]})

    for _ in range(rounds):
        counted = _by_track(tracks).withColumn("_n", F.count("*").over(Window.partitionBy("track_id")))
        fits = counted.where(F.col("_n") <= config.max_points).drop("_n")
        out = keep(fits.groupBy("track_id").cogroup(answers.groupBy("track_id")).applyInArrow(run, RESULT))
        done = out.where("status <> 'asking'")
        finished = done if finished is None else finished.unionAll(done)
        asking = out.where("status = 'asking'").select("track_id", F.explode("wanted").alias("w")).select("track_id", "w.kind", "w.key")
        if not asking.limit(1).count():
            break
        got = asking.join(values, ["kind", "key"], "left") if values is not None else asking.withColumn("value", F.lit(None).cast("double"))
        if routes is not None:
            drawn = routes.select(pair_key.alias("key"), F.struct(F.col("bearing").isNotNull().alias("hint"), F.col("distance").cast("double").alias("distance"), "coords", *(F.col(c) if c in routes.columns else F.lit(None).cast("struct<lon:double,lat:double>").alias(c) for c in ("snap_a", "snap_b"))).alias("r"))
            drawn = drawn.groupBy("key").agg(F.collect_list("r").alias("routes")).withColumn("kind", F.lit("route"))
            got = got.join(drawn, ["kind", "key"], "left")
        else:
            got = got.withColumn("routes", F.lit(None).cast("array<struct<hint:boolean,distance:double,coords:array<struct<lon:double,lat:double>>,snap_a:struct<lon:double,lat:double>,snap_b:struct<lon:double,lat:double>>>"))
        answers = keep(answers.unionByName(got.select("track_id", "kind", "key", F.col("value").alias("snap"), "routes")))
        tracks = keep(tracks.join(asking.select("track_id").distinct(), "track_id", "left_semi"))  # cuts the lineage of the rounds
    else:
        raise RuntimeError("tracks still ask after all rounds")
    counted = whole.groupBy("track_id").agg(F.count("*").cast("int").alias("points_before"))
    failed = counted.where(F.col("points_before") > config.max_points).withColumns({"status": F.lit("failed"), "error": F.lit("too many points")})
    return finished.unionByName(failed, allowMissingColumns=True).drop("wanted")


def _route_of(found: list[dict] | None, key: str) -> Route | None:
    from waymill.plans.roads import shorter

    def made(r: dict) -> Route:
        end = lambda e: None if e is None or e["lon"] is None else (e["lon"], e["lat"])
        return Route(r["distance"], [(c["lon"], c["lat"]) for c in r["coords"] or []], end(r["snap_a"]), end(r["snap_b"]))

    plain = min((made(r) for r in found or [] if not r["hint"]), key=lambda r: r.distance, default=None)
    hinted = min((made(r) for r in found or [] if r["hint"]), key=lambda r: r.distance, default=None)
    (x1, y1), (x2, y2) = (tuple(map(float, end.split(","))) for end in key.split(";"))
    return shorter(plain, lambda: hinted, k.hav1(x1, y1, x2, y2))


def points_of(results: DataFrame) -> DataFrame:
    """The cleaned points of finished tracks, one row each."""
    return results.where("status = 'done'").select("track_id", F.explode("points").alias("p")).select("track_id", "p.*")


def stage_stats(results: DataFrame) -> DataFrame:
    """(track_id, at, stage, points_before, points_after, elapsed_ms, extra, error) of
    every stage run, those of failed tracks too; error is why a stage failed."""
    kind = "array<struct<name:string,pointsBefore:int,pointsAfter:int,elapsedMs:double,extra:map<string,string>,error:string>>"
    s = results.select("track_id", F.posexplode(F.from_json("stages", kind)).alias("at", "s"))
    return s.select("track_id", "at", F.col("s.name").alias("stage"), F.col("s.pointsBefore").alias("points_before"), F.col("s.pointsAfter").alias("points_after"), F.col("s.elapsedMs").alias("elapsed_ms"), F.to_json("s.extra").alias("extra"), F.col("s.error").alias("error"))


def _bounded(points: DataFrame) -> DataFrame:
    """Points dealt out by track; a track of more than MOST_POINTS ends the query
    with an error before any worker loads it. The check stands in a filter: a new
    ``track_id`` would hide from Spark how the rows are dealt out."""
    n = F.count("*").over(Window.partitionBy("track_id"))
    too_long = F.raise_error(F.format_string("track %s has more than %d points", "track_id", F.lit(MOST_POINTS)))
    counted = _by_track(points).withColumn("_n", n)
    return counted.where(F.when(F.col("_n") <= MOST_POINTS, F.lit(True)).otherwise(too_long.cast("boolean"))).drop("_n")


#: Points of a track that a single rule is run on at most; the engine itself has ``EngineConfig.max_points``.
MOST_POINTS = 5_000_000

KernelFn = Callable[[k.Track], np.ndarray]


def flagged(points: DataFrame, kernel: KernelFn, column: str) -> DataFrame:
    """Point rows with a kernel's verdict per point as a boolean column."""
    return _per_track(points, lambda p, _: kernel(p).astype(bool), column, "boolean", pa.bool_())


def kept(points: DataFrame, kernel: KernelFn) -> DataFrame:
    """The point rows that a packing kernel keeps."""

    def flags(p: k.Track, _) -> np.ndarray:
        out = np.zeros(len(p), dtype=bool)
        out[kernel(p)] = True
        return out

    return _per_track(points, flags, "_kept", "boolean", pa.bool_()).where("_kept").drop("_kept")


def _per_track(points: DataFrame, fn, column: str, kind: str, arrow) -> DataFrame:
    schema = f"track_id string, seq int, t_us long, lon double, lat double, {column} {kind}"
    slim = points.select("track_id", F.col("seq").cast("int").alias("seq"), "t_us", "lon", "lat")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t_us", "ascending"), ("seq", "ascending")])
        p = k.Track(table.column("t_us").to_numpy(), table.column("lon").to_numpy(), table.column("lat").to_numpy())
        return table.append_column(column, pa.array(fn(p, table), arrow))

    return _bounded(slim).groupBy("track_id").applyInArrow(run, schema)


def grouped(points: DataFrame, fn: Callable[[k.Track, pa.Table], list[dict] | dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of each track (sorted by time), with track_id. Rules with
    a row for each point give columns, since a row as a dict is ten times as large."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    slim = points.select("track_id", F.col("seq").cast("int").alias("seq"), "t_us", "lon", "lat", *[c for c in ("snap_m",) if c in points.columns])

    def run(key: tuple, batches: Iterator[pa.Table] | pa.Table) -> pa.Table:
        table = batches.sort_by([("t_us", "ascending"), ("seq", "ascending")])
        p = k.Track(table.column("t_us").to_numpy(), table.column("lon").to_numpy(), table.column("lat").to_numpy())
        rows = fn(p, table)
        columns = rows if isinstance(rows, dict) else {name: [r[name] for r in rows] for name in names}
        size = len(columns[names[0]])
        arrays = {"track_id": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), size)}
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        for name, part in zip(names, schema.split(",")):
            arrays[name] = pa.array(columns[name], kinds[part.strip().split(" ")[1]])
        return pa.table(arrays)

    return _bounded(slim).groupBy("track_id").applyInArrow(run, f"track_id string, {schema}")
