"""The engine with its roads in stages across tracks.

``resolve_in_stages`` gives what ``engine.resolve`` gives, with every question
about roads asked by a stage over all tracks: places are snapped once for all
points that share them, the chain is chosen in rounds over tables, and gaps are
drawn by joins. Folds over one track (order, stops, weights, packing) are
grouped functions between the stages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import geo
from waymill.functions import kernels as k
from waymill.operators import sequence as s
from waymill.plans import rounds, weave
from waymill.plans.track import CUT_SHORT

Keep = Callable[[DataFrame], DataFrame]

PREPARED = (
    "track_id string, seq int, input_seq int, t_us long, tz_off_s int, lon double, lat double, stop_size int, trustworthy boolean, frozen boolean, split boolean, "
    "decoy double, airfield double, reordered int, points int, stops int, km_before double, length_before_m double"
)
WEIGHED = PREPARED + ", snap_m double, w double, trusted boolean, spread int, amnesty int"
PACKED = "track_id string, seq int, input_seq int, t_us long, tz_off_s int, lon double, lat double, is_stop boolean, guarded int, km_after double"


@dataclass
class Resolved:
    """``report``: a row a track; ``points``: the rows of finished tracks;
    ``rounds``: what each round of the choice handled."""

    report: DataFrame
    points: DataFrame
    rounds: list[dict]


def _track(table: pa.Table) -> k.Track:
    return k.Track(*(table.column(c).to_numpy() for c in ("t_us", "lon", "lat")))


def prepared(points: DataFrame) -> DataFrame:
    """Points in order, without those that lie in stops: a row for each point that
    stays, with what its stop and the track say about it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("t_us", "ascending"), ("seq", "ascending")])
        p = _track(table)
        length = k.length(k.Track(p.t, p.lon, p.lat).take(np.argsort(table.column("seq").to_numpy(), kind="stable")))
        n, perm = len(p), k.reorder(p)
        work, table = p.take(perm), table.take(pa.array(perm))
        stops = k.find_stops(work)
        alive = np.ones(n, dtype=bool)
        for a, b in stops:
            alive[a + 1 : b + 1] = False
        at = k.indices(alive)
        size, worthy, frozen = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, bool)
        for a, b in stops:
            size[a] = b - a + 1
            worthy[a] = k.trusted_stop(work, a, b, None)
            frozen[a] = work.t[b] - work.t[a] >= m.TRUST_STAY_S * k.US and k.is_frozen(work, a, b)
        reordered = int((perm != np.arange(n)).sum())
        split = np.zeros(len(at), dtype=bool)
        if len(at) >= 4:
            split = k.find_split(work)
            if reordered:
                split |= k.find_split(p)[perm]
            split = 2 * np.add.reduceat(split.astype(np.int64), at) > np.maximum(size[at], 1)
        table, rows = table.take(pa.array(at)), len(at)
        column = lambda c, fill: np.nan_to_num(table.column(c).to_numpy().astype(float), nan=fill)
        same = lambda x, t: pa.array(np.full(rows, x), t)
        made = [
            table.column("track_id"), pa.array(np.arange(rows), pa.int32()), table.column("seq"), table.column("t_us"), table.column("tz_off_s"), table.column("lon"), table.column("lat"),
            pa.array(size[at], pa.int32()), pa.array(worthy[at]), pa.array(frozen[at]), pa.array(split), pa.array(column("decoy", 0.0)), pa.array(column("airfield", 0.0)),
            same(reordered, pa.int32()), same(n, pa.int32()), same(len(stops), pa.int32()), same(k.length(work) / 1000, pa.float64()), same(length, pa.float64()),
        ]
        return pa.table(made, names=[c.split(" ")[0] for c in PREPARED.split(", ")])

    return rounds.dealt(points).groupBy("track_id").applyInArrow(run, PREPARED)


def snapped(points: DataFrame, snaps: Callable[[DataFrame], DataFrame], keep: Keep) -> DataFrame:
    """``points`` with snap_m and fault. A place is asked for once, however many
    points of however many tracks stand there."""
    p = points.withColumn("key", geo.coordinate_key(F.col("lon"), F.col("lat")))
    places = p.groupBy("key").agg(F.min(F.struct("track_id", "seq", "lon", "lat")).alias("first")).select("key", "first.*")
    return p.join(keep(snaps(places)), "key", "left").drop("key")


def weighed(points: DataFrame) -> DataFrame:
    """Adds weights and which stops are trusted."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        column = lambda c: table.column(c).to_numpy()
        snap, size = column("snap_m").astype(float), column("stop_size").astype(np.int64)
        trusted = column("trustworthy") & ~(snap > m.TRUST_SNAP_M)
        w, spread, amnesty = k.build_weights(_track(table), snap, trusted, size, column("frozen"), column("split"), column("decoy"), column("airfield") > 0)
        n = table.num_rows
        for name, x in (("w", pa.array(w)), ("trusted", pa.array(trusted)), ("spread", pa.array([spread] * n, pa.int32())), ("amnesty", pa.array([amnesty] * n, pa.int32()))):
            table = table.append_column(name, x)
        return table

    return rounds.dealt(points).groupBy("track_id").applyInArrow(run, WEIGHED)


def packed(chain: DataFrame, config: m.EngineConfig) -> DataFrame:
    """Chains (track_id, seq, input_seq, t_us, tz_off_s, lon, lat, is_stop) thinned
    by the packing rules; seq counts anew."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        full, stop = _track(table), table.column("is_stop").to_numpy()
        km, own = k.length(full) / 1000, np.arange(len(full))
        for rule in (lambda p: k.deduplicate(p, config.dedup_m, config.dedup_s), lambda p: k.collapse_stops(p, config.stop_m, config.stop_points), lambda p: k.simplify(p, config.simplify_m, stop[own])):
            if len(own) >= 2:
                own = own[rule(full.take(own))]
        before = len(own)
        if len(own) >= 2:
            own = k.guard(full, own)
        table, n = table.take(pa.array(own)), len(own)
        table = table.set_column(table.column_names.index("seq"), "seq", pa.array(np.arange(n), pa.int32()))
        return table.append_column("guarded", pa.array([n - before] * n, pa.int32())).append_column("km_after", pa.array([km] * n))

    return rounds.dealt(chain).groupBy("track_id").applyInArrow(run, PACKED)


def _first_of(df: DataFrame, *names: str) -> DataFrame:
    """Track-wide values that every row of a track carries."""
    return df.groupBy("track_id").agg(*(F.max(c).alias(c) for c in names))


def resolve_in_stages(points: DataFrame, provider, keep: Keep | None = None, config: m.EngineConfig = m.EngineConfig(), passes: int = m.PASSES) -> Resolved:
    """Cleans, packs and redraws all tracks of ``points`` (track_id, seq, t_us, lon,
    lat[, tz_off_s, snap_m, decoy, airfield]). Where the points bring ``snap_m``,
    no place is snapped. Tracks of more than ``max_points`` fail without being
    loaded, tracks with too few snaps or points fail alone. Router faults mark the
    tracks that asked as degraded."""
    spark = points.sparkSession
    keep = keep or rounds.keeper(spark)
    cast = lambda c, t, fill: F.coalesce(F.col(c).cast(t), F.lit(fill)).alias(c) if c in points.columns else F.lit(fill).cast(t).alias(c)
    slim = points.select(F.col("track_id").cast("string").alias("track_id"), F.col("seq").cast("int").alias("seq"), F.col("t_us").cast("long").alias("t_us"), cast("tz_off_s", "int", 0), *(F.col(c).cast("double").alias(c) for c in ("lon", "lat")), cast("decoy", "double", 0.0), cast("airfield", "double", 0.0), *([F.col("snap_m").cast("double").alias("snap_m")] if "snap_m" in points.columns else []))
    own_snaps = slim.select("track_id", F.col("seq").alias("input_seq"), "snap_m") if "snap_m" in slim.columns else None
    counted = rounds.dealt(slim.drop("snap_m")).withColumn("_n", F.count("*").over(Window.partitionBy("track_id")))
    large = counted.where(F.col("_n") > config.max_points).groupBy("track_id").agg(F.count("*").cast("int").alias("points_before"))
    sub = keep(prepared(counted.where(F.col("_n") <= config.max_points).drop("_n")))
    if own_snaps is not None:
        sub = sub.join(own_snaps, ["track_id", "input_seq"], "left").withColumn("fault", F.lit(None).cast("string"))
    elif not provider.snapper:
        sub = sub.withColumns({"snap_m": F.lit(None).cast("double"), "fault": F.lit(None).cast("string")})
    else:
        few = sub.groupBy("track_id").agg(F.count("*").alias("_n")).where("_n >= 4").select("track_id")
        sub = snapped(sub.join(few, "track_id", "left_semi"), provider.snaps, keep).unionByName(sub.join(few, "track_id", "left_anti"), allowMissingColumns=True)
    sub = keep(sub)
    facts = sub.groupBy("track_id").agg(
        F.count("*").cast("int").alias("alive"), F.count("snap_m").alias("known"), F.median("snap_m").alias("snap_median"), F.max("fault").alias("snap_fault"),
        *(F.max(c).alias(c) for c in ("reordered", "points", "stops", "km_before", "length_before_m")), F.sum(F.col("frozen").cast("int")).cast("int").alias("stops_frozen"), F.sum(F.col("split").cast("int")).cast("int").alias("split"),
    )
    snapper = F.lit(own_snaps is not None or provider.snapper)
    long = F.col("alive") >= 4  # shorter ones aren't judged at all
    facts = facts.withColumns({"short": ~long, "snap_fraction": F.when(long & snapper, F.col("known") / F.col("alive")).otherwise(0.0), "snap_median": F.when(long, F.coalesce("snap_median", F.lit(0.0))).otherwise(0.0), "stops_frozen": F.when(long, F.col("stops_frozen")).otherwise(0)})
    facts = keep(facts.withColumn("unsnapped", ~F.col("short") & snapper & (F.col("snap_fraction") < m.SNAP_LEAST)))
    judge = sub.join(facts.where("not short and not unsnapped").select("track_id"), "track_id", "left_semi")
    columns = [c.split(" ")[0] for c in PREPARED.split(", ")]
    heavy = keep(weighed(judge.select(*columns, "snap_m")))
    chosen = rounds.pick(heavy.select("track_id", "seq", "t_us", "lon", "lat", "w", "trusted"), provider.distances, keep, passes)
    kept = ["track_id", "seq", "input_seq", "t_us", "tz_off_s", "lon", "lat"]
    # a stop is known by second and place
    chain = heavy.join(chosen.chain, ["track_id", "seq"], "left_semi").select(*kept, (F.col("stop_size") > 0).alias("is_stop"))
    place = ["track_id", F.floor(F.col("t_us") / s.US), "lon", "lat"]
    chain = chain.withColumn("is_stop", F.max("is_stop").over(Window.partitionBy(*place)))
    short = sub.join(facts.where("short").select("track_id"), "track_id", "left_semi").select(*kept, F.lit(False).alias("is_stop"))
    pack = keep(packed(chain.unionAll(short), config))
    enough = pack.groupBy("track_id").agg(F.count("*").cast("int").alias("packed"), F.max("guarded").alias("guarded"), F.max("km_after").alias("km_after"))
    drawn = weave.draw(pack.join(enough.where("packed >= 2").select("track_id"), "track_id", "left_semi").select("track_id", "seq", "t_us", "lon", "lat", "is_stop"), provider.routes, keep)
    woven = drawn.points.join(pack.select("track_id", "seq", F.lit(0).alias("corner"), "input_seq"), ["track_id", "seq", "corner"], "left").join(pack.select("track_id", "seq", "tz_off_s"), ["track_id", "seq"])
    order = Window.partitionBy("track_id").orderBy("seq", "corner")
    out = keep(woven.select("track_id", (F.row_number().over(order) - 1).cast("int").alias("seq"), "input_seq", "t_us", "tz_off_s", "lon", "lat", (F.col("corner") > 0).alias("synthetic"), "is_stop"))
    lengths = s.steps(out).groupBy("track_id").agg(F.count("*").cast("int").alias("points_after"), F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_after_m"), F.sum(F.col("synthetic").cast("int")).cast("int").alias("added_points"))
    accepted = F.col("verdict") == "accepted"
    filled = drawn.gaps.groupBy("track_id").agg(F.count("*").cast("int").alias("gaps"), F.sum(accepted.cast("int")).cast("int").alias("filled"), F.coalesce(F.sum(F.when(accepted, F.col("distance") - F.col("line_m"))), F.lit(0.0)).alias("added_m"), F.max("fault").alias("route_fault"))
    weights = heavy.groupBy("track_id").agg(F.max("spread").alias("spread"), F.max("amnesty").alias("amnesty"), F.sum(F.col("trusted").cast("int")).cast("int").alias("stops_trusted"))
    picked = chosen.report.join(chosen.chain.groupBy("track_id").agg(F.count("*").cast("int").alias("chain")), "track_id")
    r = facts
    for part in (weights, picked, enough, filled, lengths):
        r = r.join(part, "track_id", "left")
    few = F.coalesce(F.col("points_after"), F.col("packed"), F.lit(0)) < 2
    wrong = F.when(F.col("unsnapped"), F.format_string("snaps are known for %.0f%% of %d points, %.0f%% are needed", F.col("snap_fraction") * 100, F.col("alive"), F.lit(100 * m.SNAP_LEAST))).when(few, F.lit("too few points after processing"))
    faults = F.array_compact(F.array("snap_fault", F.when(F.col("failed") > 0, F.format_string("%d road distances", "failed")), "route_fault"))
    warnings = F.concat(F.when(F.coalesce("cut_short", F.lit(False)), F.array(F.lit(CUT_SHORT))).otherwise(F.array().cast("array<string>")), F.transform(faults, lambda x: F.concat(F.lit("the router failed: "), x)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    r = r.withColumns({"error": wrong, "warnings": warnings})
    report = r.select(
        "track_id", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", (F.size("warnings") > 0).alias("degraded"), "warnings", F.col("points").alias("points_before"), "points_after",
        "reordered", F.col("stops").alias("stops_total"), zero("stops_trusted"), "stops_frozen", (F.col("points") - F.col("alive")).alias("collapsed"), "split", zero("spread"), zero("amnesty"), zero("loops"), zero("road_banned"),
        zero("road_asked"), zero("road_passes"), F.when(F.col("short"), 0).otherwise(F.col("alive") - F.col("chain")).cast("int").alias("dropped"), zero("guarded"), zero("gaps"), zero("filled"), zero("added_points"),
        "length_before_m", "length_after_m", "km_before", F.when(F.col("short"), F.col("km_before")).otherwise(F.col("km_after")).alias("km_after"), F.coalesce("added_m", F.lit(0.0)).alias("added_m"), "snap_median", "snap_fraction",
    )
    failed = large.withColumns({"status": F.lit("failed"), "error": F.lit("too many points"), "degraded": F.lit(False)})
    done = report.where("status = 'done'").select("track_id")
    return Resolved(report.unionByName(failed, allowMissingColumns=True), out.join(done, "track_id", "left_semi"), chosen.rounds)
