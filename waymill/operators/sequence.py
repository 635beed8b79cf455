"""Set-like rules over tracks as window expressions: no Python in the plan.

All take point rows (track_id, seq, t_us, lon, lat) and use one partitioning by
track_id, ordered by (t_us, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import geo

US = 1_000_000


def order() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("t_us", "seq")


def sorted_points(points: DataFrame) -> DataFrame:
    """Stable sort by time: ``seq`` counts anew, ``input_seq`` is the old one."""
    return points.withColumn("input_seq", F.col("seq")).withColumn("seq", (F.row_number().over(order()) - 1).cast("int"))


def steps(points: DataFrame) -> DataFrame:
    """Adds step_m and dt_s from the point before, null at a track's beginning."""
    p = points.withColumn("_lon", F.lag("lon").over(order())).withColumn("_lat", F.lag("lat").over(order()))
    p = p.withColumn("dt_s", (F.col("t_us") - F.lag("t_us").over(order())) / US)
    return p.withColumn("step_m", geo.haversine(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))).drop("_lon", "_lat")


def lengths(points: DataFrame) -> DataFrame:
    return steps(points).groupBy("track_id").agg(F.count("*").alias("points"), F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"))


def spans(points: DataFrame) -> DataFrame:
    p = points.groupBy("track_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    return p.select("track_id", geo.span(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")).alias("span_m"))


def _next(c: str, by: int = 1) -> Column:
    return F.lead(c, by).over(order())


def bearings(points: DataFrame) -> DataFrame:
    return points.withColumn("bearing_deg", geo.bearing_degrees(F.col("lon"), F.col("lat"), _next("lon"), _next("lat")))


def cross_tracks(points: DataFrame) -> DataFrame:
    """Distance of each inner point from the great circle of its neighbours."""
    before = lambda c: F.lag(c).over(order())
    return points.withColumn("off_m", geo.cross_track(F.col("lon"), F.col("lat"), before("lon"), before("lat"), _next("lon"), _next("lat")))


def jumps(points: DataFrame) -> DataFrame:
    """Points after which the track leaps faster than anything drives."""
    p = points.withColumn("d", geo.haversine(F.col("lon"), F.col("lat"), _next("lon"), _next("lat"))).withColumn("dt", (_next("t_us") - F.col("t_us")) / US)
    return p.where((F.col("d") >= m.DUAL_JUMP_M) & (F.col("dt") >= 0) & (F.col("d") / F.greatest("dt", F.lit(1.0)) * 3.6 > m.DUAL_KMH)).drop("d", "dt")


def parts(points: DataFrame, cut: Column) -> DataFrame:
    """Numbers the stretches of a track between steps for which ``cut`` holds."""
    return steps(points).withColumn("part", F.sum(F.coalesce(cut.cast("int"), F.lit(0))).over(order()))


def part_facts(cut: DataFrame) -> DataFrame:
    """One row per stretch: ends, size, inner path; and what surrounds it."""
    same = F.col("part") == F.lag("part").over(order())
    p = cut.withColumn("inner_m", F.when(same, F.col("step_m")).otherwise(0.0))
    g = p.groupBy("track_id", "part").agg(
        F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.sum("inner_m").alias("path_m"),
        *[f(c, F.struct("t_us", "seq")).alias(f"{c}{i}") for c in ("lon", "lat") for i, f in ((0, F.min_by), (1, F.max_by))],
    )
    w = Window.partitionBy("track_id").orderBy("part")
    for c in ("t1", "lon1", "lat1"):
        g = g.withColumn(f"before_{c}", F.lag(c).over(w))
    for c in ("t0", "lon0", "lat0"):
        g = g.withColumn(f"after_{c}", F.lead(c).over(w))
    return g


def islands(points: DataFrame) -> DataFrame:
    """Small, short and still stretches between far leaps; tracks of under three
    points have none."""
    whole = Window.partitionBy("track_id")
    g = part_facts(parts(points, F.col("step_m") > m.ISLAND_GAP_M)).withColumn("_all", F.sum("n").over(whole))
    return g.where((F.col("_all") >= 3) & (F.col("n") < m.ISLAND_POINTS) & (F.col("t1") - F.col("t0") < m.ISLAND_STAY_S * US) & (F.col("path_m") < m.ISLAND_PATH_M))


def stubs(points: DataFrame) -> DataFrame:
    """Brief far visits of a chain without trusted stops."""
    whole = Window.partitionBy("track_id")
    g = part_facts(parts(points, F.col("step_m") >= m.STUB_GAP_M)).withColumn("_all", F.sum("n").over(whole))
    inside = (F.col("t1") - F.col("t0")) / US
    travel = (F.coalesce(F.col("t0") - F.col("before_t1"), F.lit(0)) + F.coalesce(F.col("after_t0") - F.col("t1"), F.lit(0))) / US
    return g.where((F.col("_all") >= 3) & (travel > 0) & (inside / (inside + travel) <= m.STUB_TIME) & (F.col("path_m") < m.STUB_PATH_M))


def lonely(points: DataFrame) -> DataFrame:
    """Few points between long silences that lie off the way past them."""
    g = part_facts(parts(points, F.col("dt_s") >= m.LONELY_S))
    before = geo.haversine(F.col("before_lon1"), F.col("before_lat1"), F.col("lon0"), F.col("lat0"))
    after = geo.haversine(F.col("lon1"), F.col("lat1"), F.col("after_lon0"), F.col("after_lat0"))
    around = geo.haversine(F.col("before_lon1"), F.col("before_lat1"), F.col("after_lon0"), F.col("after_lat0"))
    near = F.least(before, after)
    return g.where(F.col("before_t1").isNotNull() & F.col("after_t0").isNotNull() & (F.col("n") <= m.LONELY_GROUP) & (near >= m.LONELY_M) & (around < near))


def lateral(points: DataFrame) -> DataFrame:
    """Adds g, the sideways acceleration at inner points, null where not judged."""
    p = steps(points).withColumn("_d2", _next("step_m")).withColumn("_t2", _next("dt_s"))
    d3 = geo.haversine(F.lag("lon").over(order()), F.lag("lat").over(order()), _next("lon"), _next("lat"))
    return p.withColumn("_d3", d3).withColumn("g", geo.lateral_g(F.col("step_m"), F.col("_d2"), F.col("_d3"), F.col("dt_s"), F.col("_t2"))).drop("_d2", "_d3", "_t2")


def rush(points: DataFrame) -> DataFrame:
    """Points that begin a minute whose path no vehicle drives, with its end. Each
    point asks at its minute's end for the last point so far, since a sliding
    frame would be read anew for every point."""
    p = steps(points).withColumn("run_m", F.sum(F.coalesce("step_m", F.lit(0.0))).over(order().rowsBetween(Window.unboundedPreceding, 0)))
    own = F.struct(F.col("t_us").alias("at"), F.lit(0).alias("asks"), F.struct("t_us", "seq", "run_m").alias("here"))
    end = F.struct((F.col("t_us") + m.RUSH_S * US).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("struct<t_us:bigint,seq:int,run_m:double>").alias("here"))
    p = p.withColumn("_e", F.explode(F.array(own.cast(_EVENT), end.cast(_EVENT)))).withColumns({"_at": F.col("_e.at"), "_asks": F.col("_e.asks")})
    so_far = Window.partitionBy("track_id").orderBy("_at", "_asks", "t_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_end", F.last("_e.here", ignorenulls=True).over(so_far)).where("_asks = 1")
    p = p.withColumns({"path_m": F.col("_end.run_m") - F.col("run_m"), "end_us": F.col("_end.t_us"), "end_seq": F.col("_end.seq")}).drop("_e", "_at", "_asks", "_end")
    dt = (F.col("end_us") - F.col("t_us")) / US
    return p.where((dt > 0) & (F.col("path_m") > dt * m.CHAIN_KMH / 3.6 + m.CHAIN_SLACK_M))


_EVENT = "struct<at:bigint,asks:int,here:struct<t_us:bigint,seq:int,run_m:double>>"


def _marked_within(mark: Column, seconds: int) -> Column:
    """Whether a marked point lies within so many seconds: the last one so far or the
    first one to come, by running frames, which read each point once."""
    marked = F.when(mark, F.col("t_us"))
    before = F.max(marked).over(order().rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("track_id").orderBy(F.desc("t_us"), F.desc("seq"))
    after = F.min(marked).over(back.rowsBetween(Window.unboundedPreceding, 0))
    near = lambda d: F.coalesce(d <= seconds * US, F.lit(False))
    return near(F.col("t_us") - before) | near(after - F.col("t_us"))


def spread(points: DataFrame, bad: str) -> DataFrame:
    """Adds spread: whether a bad point lies within ten minutes."""
    return points.withColumn("spread", _marked_within(F.col(bad), m.SPREAD_S))


def hot(points: DataFrame) -> DataFrame:
    """Adds hot: whether a sudden long jump lies within the hour."""
    p = steps(points)
    leap = (F.col("step_m") >= m.JUMP_M) & (F.col("dt_s") <= m.JUMP_GAP_S)
    p = p.withColumn("_here", F.coalesce(leap, F.lit(False)))
    p = p.withColumn("_mark", F.col("_here") | F.coalesce(_next("_here"), F.lit(False)))
    return p.withColumn("hot", _marked_within(F.col("_mark"), m.JUMP_NEAR_S)).drop("_here", "_mark")


def same_second(points: DataFrame) -> DataFrame:
    """Adds sharers: how many points of the track fall into the same second."""
    return points.withColumn("sharers", F.count("*").over(Window.partitionBy("track_id", F.floor(F.col("t_us") / US))))


def weights(points: DataFrame) -> DataFrame:
    """Adds raw and weight: from the distance to the road, and smoothed down by
    the median of the neighbours (two at least, thirty or a minute at most)."""
    sigma = points.groupBy("track_id").agg(geo.sigma_of(F.median("snap_m")).alias("sigma"))
    p = points.join(sigma, "track_id").withColumn("raw", geo.snap_weight(F.col("snap_m"), F.col("sigma")))
    p = p.withColumn("_i", F.row_number().over(order()))
    around = F.collect_list(F.struct("_i", "t_us", "raw")).over(order().rowsBetween(-m.SMOOTH_MOST, m.SMOOTH_MOST - 1))
    p = p.withColumn("_near", around)
    near = F.filter("_near", lambda x: (F.abs(x["_i"] - F.col("_i")) <= m.SMOOTH_LEAST) | (F.abs(x["t_us"] - F.col("t_us")) <= m.SMOOTH_S * US))
    p = p.withColumn("_w", F.array_sort(F.transform(near, lambda x: x["raw"])))
    n = F.size("_w")
    median = (F.element_at("_w", F.floor((n + 1) / 2).cast("int")) + F.element_at("_w", F.floor(n / 2).cast("int") + 1)) / 2
    return p.withColumn("weight", F.least("raw", median)).drop("_i", "_near", "_w")


def gaps(points: DataFrame) -> DataFrame:
    """Steps to be drawn along the road, by their first point."""
    p = points.withColumns({"b_lon": _next("lon"), "b_lat": _next("lat"), "sec": (_next("t_us") - F.col("t_us")) / US})
    p = p.withColumn("line_m", geo.haversine(F.col("lon"), F.col("lat"), F.col("b_lon"), F.col("b_lat")))
    return p.where((F.col("sec") >= m.GAP_S) & (F.col("line_m") >= m.GAP_M))


def stop_facts(points: DataFrame, stops: DataFrame) -> DataFrame:
    """Facts of stops (track_id, first, last): size, stay, span, longest inner gap, frozen."""
    # bounds of stops are ranges of seq within a track
    p = steps(points).alias("p").join(stops.alias("s"), (F.col("p.track_id") == F.col("s.track_id")) & F.col("p.seq").between(F.col("s.first"), F.col("s.last")))
    g = p.groupBy("s.track_id", "s.first", "s.last").agg(
        F.count("*").alias("n"), ((F.max("t_us") - F.min("t_us")) / US).alias("stay_s"), F.max(F.when(F.col("p.seq") > F.col("s.first"), F.col("dt_s"))).alias("gap_s"),
        geo.span(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).alias("span_m"),
    )
    return g.withColumn("frozen", (F.col("stay_s") >= m.TRUST_STAY_S) & (F.col("span_m") < m.FROZEN_SPAN_M))


def mark_airfields(points: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Adds airfield, 1 inside any of the rings of (lon, lat) corners, as the engine reads it."""
    inside = F.lit(False)
    for ring in rings:
        inside = inside | geo.in_polygon(F.col("lon"), F.col("lat"), ring)
    return points.withColumn("airfield", inside.cast("double"))
