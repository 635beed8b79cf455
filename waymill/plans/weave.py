"""Roads drawn into the gaps of tracks, as joins, windows and generated rows.

Gaps are steps to be drawn. Their routes are asked for by coordinate key, each
once for all tracks, and judged; an accepted route moves the gap's ends onto
the road and gives its inner corners as new points, timed by their share of the
way. Observed points are never dropped, so each gap's corners are thinned by
themselves, between the two points that they lie between.
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

WOVEN = "track_id string, seq int, corner int, t_us long, lon double, lat double, is_stop boolean"


@dataclass
class Drawn:
    """``points`` (track_id, seq, corner, t_us, lon, lat, is_stop): corner 0 is the
    observed point seq, others follow it; ``gaps``: one row a gap with its verdict."""

    points: DataFrame
    gaps: DataFrame


def judged(points: DataFrame, routes: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every gap of ``points`` (track_id, seq, t_us, lon, lat) with its route and
    verdict: (track_id, seq, t_us, sec, line_m, key, distance, coords, snap_a,
    snap_b, fault, verdict)."""
    from waymill.plans.providers import pair_key

    gaps = s.gaps(points).withColumnsRenamed({"lon": "a_lon", "lat": "a_lat"}).withColumn("key", pair_key())
    # as the router is asked: whole degrees, cut off
    turn = F.pmod((F.degrees(geo.bearing(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))) + 360).cast("int"), F.lit(360))
    gaps = keep(gaps.select("track_id", "seq", "t_us", "sec", "line_m", "a_lon", "a_lat", "b_lon", "b_lat", turn.alias("turn"), "key"))
    one = lambda c: F.min_by(c, F.struct("track_id", "seq")).alias(c)
    wanted = gaps.groupBy("key").agg(*(one(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat", "line_m", "turn")))
    found = gaps.join(keep(routes(wanted)), "key", "left")
    return found.withColumn("verdict", geo.fill_verdict(F.col("distance"), F.col("line_m"), F.col("sec"))).drop("a_lon", "a_lat", "b_lon", "b_lat", "turn")


def moved(points: DataFrame, gaps: DataFrame) -> DataFrame:
    """``points`` (track_id, seq, t_us, lon, lat, is_stop) with the ends of accepted
    gaps on the road; a gap's beginning counts before the end of the one before
    it, stops stay."""
    accepted = gaps.where("verdict = 'accepted'")
    p = points.join(accepted.select("track_id", "seq", F.col("snap_a").alias("_own"), F.col("snap_b").alias("_ahead")), ["track_id", "seq"], "left")
    onto = F.coalesce("_own", F.lag("_ahead").over(s.order()))
    p = p.withColumn("_onto", F.when(~F.col("is_stop"), onto))
    return p.withColumns({c: F.coalesce(F.col(f"_onto.{c}"), F.col(c)) for c in ("lon", "lat")}).select(points.columns)


def corners(gaps: DataFrame) -> DataFrame:
    """(track_id, seq, corner, t_us, lon, lat) of accepted routes' inner corners."""
    g = gaps.where("verdict = 'accepted' and size(coords) > 2").select("track_id", "seq", F.col("t_us").alias("t0"), F.round(F.col("sec") * s.US).cast("long").alias("span"), F.posexplode("coords").alias("corner", "at"))
    w = Window.partitionBy("track_id", "seq").orderBy("corner")
    g = g.select("track_id", "seq", "corner", "t0", "span", F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"))
    leg = geo.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    g = g.withColumn("leg", F.coalesce(leg, F.lit(0.0)))
    g = g.withColumns({"run": F.sum("leg").over(w), "whole": F.sum("leg").over(Window.partitionBy("track_id", "seq")), "last": F.max("corner").over(Window.partitionBy("track_id", "seq"))})
    t = F.col("t0") + (F.col("span") * (F.col("run") / F.greatest("whole", F.lit(1.0)))).cast("long")
    return g.where("corner > 0 and corner < last").select("track_id", "seq", "corner", t.alias("t_us"), "lon", "lat")


def thinned(points: DataFrame, inner: DataFrame) -> DataFrame:
    """Of each gap's corners those that a line between its ends needs, at DRAWN_M."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("corner")
        column = lambda c: table.column(c).to_numpy()
        kept = k.simplify(k.Track(column("t_us"), column("lon"), column("lat")), m.DRAWN_M)
        at = column("corner")[kept]
        return table.take(pa.array(kept[(at > 0) & (at < np.iinfo(np.int32).max)]))

    ahead = lambda c: F.lead(c).over(s.order()).alias(c)
    names = ["track_id", "seq", "corner", "t_us", "lon", "lat"]
    only = inner.select("track_id", "seq").distinct()
    first = points.select("track_id", "seq", F.lit(0).alias("corner"), "t_us", "lon", "lat")
    last = points.select("track_id", "seq", F.lit(np.iinfo(np.int32).max).cast("int").alias("corner"), *(ahead(c) for c in ("t_us", "lon", "lat")))
    ends = first.unionAll(last).join(only, ["track_id", "seq"], "left_semi")
    # a gap is a group: no task holds a track for the sake of one route
    return ends.unionAll(inner.select(names)).groupBy("track_id", "seq").applyInArrow(run, "track_id string, seq int, corner int, t_us long, lon double, lat double")


def draw(points: DataFrame, routes: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> Drawn:
    """Draws the gaps of ``points`` (track_id, seq, t_us, lon, lat, is_stop), each
    track's seq counting from 0 in order of time. Routes of two corners move ends
    and add nothing; a gap without route, with a detour or with a way too long for
    its time stays straight."""
    gaps = keep(judged(points, routes, keep))
    on_road = keep(moved(points, gaps))
    inner = thinned(on_road, corners(gaps))
    woven = on_road.select("track_id", "seq", F.lit(0).alias("corner"), "t_us", "lon", "lat", "is_stop").unionAll(inner.select("track_id", "seq", "corner", "t_us", "lon", "lat", F.lit(False)))
    return Drawn(keep(woven), gaps)
