"""Sources that take turns within one track, found by sliding windows.

A track's hours overlap by half: a generator gives each point to the windows
that hold it. Within a window the points are dealt to places; how often the
track returns to a known, distant place is a matter of window functions. What
is suspected becomes episodes, which grow over their surroundings and are joined
where they touch, and each open episode is judged in rounds over all of them.
Dealing points to places is the one fold; its groups are an hour, or an episode,
of one track.

Points (track_id, seq, t_us, lon, lat): seq counts a track's points from 0 in
order of time. Tracks of under SPLIT_POINTS points have no suspects; points of
equal time keep the order of seq; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill import model as m
from waymill.functions import geo
from waymill.functions import kernels as k

US = 1_000_000
Keep = Callable[[DataFrame], DataFrame]
_POINT = ["seq", "t_us", "lon", "lat"]
_SEEDS = "array<struct<seq:int,lon:double,lat:double>>"


def windows(points: DataFrame) -> DataFrame:
    """(track_id, win, seq, t_us, lon, lat): the points of each hour that begins
    every half hour from a track's first point on, ends included."""
    whole = Window.partitionBy("track_id")
    p = points.select("track_id", *_POINT, F.min("t_us").over(whole).alias("t0"), F.count("*").over(whole).alias("n")).where(F.col("n") >= m.SPLIT_POINTS)
    since = F.col("t_us") - F.col("t0")
    first = F.greatest(F.ceil((since - m.SPLIT_WINDOW_S * US) / (m.SPLIT_STEP_S * US)), F.lit(0)).cast("int")
    return p.select("track_id", F.explode(F.sequence(first, F.floor(since / (m.SPLIT_STEP_S * US)).cast("int"))).alias("win"), *_POINT)


def placed(rows: DataFrame, group: str) -> DataFrame:
    """Deals the points of each (track_id, ``group``) to places, in order of seq:
    to the nearest centre within reach, or as a centre of their own. Adds place,
    and the centre's c_seq, c_lon, c_lat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["track_id", group]):
            place, centre = k.homes(*(table.column(c).to_numpy() for c in ("lon", "lat")))
            at = pa.array(centre[place])
            for name, column in (("place", pa.array(place)), *((f"c_{c}", table.column(c).take(at)) for c in ("seq", "lon", "lat"))):
                table = table.append_column(name, column)
            yield from table.combine_chunks().to_batches()

    slim = rows.select("track_id", group, *_POINT)
    dealt = slim.repartition("track_id", group).sortWithinPartitions("track_id", group, "seq")
    return dealt.mapInArrow(run, f"track_id string, {group} int, seq int, t_us long, lon double, lat double, place int, c_seq int, c_lon double, c_lat double")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches, each as a whole."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        change = np.zeros(table.num_rows, dtype=bool)
        for c in keys:
            column = table.column(c).combine_chunks()
            change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(change).tolist()
        for a, b in zip([0, *cuts], cuts):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1] if cuts else 0)
    if held is not None:
        yield held


def suspects(points: DataFrame) -> DataFrame:
    """(track_id, seq) of the points of places that a track keeps coming back to
    within an hour."""
    w = windows(points).withColumn("_n", F.count("*").over(Window.partitionBy("track_id", "win"))).where(F.col("_n") >= 2 * m.SPLIT_MEMBERS)
    p = placed(w, "win").withColumn("members", F.count("*").over(Window.partitionBy("track_id", "win", "place"))).where(F.col("members") >= m.SPLIT_MEMBERS)
    order = Window.partitionBy("track_id", "win").orderBy("seq")
    visit = p.withColumn("was", F.lag("place").over(order)).where("was is null or was <> place")  # one entry a stay
    before = lambda c: F.lag(c).over(order)
    known = F.min("seq").over(Window.partitionBy("track_id", "win", "place")) < F.col("seq")
    way = geo.haversine(before("c_lon"), before("c_lat"), F.col("c_lon"), F.col("c_lat"))
    back = visit.select("track_id", "win", "place", before("place").alias("other"), known.alias("known"), way.alias("way")).where(F.col("known") & (F.col("way") >= m.SPLIT_APART_M))
    often = back.withColumn("_n", F.count("*").over(Window.partitionBy("track_id", "win"))).where(F.col("_n") >= m.SPLIT_RETURNS)
    guilty = often.select("track_id", "win", F.explode(F.array("place", "other")).alias("place")).distinct()
    return p.join(guilty, ["track_id", "win", "place"], "left_semi").select("track_id", "seq").distinct()


def merged_ranges(ranges: DataFrame, by: str, low: str, high: str, order: str) -> DataFrame:
    """Adds merged: the number of the union that a range of whole numbers belongs
    to. Ranges that overlap or touch are one; the end so far is a running maximum
    over all ranges before, since an early one may reach beyond later ones."""
    w = Window.partitionBy(by).orderBy(low, order)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col(low) > reach + 1)
    return ranges.withColumn("_fresh", fresh.cast("int")).withColumn("merged", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_fresh")


def near_any(lon: Column, lat: Column, centres: Column) -> Column:
    return F.exists(centres, lambda c: geo.haversine(c["lon"], c["lat"], lon, lat) <= m.SPLIT_NEAR_M)


def grown(points: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (track_id, grp, low, high, seeds) with low and high moved outwards
    over points near any seed."""
    p = points.select("track_id", "seq", "lon", "lat").join(found, "track_id").where(~near_any(F.col("lon"), F.col("lat"), F.col("seeds")) & ~F.col("seq").between(F.col("low"), F.col("high")))
    stop = p.groupBy("track_id", "grp").agg(F.max(F.when(F.col("seq") < F.col("low"), F.col("seq"))).alias("under"), F.min(F.when(F.col("seq") > F.col("high"), F.col("seq"))).alias("over"))
    last = points.groupBy("track_id").agg(F.max("seq").alias("last"))
    out = found.join(stop, ["track_id", "grp"], "left").join(last, "track_id")
    return out.select("track_id", "grp", F.coalesce(F.col("under") + 1, F.lit(0)).alias("low"), F.coalesce(F.col("over") - 1, F.col("last")).alias("high"), "seeds")


def widest(seeds: Column) -> Column:
    """The largest distance among centres."""
    return F.array_max(F.transform(seeds, lambda a: F.array_max(F.transform(seeds, lambda b: geo.haversine(a["lon"], a["lat"], b["lon"], b["lat"])))))


def episodes(points: DataFrame, suspected: DataFrame) -> DataFrame:
    """(track_id, episode, low, high, seeds, span_m): stretches of suspects with two
    places and more, with what surrounds them."""
    order = Window.partitionBy("track_id").orderBy("seq")
    s = points.join(suspected, ["track_id", "seq"], "left_semi").select("track_id", *_POINT)
    s = s.withColumn("_cut", F.coalesce((F.col("t_us") - F.lag("t_us").over(order) > m.SPLIT_WINDOW_S * US).cast("int"), F.lit(0))).withColumn("grp", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    p = placed(s, "grp").withColumn("members", F.count("*").over(Window.partitionBy("track_id", "grp", "place")))
    seed = F.when((F.col("members") >= m.SPLIT_MEMBERS) & (F.col("seq") == F.col("c_seq")), F.struct("seq", "lon", "lat"))
    found = p.groupBy("track_id", "grp").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.sort_array(F.collect_list(seed)).alias("seeds")).where(F.size("seeds") >= 2)
    joined = merged_ranges(grown(points, found), "track_id", "low", "high", "grp").withColumnRenamed("merged", "episode")
    e = joined.groupBy("track_id", "episode").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.flatten(F.collect_list("seeds")).alias("seeds"))
    return e.withColumn("span_m", widest(F.col("seeds")))


def slot_shares(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(track_id, episode, place, c_seq, c_lon, c_lat, share): of the quarter hours of
    ``spans`` (track_id, episode, low, high, t0, t1), the share in which a place
    of its points occurs."""
    inside = points.join(spans, "track_id").where(F.col("seq").between(F.col("low"), F.col("high")))
    p = placed(inside, "episode").join(spans.select("track_id", "episode", "t0", "t1"), ["track_id", "episode"])
    slot = F.floor((F.col("t_us") - F.col("t0")) / (m.SPLIT_SLOT_S * US))
    slots = F.floor((F.col("t1") - F.col("t0")) / (m.SPLIT_SLOT_S * US)) + 1
    one = p.groupBy("track_id", "episode", "place", "c_seq", "c_lon", "c_lat", slots.alias("slots")).agg(F.count_distinct(slot).alias("own"))
    return one.withColumn("share", F.col("own") / F.col("slots")).drop("slots", "own")


def _timed(spans: DataFrame, points: DataFrame) -> DataFrame:
    """``spans`` with the times of their ends."""
    for end, t in (("low", "t0"), ("high", "t1")):
        spans = spans.drop(t).join(points.select("track_id", F.col("seq").alias(end), F.col("t_us").alias(t)), ["track_id", end])
    return spans


def stretched(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (track_id, episode, low, high, centres): ends moved outwards to the
    last point near a centre that lies before the first run of more than
    SPLIT_SKIP others."""
    p = points.select("track_id", "seq", "lon", "lat").join(spans, "track_id").where(near_any(F.col("lon"), F.col("lat"), F.col("centres")) & ~F.col("seq").between(F.col("low"), F.col("high")))
    p = p.select("track_id", "episode", (F.col("seq") > F.col("high")).alias("up"), F.when(F.col("seq") > F.col("high"), F.col("seq") - F.col("high")).otherwise(F.col("low") - F.col("seq")).alias("off"))
    w = Window.partitionBy("track_id", "episode", "up").orderBy("off")
    wide = (F.col("off") - F.coalesce(F.lag("off").over(w), F.lit(0)) > m.SPLIT_SKIP + 1).cast("int")
    p = p.withColumn("_wide", wide).withColumn("_cut", F.sum("_wide").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0")
    reach = p.groupBy("track_id", "episode").agg(F.max(F.when(F.col("up"), F.col("off"))).alias("onward"), F.max(F.when(~F.col("up"), F.col("off"))).alias("back"))
    out = spans.join(reach, ["track_id", "episode"], "left")
    return out.withColumns({"low": F.col("low") - F.coalesce("back", F.lit(0)), "high": F.col("high") + F.coalesce("onward", F.lit(0))}).drop("onward", "back")


def verdicts(points: DataFrame, found: DataFrame, keep: Keep) -> DataFrame:
    """(track_id, episode, seq): the points of guilty places. Of an episode's places
    the one that holds twice as many quarter hours as the next is honest; while
    none does, the episode grows, SPLIT_GROWTH times at most, and in the end all
    are guilty. A round handles the episodes that are still open."""
    live = _timed(found.where(F.col("span_m") <= m.SPLIT_SPAN_M).select("track_id", "episode", "low", "high"), points).where(F.col("t1") - F.col("t0") >= m.SPLIT_SLOTS * m.SPLIT_SLOT_S * US)
    live = keep(live.select("track_id", "episode", "low", "high", "t0", "t1", F.lit(None).cast("int").alias("was_low"), F.lit(None).cast("int").alias("was_high")))
    ended: list[DataFrame] = []  # (track_id, episode, low, high, honest): the last range judged and its honest place's centre
    for number in range(m.SPLIT_GROWTH):
        if not live.limit(1).count():
            break
        shares = slot_shares(points, live)
        # of equal shares the earlier place comes first
        r = shares.withColumn("_k", F.row_number().over(Window.partitionBy("track_id", "episode").orderBy(F.desc("share"), "place")))
        top = r.groupBy("track_id", "episode").agg(
            F.count("*").alias("places"), F.max(F.when(F.col("_k") == 1, F.col("share"))).alias("one"), F.max(F.when(F.col("_k") == 2, F.col("share"))).alias("two"), F.max(F.when(F.col("_k") == 1, F.col("c_seq"))).alias("first"),
            F.collect_list(F.struct(F.col("c_lon").alias("lon"), F.col("c_lat").alias("lat"))).alias("centres"),
        )
        j = keep(live.join(top, ["track_id", "episode"]).withColumn("told", F.col("one") >= m.SPLIT_RATIO * F.greatest("two", F.lit(1e-9))))
        lone = F.col("places") < 2  # of one place nothing is told: what the round before found counts
        ended.append(j.where(lone & F.col("was_low").isNotNull()).select("track_id", "episode", F.col("was_low").alias("low"), F.col("was_high").alias("high"), F.lit(None).cast("int").alias("honest")))
        ended.append(j.where(~lone & F.col("told")).select("track_id", "episode", "low", "high", F.col("first").alias("honest")))
        open_ones = j.where(~lone & ~F.col("told")).select("track_id", "episode", "low", "high", "centres")
        wider = keep(stretched(points, open_ones.withColumns({"was_low": F.col("low"), "was_high": F.col("high")})))
        still = (F.col("low") == F.col("was_low")) & (F.col("high") == F.col("was_high"))
        settled = still if number + 1 < m.SPLIT_GROWTH else F.lit(True)
        ended.append(wider.where(settled).select("track_id", "episode", F.col("was_low").alias("low"), F.col("was_high").alias("high"), F.lit(None).cast("int").alias("honest")))
        live = keep(_timed(wider.where(~settled).select("track_id", "episode", "low", "high", "was_low", "was_high"), points))
    judged = None
    for part in ended:
        judged = part if judged is None else judged.unionAll(part)
    if judged is None:
        return points.sparkSession.createDataFrame([], "track_id string, episode int, seq int")
    inside = points.join(judged, "track_id").where(F.col("seq").between(F.col("low"), F.col("high")))
    p = placed(inside, "episode").join(judged.select("track_id", "episode", "honest"), ["track_id", "episode"])
    return p.where(F.col("honest").isNull() | (F.col("c_seq") != F.col("honest"))).select("track_id", "episode", "seq")


def find_split(points: DataFrame, keep: Keep) -> DataFrame:
    """(track_id, seq) of the points of sources that take turns."""
    points = points.select("track_id", "seq", "t_us", "lon", "lat")
    found = keep(episodes(points, keep(suspects(points))))
    return verdicts(points, found, keep).select("track_id", "seq").distinct()
