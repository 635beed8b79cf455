"""Registered queries of the intake with a state per key, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.plans.shared import shared_path
from waymill.queries import ORACLES, WHOLE, _r, query
from waymill.sources import codec
from waymill.sources.events import VIEW_SQL
from waymill.streaming import keyed, tasks, watch


def _twice(v: DataFrame, seen: watch.Watch | None = None) -> tuple[DataFrame, str]:
    """All tracks as tasks, then every key again with its points at even places
    only, in a batch of its own; the cards and the stream's id."""
    spark = v.sparkSession
    places = [shared_path(spark, x) for x in ("queue", "results", "stream")]
    name = ""
    for points in (v, v.where("seq % 2 = 0")):
        tasks.submit(codec.encode_tracks(points).withColumnRenamed("track_id", "task_key"), places[0])
        stream = keyed.start(spark, *places, config=WHOLE, once=True)
        stream.awaitTermination()
        name = str(stream.id)
        if seen is not None:
            seen.wait(str(stream.runId))
    return tasks.cards(spark, places[1]), name


@query("stream_keyed", ORACLES["stream_tasks"])
def _(v):
    """The first entry of each key has the card, whatever comes later."""
    cards, _ = _twice(v)
    return cards.select("task_key", "status", "points_before", "points_after", "degraded", _r("length_before_m"), _r("length_m"))


@query("stream_counts", f"WITH {VIEW_SQL} SELECT CAST(2 AS BIGINT) AS batches, 2 * count(DISTINCT track_id) AS entries, count(DISTINCT track_id) AS cards, CAST(0 AS BIGINT) AS errors FROM v")
def _(v):
    """What the listener's table says about the same stream, beside its cards."""
    spark = v.sparkSession
    seen = watch.Watch(spark, shared_path(spark, "reports"))
    spark.streams.addListener(seen)
    try:
        cards, name = _twice(v, seen)
    finally:
        spark.streams.removeListener(seen)
    said = watch.counts(watch.reports(spark, seen.path)).where(F.col("query") == name).select("batches", F.col("rows").alias("entries"), F.lit(0).alias("cards"), "errors")
    both = said.unionAll(cards.agg(F.lit(0), F.lit(0), F.count("*"), F.lit(0)))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])
