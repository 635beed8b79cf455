"""What streams report about themselves, kept as a table: rows, batches, lag and
silence. ``Watch`` is a listener that writes; ``counts`` and ``health`` read."""

from __future__ import annotations

import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: One row per event. ``rows`` are input rows; ``entries`` and ``oldest`` are what the stream observed as ``queue``.
REPORT = "query string, run string, kind string, at timestamp, batch long, rows long, entries long, oldest timestamp, batch_ms long, error string"


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


class Watch(StreamingQueryListener):
    """Appends events to the table at ``path``, ``every`` of them at a time and at
    the end of each stream, so a stream of empty batches doesn't make a file per
    batch. What a driver that dies hasn't written yet is lost; the stream's own
    checkpoint doesn't depend on it. A fault of the table never reaches a stream."""

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every = spark, path, every
        self.rows: list[tuple] = []
        self.lock, self.ended = threading.Condition(), set()

    def _add(self, row: tuple, now: bool = False) -> None:
        with self.lock:
            self.rows.append(row)
            if now or len(self.rows) >= self.every:
                made = self.spark.createDataFrame(self.rows, REPORT).coalesce(1)
                made.write.mode("append").parquet(self.path)
                self.rows = []

    def onQueryStarted(self, event) -> None:
        self._add((str(event.id), str(event.runId), "started", _time(event.timestamp), None, None, None, None, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("queue")
        entries, oldest = (seen["entries"], seen["oldest"]) if seen is not None else (None, None)
        self._add((str(p.id), str(p.runId), "progress", _time(p.timestamp), p.batchId, p.numInputRows, entries, oldest, p.batchDuration, None))

    def onQueryIdle(self, event) -> None:
        self._add((str(event.id), str(event.runId), "idle", _time(event.timestamp), None, None, None, None, None, None))

    def onQueryTerminated(self, event) -> None:
        try:
            self._add((str(event.id), str(event.runId), "ended", datetime.now(timezone.utc), None, None, None, None, None, event.exception), now=True)
        finally:
            with self.lock:
                self.ended.add(str(event.runId))
                self.lock.notify_all()

    def wait(self, run: str, timeout_s: float = 60.0) -> bool:
        """Waits until the end of a run has been written."""
        with self.lock:
            return self.lock.wait_for(lambda: str(run) in self.ended, timeout_s)


def reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(path)


def counts(found: DataFrame) -> DataFrame:
    """One row per stream over all its runs: batches that read something, rows
    read, the longest wait of an entry until its batch began, errors. A batch
    that ran twice counts once, as its last report says."""
    last = found.where("kind = 'progress'").groupBy("query", "batch").agg(F.max_by(F.struct("rows", "at", "oldest"), "at").alias("p")).select("query", "p.*")
    per = last.groupBy("query").agg(F.count_if(F.col("rows") > 0).alias("batches"), F.sum("rows").alias("rows"), F.max(F.col("at").cast("double") - F.col("oldest").cast("double")).alias("lag_s"))
    failed = found.groupBy("query").agg(F.count("error").alias("errors"))
    return failed.join(per, "query", "left").select("query", F.coalesce("batches", F.lit(0)).alias("batches"), F.coalesce("rows", F.lit(0)).alias("rows"), "lag_s", "errors")


def health(found: DataFrame, silent_s: float = 60.0, now=None) -> DataFrame:
    """One row per run: seconds since it last reported, and whether it is broken
    (ended with an error, or neither ended nor heard of for ``silent_s``)."""
    now = F.current_timestamp() if now is None else F.lit(now)
    per = found.groupBy("query", "run").agg(F.max("at").alias("at"), F.max(F.col("kind") == "ended").alias("ended"), F.count("error").alias("errors"))
    silent = now.cast("double") - F.col("at").cast("double")
    return per.select("query", "run", silent.alias("silent_s"), "ended", ((F.col("errors") > 0) | (~F.col("ended") & (silent > silent_s))).alias("broken"))
