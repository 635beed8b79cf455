"""The intake with a state per task key: the first entry of a key claims it, and
its card is the one that stays.

The claim lives in the stream's own state store and expires after ``ttl_s``, so
a micro-batch reads its entries and their keys' states: its cost doesn't depend
on how many cards are kept. State and cards move on together: a batch that
failed runs again with the state from before it, so a task that was claimed in
it is claimed again, neither lost nor doubled.

Rows: entries without a key are skipped; of several entries of a key in one
batch the lowest attempt claims it (then the earliest, then the smallest route);
an expired key may be claimed anew; an empty batch only lets states expire.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from waymill.model import EngineConfig
from waymill.plans.shared import shared_path
from waymill.streaming import tasks

log = logging.getLogger("waymill")

ENTRY = tasks.QUEUE
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Where failed cards of tasks that ran out of attempts lie (``tasks.reclaim``).
GIVEN_UP = "batch=-1"


def _rank(r: Row) -> tuple:
    return r.attempt or 0, r.enqueued_at.timestamp() if r.enqueued_at else 0.0, r.route_compressed or ""


class FirstOfKey(StatefulProcessor):
    """Lets one entry of a key pass while nobody holds the key. One row is held
    at a time, however often a key was queued."""

    def __init__(self, ttl_s: int):
        self.ttl_ms = max(int(ttl_s * 1000), 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claim = handle.getValueState("claim", "attempt int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            first = r if first is None or _rank(r) < _rank(first) else first
        if first is not None and not self.claim.exists():
            self.claim.update((first.attempt or 0,))
            yield first

    def close(self) -> None:
        pass


def claimed(entries: DataFrame, ttl_s: int) -> DataFrame:
    """The entries of a stream that claim their keys. Start the stream inside
    ``state_in_rocksdb``: no other store keeps states that expire."""
    slim = entries.where("task_key is not null").select([c.split(" ")[0] for c in ENTRY.split(", ")])
    return slim.groupBy("task_key").transformWithState(FirstOfKey(ttl_s), ENTRY, "Append", "ProcessingTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """For streams started meanwhile; they keep the setting, the session doesn't."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def processor(results: str, roads=None, config: EngineConfig = EngineConfig(), notify: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The body of the stream: resolves claimed tasks, writes their cards, then
    notifies. Of the cards only those of given-up tasks are read."""

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = shared_path(spark, "claimed")  # the state is asked once; what follows reads the table
        batch.write.parquet(made)
        fresh = spark.read.schema(ENTRY).parquet(made)
        given_up = tasks._read(spark, f"{results}/{GIVEN_UP}", tasks.CARD + ", expires date").where("expires >= current_date() and expires_at > current_timestamp()")
        fresh = fresh.join(given_up.select("task_key"), "task_key", "left_anti")
        if not fresh.isEmpty():
            path = tasks._store(tasks.solve(fresh, roads, config), results, number, "overwrite")
            if notify is not None:
                notify(spark.read.schema(tasks.CARD + ", expires date").parquet(path).select(tasks.CARD_COLUMNS))
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return process


def start(spark: SparkSession, queue: str, results: str, checkpoint: str, roads=None, config: EngineConfig = EngineConfig(), notify=None, files_per_batch: int = 100, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Like ``tasks.start``, with a state per key instead of a look at the kept
    cards. ``once`` takes all that waits in a single batch: a state that expires
    by the clock asks for further batches for ever, so the stream can't stop by
    itself when the queue is empty. The entries are observed as ``queue`` (rows
    and the oldest enqueued_at) for ``watch.Watch``."""
    roads = roads if roads is not None else tasks.roads_of(config)
    notify = notify if notify is not None else tasks.callback_of(config) if config.callback_url else None
    if hasattr(roads, "ping") and not roads.ping():
        log.warning("the router can't be reached or builds no routes: %s", getattr(roads, "url", roads))
    entries = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).parquet(queue)
    entries = entries.observe("queue", F.count(F.lit(1)).alias("entries"), F.min("enqueued_at").alias("oldest"))
    writer = claimed(entries, config.ttl_s).writeStream.outputMode("append").foreachBatch(processor(results, roads, config, notify)).option("checkpointLocation", checkpoint)
    with state_in_rocksdb(spark):
        return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()
