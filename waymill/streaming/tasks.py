"""Continuous intake: a folder of submitted tasks, a stream that resolves them,
and a folder of result cards.

A task is done once its card is written; only then does the stream's checkpoint
move on, so a restart repeats work but never loses a task, and a repeated batch
overwrites its own cards. Finished tasks are skipped by an anti join with the
cards that are still kept: cards lie in folders by batch and by day of expiry,
and past days are neither read nor, once ``purge`` has run, there.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymill.model import EngineConfig
from waymill.plans import engine, rounds
from waymill.plans.providers import HttpProvider
from waymill.plans.roads import HttpRoads
from waymill.plans.shared import shared_path
from waymill.sources import codec

log = logging.getLogger("waymill")

QUEUE = "task_key string, route_compressed string, attempt int, enqueued_at timestamp"
CARD = (
    "task_key string, status string, route_compressed string, length_m double, length_before_m double, points_before int, points_after int, "
    "degraded boolean, warnings array<string>, error_kind string, error string, stages string, finished_at timestamp, expires_at timestamp"
)

#: Cards as they are stored: in folders by batch and day of expiry.
STORED = CARD + ", batch int, expires date"
CARD_COLUMNS = [c.split(" ")[0] for c in CARD.split(", ")]

#: What a failed task means to an HTTP client.
HTTP_STATUS = {"invalid": 400, "too_large": 413, "too_many": 413, "too_few": 422, "unprocessable": 422, "not_found": 404}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def enqueue(entries: DataFrame, queue: str) -> None:
    entries.select("task_key", "route_compressed", F.col("attempt").cast("int").alias("attempt"), F.current_timestamp().alias("enqueued_at")).write.mode("append").parquet(queue)


def submit(routes: DataFrame, queue: str) -> DataFrame:
    """Appends routes to the queue without decoding them; gives every one
    without task_key a new key. Returns the keys of these routes, as written,
    whoever else writes meanwhile; the queue isn't read."""
    spark = routes.sparkSession
    key = F.coalesce(F.col("task_key"), F.expr("uuid()")) if "task_key" in routes.columns else F.expr("uuid()")
    made = shared_path(spark, "submitted")  # written first: a key is drawn once, however often a task runs
    routes.select(key.alias("task_key"), "route_compressed", F.lit(0).alias("attempt")).write.parquet(made)
    entries = spark.read.schema("task_key string, route_compressed string, attempt int").parquet(made)
    enqueue(entries, queue)
    return entries.select("task_key").distinct()


def cards(spark: SparkSession, results: str, expired: bool = False) -> DataFrame:
    """The latest card of every task that is still kept. Days that are past aren't read."""
    found = _read(spark, results, STORED)
    found = found if expired else found.where("expires >= current_date()")
    # the latest by key alone, then its row: whole cards aren't compared or shuffled with their routes
    last = found.groupBy("task_key").agg(F.max(F.struct("finished_at", "batch")).alias("last")).select("task_key", "last.*")
    latest = found.join(last, ["task_key", "finished_at", "batch"], "left_semi").dropDuplicates(["task_key"]).select(CARD_COLUMNS)
    return latest if expired else latest.where("expires_at > current_timestamp()")


def _store(made: DataFrame, results: str, batch: int, mode: str) -> str:
    path = f"{results}/batch={batch}"
    made.withColumn("expires", F.to_date("expires_at")).write.mode(mode).partitionBy("expires").parquet(path)
    return path


def status(spark: SparkSession, queue: str, results: str, task_key: str) -> dict | None:
    """The card of one task; pending if it is only queued, None if unknown."""
    found = cards(spark, results).where(F.col("task_key") == task_key).limit(1).collect()
    if found:
        return found[0].asDict()
    waiting = _read(spark, queue, QUEUE).where(F.col("task_key") == task_key).limit(1).count()
    return {"task_key": task_key, "status": "pending", "length_m": 0.0} if waiting else None


def debug(spark: SparkSession, results: str, task_key: str) -> DataFrame:
    """The stages of one finished task: name, points before and after, report."""
    return engine.stage_stats(cards(spark, results).where(F.col("task_key") == task_key).withColumnRenamed("task_key", "track_id"))


def resolve_route(spark: SparkSession, route: str, roads=None, config: EngineConfig = EngineConfig()) -> dict:
    """One route in one call: the card with counts, or the error and its HTTP status."""
    card = solve(spark.createDataFrame([("route", route)], "task_key string, route_compressed string"), roads, config).first().asDict()
    if card["status"] == "done":
        return card | {"removed_points": card["points_before"] - card["points_after"], "http_status": 200}
    return card | {"http_status": HTTP_STATUS.get(card["error_kind"], 500)}


#: What a card says before its times are set.
_MADE = CARD.split(", finished_at")[0]
_ARROW_MADE = pa.schema([(c.split(" ")[0], {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[c.split(" ")[1]]) for c in _MADE.split(", ")])


def solve(tasks: DataFrame, roads=None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One CARD row per (task_key, route_compressed): decode, resolve, encode. Unreadable
    and empty routes go the same way as the others, so that no step is run twice."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = table.column("error_kind")[0].as_py()
        if kind is not None:
            found = {"status": "failed", "error_kind": kind, "error": table.column("error")[0].as_py()}
        elif table.column("seq")[0].as_py() is None:
            found = {"status": "failed", "error_kind": "too_few", "error": "too few points after processing"}
        else:
            found = engine.solved(table.drop_columns(["error_kind", "error"]), roads, config)
            found |= {"stages": json.dumps(found.get("stages") or []), "length_m": found.get("length_after_m")}
            if found["status"] == "failed":
                found["error_kind"] = "unprocessable"
            else:
                _, _, t_us, zone, lon, lat, *_ = found["points"]
                found["route_compressed"] = codec.encode_columns(t_us, zone, lon, lat)
        found |= {"task_key": key[0].as_py(), "length_m": found.get("length_m") or 0.0, "degraded": bool(found.get("degraded"))}
        return pa.Table.from_pylist([{c: found.get(c) for c in _ARROW_MADE.names}], schema=_ARROW_MADE)

    made = rounds.dealt(codec.decode_points(tasks, config=config)).groupBy("track_id").applyInArrow(run, _MADE)
    out = made.withColumn("finished_at", F.current_timestamp())
    return out.withColumn("expires_at", F.col("finished_at") + F.make_dt_interval(secs=F.lit(config.ttl_s))).select(CARD_COLUMNS)


class Callback:
    """Tells a URL about finished tasks; ``{taskKey}`` in it is filled in. Network
    faults and 5xx are tried again with growing pauses, 4xx are not; an empty
    URL turns it off."""

    def __init__(self, url: str, tries: int = 3, pause_s: float = 0.2, timeout_s: float = 5.0):
        self.url, self.tries, self.pause_s, self.timeout_s = url, tries, pause_s, timeout_s

    def send(self, task_key: str, state: str) -> bool:
        if not self.url:
            return False
        body = json.dumps({"taskKey": task_key, "status": state}).encode()
        request = urllib.request.Request(self.url.replace("{taskKey}", task_key), body, {"Content-Type": "application/json"})
        for n in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_s):
                    return True
            except urllib.error.HTTPError as e:
                if e.code < 500:
                    return False
            except OSError:
                pass
            if n < self.tries:
                time.sleep(self.pause_s * n)
        return False

    def __call__(self, done: DataFrame) -> None:
        def run(rows: Iterator[Row]) -> None:
            for r in rows:
                self.send(r.task_key, r.status)

        done.select("task_key", "status").foreachPartition(run)


def processor(results: str, roads=None, config: EngineConfig = EngineConfig(), notify: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The body of the stream: skips finished tasks, writes cards, then notifies."""

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        finished = _read(spark, results, STORED).where((F.col("batch") != number) & F.expr("expires >= current_date()")).select("task_key")
        fresh = batch.where("task_key is not null").dropDuplicates(["task_key"]).join(finished, "task_key", "left_anti")
        path = _store(solve(fresh, roads, config), results, number, "overwrite")
        if notify is not None:
            notify(spark.read.schema(CARD + ", expires date").parquet(path).select(CARD_COLUMNS))

    return process


def roads_of(config: EngineConfig) -> HttpRoads | None:
    """The router of the settings, for tracks that ask for themselves; None without a URL."""
    return HttpRoads(config.router_url, config.router_timeout_s, config.router_requests, config.router_retries) if config.router_url else None


def provider_of(config: EngineConfig) -> HttpProvider | None:
    """The same router for stages across tracks."""
    return HttpProvider(config.router_url, config.router_requests, {"timeout_s": config.router_timeout_s, "retries": config.router_retries}) if config.router_url else None


def callback_of(config: EngineConfig) -> Callback:
    return Callback(config.callback_url, config.callback_tries, timeout_s=config.callback_timeout_s)


def start(spark: SparkSession, queue: str, results: str, checkpoint: str, roads=None, config: EngineConfig = EngineConfig(), notify=None, files_per_batch: int = 100, once: bool = False) -> StreamingQuery:
    """Runs the stream over the queue folder; ``once`` stops when it is empty. A
    router that can't be reached is logged at once, not with the first task."""
    roads = roads if roads is not None else roads_of(config)
    notify = notify if notify is not None else callback_of(config) if config.callback_url else None
    if hasattr(roads, "ping") and not roads.ping():
        log.warning("the router can't be reached or builds no routes: %s", getattr(roads, "url", roads))
    entries = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", files_per_batch).parquet(queue)
    writer = entries.writeStream.foreachBatch(processor(results, roads, config, notify)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def _open_entries(spark: SparkSession, queue: str, results: str) -> DataFrame:
    entries = _read(spark, queue, QUEUE)
    last = entries.groupBy("task_key").agg(F.max_by(F.struct("route_compressed", "attempt", "enqueued_at"), "attempt").alias("e")).select("task_key", "e.*")
    return last.join(_read(spark, results, STORED).select("task_key"), "task_key", "left_anti")


def reclaim(spark: SparkSession, queue: str, results: str, idle_s: int, config: EngineConfig = EngineConfig()) -> tuple[int, int]:
    """Queues tasks anew that nobody finished for ``idle_s``, one attempt later;
    those out of attempts get failed cards. Returns how many of each."""
    lost = _open_entries(spark, queue, results).where(F.col("enqueued_at") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(idle_s))).withColumn("attempt", F.col("attempt") + 1)
    poisoned = lost.where(F.col("attempt") >= config.max_attempts)
    again = lost.where(F.col("attempt") < config.max_attempts)
    n_poisoned, n_again = poisoned.count(), again.count()
    if n_poisoned:
        card = poisoned.select("task_key", F.lit("failed").alias("status"), F.lit("poisoned").alias("error_kind"), F.concat(F.lit("gave up after "), F.col("attempt"), F.lit(" attempts")).alias("error"), F.lit(0.0).alias("length_m"), F.lit(False).alias("degraded"), F.current_timestamp().alias("finished_at"))
        card = card.withColumn("expires_at", F.col("finished_at") + F.make_dt_interval(secs=F.lit(config.ttl_s)))
        _store(spark.createDataFrame([], CARD).unionByName(card, allowMissingColumns=True).select(CARD_COLUMNS), results, -1, "append")
    if n_again:
        enqueue(again, queue)
    return n_again, n_poisoned


def trim(spark: SparkSession, queue: str, results: str) -> int:
    """Deletes queue files whose tasks are all finished."""
    if not _exists(spark, queue):
        return 0
    entries = spark.read.schema(QUEUE).parquet(queue).select("task_key", F.input_file_name().alias("file"))
    done = _read(spark, results, STORED).select("task_key", F.lit(1).alias("done")).distinct()
    whole = entries.join(done, "task_key", "left").groupBy("file").agg(F.min(F.coalesce("done", F.lit(0))).alias("all_done")).where("all_done = 1")
    paths = [r.file for r in whole.select("file").toLocalIterator()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        p.getFileSystem(conf).delete(p, False)
    return len(paths)


def purge(spark: SparkSession, queue: str, results: str) -> int:
    """Deletes the cards whose day of expiry is past and returns how many. A
    folder stays while one of its tasks is queued: without its card, the task
    would seem unfinished (``trim`` takes finished ones off the queue)."""
    old = _read(spark, results, STORED).where("expires < current_date()").select("task_key", "batch", "expires")
    queued = _read(spark, queue, QUEUE).select("task_key", F.lit(True).alias("queued")).distinct()
    free = old.join(queued, "task_key", "left").groupBy("batch", "expires").agg(F.count("*").alias("n"), F.max("queued").alias("queued")).where("queued is null")
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for r in free.select("batch", "expires", "n").toLocalIterator():
        day = jvm.org.apache.hadoop.fs.Path(f"{results}/batch={r.batch}/expires={r.expires}")
        fs = day.getFileSystem(conf)
        gone += r.n if fs.delete(day, True) else 0
        if not any(x.isDirectory() for x in fs.listStatus(day.getParent())):
            fs.delete(day.getParent(), True)
    return gone


def tend(spark: SparkSession, query: StreamingQuery, queue: str, results: str, every_s: float = 60.0, idle_s: int = 600, config: EngineConfig = EngineConfig()) -> int:
    """Beside a running stream: every ``every_s`` reclaims what nobody finished,
    trims the queue and purges old cards, until the stream ends. Returns how often."""
    rounds = 0
    while not query.awaitTermination(every_s):
        reclaim(spark, queue, results, idle_s, config)
        trim(spark, queue, results)
        purge(spark, queue, results)
        rounds += 1
    return rounds


def ready(query: StreamingQuery, silent_s: float = 60.0, now: float | None = None) -> bool:
    """Whether the stream runs and has reported within ``silent_s``."""
    if not query.isActive:
        return False
    last = query.lastProgress
    if not last:
        return True
    from datetime import datetime

    at = datetime.fromisoformat(last["timestamp"].replace("Z", "+00:00")).timestamp()
    return (now or time.time()) - at <= silent_s
