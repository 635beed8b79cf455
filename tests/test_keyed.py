"""The intake with a state per key, and what streams report about themselves."""

import threading
import time
from datetime import datetime, timedelta, timezone
from http.server import ThreadingHTTPServer

import pytest

from tests.test_engine import _Server, drive
from waymill import model as m
from waymill.sources import codec
from waymill.streaming import keyed, sink, tasks, watch

KIND = "task_key string, route_compressed string"


@pytest.fixture
def place(tmp_path):
    return [str(tmp_path / x) for x in ("queue", "results", "check")]


def run(spark, place, **more):
    before = spark.conf.get(keyed.STATE_STORE)
    q = keyed.start(spark, *place, once=True, **more)
    assert spark.conf.get(keyed.STATE_STORE) == before != keyed.ROCKS
    q.awaitTermination()
    return q


def cards(spark, place):
    return {r.task_key: r for r in tasks.cards(spark, place[1]).collect()}


def test_the_first_of_two_writers_stays(spark, place):
    send = lambda *rows: tasks.submit(spark.createDataFrame(list(rows), KIND), place[0])
    first, second = codec.encode(drive(20)), codec.encode(drive(30))
    told = []
    notify = lambda df: told.extend(r.task_key for r in df.collect())
    send(("a", first), ("bad", "?"))
    send(("a", second), ("b", second))
    run(spark, place, notify=notify)
    assert sorted(told) == ["a", "b", "bad"] and {x: c.status for x, c in cards(spark, place).items()} == {"a": "done", "b": "done", "bad": "failed"}
    assert cards(spark, place)["a"].points_before == 20
    # in later batches too, with a lower attempt or without the older card: the state decides, not the cards
    send(("a", second), ("c", first))
    run(spark, place, notify=notify)
    assert sorted(told) == ["a", "b", "bad", "c"] and cards(spark, place)["a"].points_before == 20
    assert tasks._read(spark, place[1], tasks.STORED).count() == 4


def test_an_expired_key_is_claimed_anew(spark, place):
    short = m.EngineConfig(ttl_s=1)
    for n in (20, 30):
        tasks.submit(spark.createDataFrame([("a", codec.encode(drive(n)))], KIND), place[0])
        run(spark, place, config=short)
        time.sleep(1.2)
    assert sorted(r.points_before for r in tasks._read(spark, place[1], tasks.STORED).collect()) == [20, 30]


def test_a_failed_batch_claims_again(spark, place):
    tasks.submit(spark.createDataFrame([("a", codec.encode(drive(20))), (None, codec.encode(drive(20)))], KIND), place[0])

    def broken(df):
        raise ValueError("told nobody")

    with pytest.raises(Exception, match="told nobody"):
        run(spark, place, notify=broken)
    told = []
    run(spark, place, notify=lambda df: told.extend(r.task_key for r in df.collect()))
    assert len(told) == 2 and "a" in told
    stored = tasks._read(spark, place[1], tasks.STORED)
    assert stored.count() == 2 and [r.batch for r in stored.select("batch").distinct().collect()] == [0]


def test_a_task_given_up_keeps_its_card(spark, place):
    tasks.submit(spark.createDataFrame([("lost", codec.encode(drive(20)))], KIND), place[0])
    assert tasks.reclaim(spark, place[0], place[1], 0, m.EngineConfig(max_attempts=1)) == (0, 1)
    run(spark, place)
    assert cards(spark, place)["lost"].error_kind == "poisoned"


def test_entries_without_key_and_an_empty_queue(spark, place):
    spark.createDataFrame([], tasks.QUEUE).write.parquet(place[0])
    run(spark, place)
    assert cards(spark, place) == {}
    tasks.enqueue(spark.createDataFrame([(None, "?", 0)], "task_key string, route_compressed string, attempt int"), place[0])
    run(spark, place)
    assert cards(spark, place) == {}


def test_a_watched_stream(spark, place, tmp_path):
    seen = watch.Watch(spark, str(tmp_path / "reports"))
    spark.streams.addListener(seen)
    try:
        for keys in (["a", "b"], ["b", "c", "d"]):
            tasks.submit(spark.createDataFrame([(x, codec.encode(drive(20))) for x in keys], KIND), place[0])
            q = run(spark, place)
            assert seen.wait(q.runId)
    finally:
        spark.streams.removeListener(seen)
    found = watch.reports(spark, str(tmp_path / "reports"))
    (one,) = watch.counts(found).collect()
    assert (one.query, one.batches, one.rows, one.errors) == (str(q.id), 2, 5, 0) and 0 <= one.lag_s < 600
    assert [r.entries for r in found.where("kind = 'progress' and rows > 0").orderBy("batch").collect()] == [2, 3]
    assert [(r.ended, r.broken) for r in watch.health(found).collect()] == [(True, False)] * 2


def test_health_by_rule(spark):
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    row = lambda run, kind, ago, error=None: ("q", run, kind, now - timedelta(seconds=ago), 0, 1, None, None, 1, error)
    rows = [row("alive", "idle", 10), row("silent", "progress", 61), row("ended", "progress", 500), row("ended", "ended", 400), row("failed", "ended", 5, "no router")]
    found = watch.health(spark.createDataFrame(rows, watch.REPORT), now=now)
    assert {(r.run, r.silent_s, r.broken) for r in found.collect()} == {("alive", 10.0, False), ("silent", 61.0, True), ("ended", 400.0, False), ("failed", 5.0, True)}
    # a batch that ran twice counts once
    assert watch.counts(spark.createDataFrame(rows, watch.REPORT)).first().rows == 1


@pytest.fixture
def server():
    _Server.seen = []
    found = ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}"
    found.shutdown()


def test_callbacks_through_the_sink(spark, place, tmp_path, server):
    report = str(tmp_path / "told")
    tell = sink.notifier(f"{server}/ok/{{taskKey}}", pause_s=0.01, report=report)
    tasks.submit(spark.createDataFrame([("a", codec.encode(drive(20))), ("bad", "?")], KIND), place[0])
    run(spark, place, notify=tell)
    assert sorted(x for x in _Server.seen if x.startswith("/ok/")) == ['/ok/a{"taskKey": "a", "status": "done"}', '/ok/bad{"taskKey": "bad", "status": "failed"}']
    # refused ones are counted, not raised; null keys and an empty table are told to nobody
    sink.notifier(f"{server}/gone", pause_s=0.01, report=report)(spark.createDataFrame([("c", "done"), (None, "done")], "task_key string, status string"))
    sink.notifier(f"{server}/ok", report=report)(spark.createDataFrame([], "task_key string, status string"))
    assert sorted((r.told, r.refused) for r in spark.read.schema(sink.REPORT).json(report).collect()) == [(0, 0), (0, 1), (2, 0)]


def test_an_aborted_sink_reports_nothing(spark, tmp_path, server):
    report = str(tmp_path / "told")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "task_key string, status string").repartition(2, "task_key")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        sink.notifier(f"{server}/ok", report=report)(rows.selectExpr("task_key", "CASE WHEN task_key = 'b' THEN raise_error('zero') ELSE status END AS status"))
    assert not (tmp_path / "told").exists()
