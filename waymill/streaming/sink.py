"""Callbacks as a data source to write to: tasks send, the driver commits what
they sent as one report, or drops it with the write."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from waymill.streaming.tasks import Callback

log = logging.getLogger("waymill")

NAME = "waymill_callback"
REPORT = "batch long, told long, refused long"


@dataclass
class Sent(WriterCommitMessage):
    told: int
    refused: int


class _Writer:
    """Sends a POST per row with a key. A task that runs twice tells its rows
    twice, as any receiver of retried calls must expect; the report counts the
    run that was committed. Refusals are counted and don't fail the write."""

    def __init__(self, options: dict[str, str]):
        self.call = Callback(options.get("url", ""), int(options.get("tries", 3)), float(options.get("pause_s", 0.2)), float(options.get("timeout_s", 5.0)))
        self.report = options.get("report", "")

    def _send(self, rows: Iterator[Row]) -> Sent:
        told = refused = 0
        for r in rows:
            if r.task_key is not None and self.call.url:
                ok = self.call.send(r.task_key, r.status)
                told, refused = told + ok, refused + (not ok)
        return Sent(told, refused)

    def _commit(self, messages: list[Sent | None], batch: int | None) -> None:
        told, refused = (sum(getattr(x, c) for x in messages if x is not None) for c in ("told", "refused"))
        if refused:
            log.warning("%d of %d callbacks were refused", refused, told + refused)
        if self.report:
            # one small file per write, under its batch's name where there is one: a batch that commits again replaces its own
            files, folder = fs.FileSystem.from_uri(self.report)
            files.create_dir(folder, recursive=True)
            name = f"write-{uuid.uuid4().hex}" if batch is None else f"batch-{batch}"
            with files.open_output_stream(f"{folder}/_{name}") as f:  # names with a lower bar aren't read
                f.write(json.dumps({"batch": batch, "told": told, "refused": refused}).encode() + b"\n")
            files.move(f"{folder}/_{name}", f"{folder}/{name}.json")


class BatchWriter(_Writer, DataSourceWriter):
    def write(self, iterator: Iterator[Row]) -> Sent:
        return self._send(iterator)

    def commit(self, messages: list[Sent | None]) -> None:
        self._commit(messages, None)

    def abort(self, messages: list[Sent | None]) -> None:
        log.warning("a write of callbacks was given up")


class StreamWriter(_Writer, DataSourceStreamWriter):
    def write(self, iterator: Iterator[Row]) -> Sent:
        return self._send(iterator)

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        log.warning("the callbacks of batch %d were given up", batchId)


class CallbackSource(DataSource):
    """``df.write.format("waymill_callback")`` and the same for streams. Columns
    task_key and status; options url (``{taskKey}`` is filled in; empty: off),
    tries, pause_s, timeout_s and report (the path or URI of a folder that the driver can write)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def notifier(url: str, **options) -> Callable[[DataFrame], None]:
    """What ``start`` takes as ``notify``: tells ``url`` through the sink."""

    def tell(done: DataFrame) -> None:
        done.sparkSession.dataSource.register(CallbackSource)
        done.select("task_key", "status").write.format(NAME).options(url=url, **options).mode("append").save()

    return tell
