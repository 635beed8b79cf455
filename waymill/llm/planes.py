"""Token-id files of shuffled planes.

Ids are written in ascending order of documents. A file holds whole documents;
their ids, one after the other, are cut into blocks of BLOCK_IDS. A block is
transposed into planes (the lowest bytes of all ids, then the next bytes, or one
bit of all ids after the other), as many as its largest id needs, and each plane
is compressed with zstandard. The file ends with the table of its documents and
the block index (size, checksum, and where each plane lies), so a reader takes
any range of ids from the blocks that hold it.

    opening | planes of block 0, 1, ... | documents | block index | trailer | closing

Ids are those of the tokenizers library, from the encoder that operator 2 uses;
the library itself takes four times as long.

Files are written to the shared folder by Spark's text writer, one row a file
and the closing as line separator, so a lost task leaves nothing behind. A file
carries its partition's and its own number; since partitions are ranges, files
in that order hold the documents in order, and sums over the files' sizes give
the place of every document.

Rows: null text counts as empty and has the end id alone; rows without doc_id
come first; rows with the same doc_id follow one another, in an order fixed when
the ids are written; ids that repeat without end are dealt over partitions like
any others; other columns are ignored; an empty table gives no rows. A document
of any length is whole in one file, which it may lengthen.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import agreement, codec, default_vocabulary
from .common import Scratch, balanced, packed, steps, table

#: Ids of a block; ids after which a file is closed; ids that a partition is meant to hold.
BLOCK_IDS, FILE_IDS, PART_IDS = 65_536, 2_000_000, 16_000_000
LEVEL = 3
END_ID = 2
#: Bytes of a text that are tokenised at a time, where it has a place to cut.
PIECE_BYTES = 1 << 16

OPENING, CLOSING = b"WMPLANE1", b"\nWMPEND1\n"
BYTES, BITS = 0, 1
_BLOCK = struct.Struct("<IIQBB")  # ids, crc32, offset, kind of planes, their number; then the planes' sizes
_TRAILER = struct.Struct("<QQQQIIII")  # documents' offset, index's offset, documents, ids, blocks, partition, number, crc32 of documents and index


# ---------------------------------------------------------------- one file


def planes_of(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    if kind == BITS:
        return [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes() for k in range(width)]
    columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [columns[:, k].tobytes() for k in range(-(-width // 8))]


def ids_of(planes: list[bytes], kind: int, n: int) -> np.ndarray:
    """The block of ``n`` ids from its planes."""
    out = np.zeros(n, dtype="<u4")
    if kind == BITS:
        for k, p in enumerate(planes):
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
        return out
    columns = out.view(np.uint8).reshape(-1, 4)
    for k, p in enumerate(planes):
        columns[:, k] = np.frombuffer(p, np.uint8)
    return out


@dataclass
class Writer:
    """Makes one file of the documents added to it."""

    part: int = 0
    number: int = 0
    kind: int = BYTES
    ids: int = 0
    _out: bytearray = field(default_factory=lambda: bytearray(OPENING))
    _index: bytearray = field(default_factory=bytearray)
    _blocks: int = 0
    _held: list = field(default_factory=list)
    _waiting: int = 0
    _docs: list = field(default_factory=list)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id, len(ids)))
        self.ids += len(ids)
        self._held.append(ids)
        self._waiting += len(ids)
        if self._waiting >= BLOCK_IDS:
            waiting = np.concatenate(self._held)
            whole = len(waiting) // BLOCK_IDS * BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                self._block(waiting[at : at + BLOCK_IDS])
            self._held, self._waiting = [waiting[whole:].copy()], len(waiting) - whole

    def _block(self, ids: np.ndarray) -> None:
        press = zstandard.ZstdCompressor(level=LEVEL)
        parts = [press.compress(p) for p in planes_of(ids, self.kind)]
        self._index += _BLOCK.pack(len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(self._out), self.kind, len(parts))
        self._index += struct.pack(f"<{len(parts)}I", *map(len, parts))
        for p in parts:
            self._out += p
        self._blocks += 1

    def finish(self) -> bytes:
        """The file, but for its closing."""
        if self._waiting:
            self._block(np.concatenate(self._held))
        names = np.array([0 if d is None else d for d, _ in self._docs], dtype="<i8")
        told = np.array([d is not None for d, _ in self._docs], dtype=np.uint8)
        sizes = np.array([n for _, n in self._docs], dtype="<i8")
        docs = zstandard.ZstdCompressor(level=LEVEL).compress(names.tobytes() + told.tobytes() + sizes.tobytes())
        at = len(self._out)
        check = zlib.crc32(self._index, zlib.crc32(docs))
        self._out += docs + self._index
        self._out += _TRAILER.pack(at, at + len(docs), len(self._docs), self.ids, self._blocks, self.part, self.number, check)
        return bytes(self._out)


class Reader:
    """One file's documents and ids. Raises ValueError if the file is damaged."""

    def __init__(self, data: bytes):
        end = len(data) - len(CLOSING) - _TRAILER.size
        if data[: len(OPENING)] != OPENING or data[-len(CLOSING) :] != CLOSING or end < len(OPENING):
            raise ValueError("not a file of planes, or cut short")
        docs_at, index_at, n, self.ids, blocks, self.part, self.number, check = _TRAILER.unpack_from(data, end)
        if not len(OPENING) <= docs_at <= index_at <= end or zlib.crc32(data[docs_at:end]) != check:
            raise ValueError("the tables of a file of planes are damaged")
        raw = zstandard.ZstdDecompressor().decompress(data[docs_at:index_at], max_output_size=17 * n + 1)
        self.data = data
        self.names = np.ma.masked_array(np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n) == 0).tolist() if n else []
        self.sizes = np.frombuffer(raw, "<i8", n, 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.index, at = [], index_at
        for _ in range(blocks):
            n_ids, crc, offset, kind, planes = _BLOCK.unpack_from(data, at)
            at += _BLOCK.size
            self.index.append((n_ids, crc, offset, kind, struct.unpack_from(f"<{planes}I", data, at)))
            at += 4 * planes
        self.block_starts = np.concatenate([[0], np.cumsum([b[0] for b in self.index], dtype=np.int64)])

    def block(self, number: int) -> np.ndarray:
        n, crc, offset, kind, sizes = self.index[number]
        press, planes = zstandard.ZstdDecompressor(), []
        for size in sizes:
            planes.append(press.decompress(self.data[offset : offset + size], max_output_size=n + 8))
            offset += size
        ids = ids_of(planes, kind, n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {number} does not match its checksum")
        return ids

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the file, from the blocks that hold them."""
        parts = [p for _, p in self.pieces(start, stop)]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def pieces(self, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        at = int(np.searchsorted(self.block_starts, start, side="right")) - 1
        while start < stop:
            first = int(self.block_starts[at])
            part = self.block(at)[start - first : stop - first]
            yield start, part
            start, at = start + len(part), at + 1

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, start in the file, its ids in stretches) of every document; one
        block is open at a time."""
        stream = self.pieces(0, self.ids)
        open_at, piece = 0, np.zeros(0, "<u4")
        for name, start, size in zip(self.names, self.starts.tolist(), self.sizes.tolist()):
            parts, at = [], start
            while at < start + size:
                if at >= open_at + len(piece):
                    open_at, piece = next(stream)
                part = piece[at - open_at : start + size - open_at]
                parts.append(part)
                at += len(part)
            yield name, start, parts


# ---------------------------------------------------------------- tables


def _encoded(column: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of each text. Long texts are cut where a white space follows a
    visible character: the pre-tokeniser always splits there."""
    use, (data, ends) = codec(path), packed(column)
    raw, points, out = data.tobytes(), None, []
    for at, stop in zip(ends.tolist(), ends[1:].tolist()):
        ids = []
        while at < stop:
            to = stop
            if stop - at > PIECE_BYTES:
                points = agreement(data, ends) if points is None else points
                near = int(np.searchsorted(points, at + PIECE_BYTES, side="right")) - 1
                to = int(points[near]) if points[near] > at else int(points[near + 1])
            ids.append(np.array(use.ids(raw[at:to]), dtype="<u4"))
            at = to
        out.append(np.concatenate(ids) if ids else np.zeros(0, "<u4"))
    return out


def token_ids(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, planes) of every row: the byte planes of its ids with
    ``end_id`` appended, as many as its largest id needs, lowest first, compressed."""
    last = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", 1 << 20):
            ids = [np.concatenate([x, last]) for x in _encoded(b.column("text"), vocabulary)]
            press = zstandard.ZstdCompressor(level=1)
            planes = [press.compress(b"".join(planes_of(x, BYTES))) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(planes, pa.binary())], names=["doc_id", "n_tokens", "planes"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return balanced(slim).mapInArrow(run, "doc_id long, n_tokens long, planes binary")


def write_ids(tokens: DataFrame, path: str, kind: int = BYTES) -> None:
    """Writes (doc_id, n_tokens, planes) as files under ``path``, in ascending order of doc_id."""
    spark, scratch = tokens.sparkSession, Scratch(tokens.sparkSession)
    # written once: a row's number then holds, and deals out the copies of one doc_id
    kept = scratch.keep(tokens.withColumn("row", F.monotonically_increasing_id()), "ids", "zstd")
    total = kept.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, total // PART_IDS + 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    dealt = kept.select("doc_id", "row", "n_tokens", "planes").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = Writer(TaskContext.get().partitionId(), 0, kind)
        for b in batches:
            for doc_id, n, planes in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("planes").to_pylist()):
                raw = zstandard.ZstdDecompressor().decompress(planes, max_output_size=4 * n + 1)
                made.add(doc_id, ids_of([raw[at : at + n] for at in range(0, len(raw), n)] if n else [], BYTES, n))
                if made.ids >= FILE_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([made.finish()], pa.binary())], names=["file"])
                    made = Writer(made.part, made.number + 1, kind)
        if made._docs:
            yield pa.RecordBatch.from_arrays([pa.array([made.finish()], pa.binary())], names=["file"])

    files = dealt.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("file"))
    files.write.option("lineSep", CLOSING.decode()).option("maxRecordsPerFile", 1).text(path)
    scratch.drop(kept)


def _read(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, schema)


def _placed(found: DataFrame) -> DataFrame:
    """Replaces the place in a file (part, number, start) by that among all ids:
    first the files' sums within partitions, then the partitions'."""
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    in_part = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.withColumn("own", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(parts.select("part", "before"), "part")
    placed = found.join(files.select("part", "number", (F.col("before") + F.col("own")).alias("base")), ["part", "number"])
    return placed.withColumn("start", F.col("base") + F.col("start")).drop("base", "part", "number")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                file = Reader(content.as_py())
                for name, start, parts in file.documents():
                    ids = b"".join(p.tobytes() for p in parts)
                    yield pa.RecordBatch.from_arrays([pa.array([file.part], pa.int32()), pa.array([file.number], pa.int32()), pa.array([name], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())], names=["part", "number", "doc_id", "start", "n_tokens", "ids"])

    return _placed(Scratch(spark).keep(_read(spark, path, run, "part int, number int, doc_id long, start long, n_tokens long, ids binary"), "read"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' ids;
    no document's ids are held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                file = Reader(content.as_py())
                crcs = []
                for _, _, parts in file.documents():
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.tobytes(), crc)
                    crcs.append(crc)
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.part] * n, pa.int32()), pa.array([file.number] * n, pa.int32()), pa.array(file.names, pa.int64()), pa.array(file.starts[:-1], pa.int64()), pa.array(file.sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return _placed(Scratch(spark).keep(_read(spark, path, run, "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long"), "read"))


def op13_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("planes")
    write_ids(token_ids(table(spark, sf_dir, "documents"), default_vocabulary()), path)
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
