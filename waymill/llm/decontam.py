"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct word shingles (a class
for each power of two). An item's sketch is its smallest hashes; the class's
upper size bound sets the sketch's length. An item of n shingles of which at
least ``threshold`` are in a document misses at most n - ceil(threshold * n) of
them, so a longer sketch must meet the document: the number of sketch hashes
found is never below length - misses, and the search loses no pair. Documents
of any length are looked up shingle by shingle in the sketches, and what
reaches its item's count is verified by exact containment of the shingles'
words.

The sketches and items of a block are sent to all executors; a block holds at
most BLOCK_HASHES hashes and its items' texts. A larger benchmark is searched
block after block, each by a scan whose result is written before the next block
is sent, so driver and executors hold one block at a time.

Words are runs of ASCII letters, digits and other non-ASCII characters of the
lower-cased text. An item of fewer than ``size`` words is one shingle of
all its words; one without words matches nothing. Repeated benchmark rows count
once; texts of one item_id are items of their own; repeated documents each have
their rows. Null texts have no words; null ids pass through; other columns are
kept by ``drop_contaminated`` and ignored by ``contaminations``. Whole texts are
read, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, balanced, shingle_hashes, steps, table, word_hashes

SIZE, THRESHOLD = 5, 0.8
BLOCK_HASHES = 2_000_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(lowered: str | None) -> list[bytes]:
    return _WORDS.findall((lowered or "").encode())


def shingles(tokens: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)}


def missing(n: int, threshold: float) -> int:
    """How many of n shingles may be absent at ``threshold``."""
    return n - math.ceil(threshold * n - 1e-9)


class Block:
    """Sketches and exact shingles of some items."""

    def __init__(self, items: list[tuple[int, str]], size: int, threshold: float):
        self.threshold = threshold
        self.items: list[tuple[int, int, set[bytes]]] = []
        lowered = pc.utf8_lower(pa.array([text for _, text in items], pa.string())).to_pylist()
        for (item_id, _), text in zip(items, lowered):
            tokens = words(text)
            k = min(size, len(tokens))
            if k:
                self.items.append((item_id, k, shingles(tokens, k)))
        self.by_size = {}
        for k in sorted({k for _, k, _ in self.items}):
            pairs, least = [], np.zeros(len(self.items), dtype=np.int64)
            for at, (_, own, parts) in enumerate(self.items):
                if own != k:
                    continue
                texts = pa.array([p.decode() for p in sorted(parts)])
                h, bounds = word_hashes(texts)
                h = np.unique(shingle_hashes(h, bounds, k)[0])
                bound = 1 << (len(parts) - 1).bit_length()  # upper size of the item's class
                length = min(len(h), missing(bound, threshold) + 2)
                least[at] = max(1, length - missing(len(parts), threshold))
                pairs += [(x, at) for x in h[:length].tolist()]
            pairs.sort()
            hashes = np.array([x for x, _ in pairs], dtype=np.uint64)
            unique, first = np.unique(hashes, return_index=True)
            self.by_size[k] = (unique, np.append(first, len(pairs)), np.array([i for _, i in pairs], dtype=np.int64), least)

    def candidates(self, column: pa.Array) -> list[tuple[int, int]]:
        """(row, item) pairs of lower-cased texts whose sketches meet often enough."""
        if not self.by_size:
            return []
        h, bounds = word_hashes(column)
        out = []
        for k, (unique, first, item_of, least) in self.by_size.items():
            s, at = shingle_hashes(h, bounds, k)
            pos = np.searchsorted(unique, s)
            pos[pos == len(unique)] = 0
            hit = np.flatnonzero(unique[pos] == s)
            if not len(hit):
                continue
            row = np.searchsorted(at, hit, side="right") - 1
            met = np.unique(row * np.int64(len(unique)) + pos[hit])  # a shingle counts once in a text
            row, pos = met // len(unique), met % len(unique)
            n = first[pos + 1] - first[pos]
            row = np.repeat(row, n)
            item = item_of[np.repeat(first[pos] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pair, count = np.unique(row * np.int64(len(self.items)) + item, return_counts=True)
            pair = pair[count >= least[pair % len(self.items)]]
            out += zip((pair // len(self.items)).tolist(), (pair % len(self.items)).tolist())
        return out

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item_id, shingles of the item, of them in the row's text) of all
        pairs at the threshold, verified on the words themselves."""
        column = pc.utf8_lower(column)
        out, at, own = [], -1, {}
        for row, item in sorted(self.candidates(column)):
            item_id, k, parts = self.items[item]
            if row != at:
                at, own, tokens = row, {}, words(column[row].as_py())
            if k not in own:
                own[k] = shingles(tokens, k)
            shared = len(parts & own[k])
            if len(parts) - shared <= missing(len(parts), self.threshold):
                out.append((row, item_id, len(parts), shared))
        return out


def blocks(benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text") -> Iterator:
    """The items' blocks, one after the other, broadcast, and how many there are. The number of words bounds that of shingles."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / 2 / BLOCK_HASHES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        rows = [(r.item_id, r.text) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect()]
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Block(rows, size, threshold)), n


def contaminations(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every document
    and item of which at least ``threshold`` of the shingles are in it."""
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    slim = balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    scratch, out = Scratch(docs.sparkSession), None
    for block, n in blocks(benchmark, size, threshold):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in steps(batches, "text"):
                if found := block.value.search(b.column("text")):
                    row, item, n, shared = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / k for s, k in zip(shared, n)], pa.float64())],
                        names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                    )

        part = slim.mapInArrow(run, schema)
        if n > 1:
            part = scratch.keep(part, "found")
            block.destroy()
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no test item."""
    scratch, out = Scratch(docs.sparkSession), balanced(docs)
    for block, n in blocks(benchmark, size, threshold):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in steps(batches, text_col):
                clean = np.ones(b.num_rows, dtype=bool)
                clean[[row for row, *_ in block.value.search(b.column(text_col))]] = False
                yield b.filter(pa.array(clean))

        new = out.mapInArrow(run, docs.schema)
        if n > 1:
            new = scratch.keep(new, "clean")
            block.destroy()
            scratch.drop(out)
        out = new
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same pairs from the words themselves; documents by row, items by id and text.
ORACLE_SQL = f"""
WITH w AS (SELECT 'd' AS kind, row_number() OVER () AS row_id, doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents
           UNION ALL SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') FROM (SELECT DISTINCT item_id, text FROM benchmark)),
items AS (SELECT row_id AS item_row, id AS item_id, least(len(ws), {SIZE}) AS k, ws FROM w WHERE kind = 'b' AND len(ws) > 0),
item_parts AS (SELECT DISTINCT item_row, k, array_to_string(ws[i:i + k - 1], ' ') AS part FROM (SELECT item_row, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM items),
doc_parts AS (SELECT DISTINCT row_id, k, array_to_string(ws[i:i + k - 1], ' ') AS part FROM (SELECT row_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes WHERE kind = 'd' AND len(ws) >= k)),
n AS (SELECT item_row, count(*) AS n_shingles FROM item_parts GROUP BY item_row),
met AS (SELECT row_id, item_row, count(*) AS n_shared FROM doc_parts JOIN item_parts USING (k, part) GROUP BY ALL)
SELECT w.id AS doc_id, items.item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM met JOIN n USING (item_row) JOIN items USING (item_row) JOIN w ON w.kind = 'd' AND w.row_id = met.row_id WHERE n_shared >= {THRESHOLD} * n_shingles - 1e-9
"""
