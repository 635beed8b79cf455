"""Spelling variants by Levenshtein automata over trie shards.

Words and their numbers are counted in Spark. The counted words, sorted, are cut
into shards: compact tries, each a few arrays with the children of a node side
by side. Blocks of shards of BLOCK_BYTES are broadcast one after the other, and
every word's automaton is run through every shard of the block, depth first.
Each word's neighbours in a block are reduced to their number and the best one;
the blocks' results are added up by word.

The automaton accepts what is exactly one inserted, deleted or replaced code
point away. Its exact state is one position; its states after an error are the
three positions around it, so a step costs the same in words of any length. Near
a root an automaton that allows errors would enter most of the trie. So it is
run twice: with its errors in the word's second half over shards of words, and
with its errors in the first half over shards of reversed words. A neighbour
whose first difference from the word is at or behind the middle is told by the
first run, any other by the second, and none by both.

A word's form has at least FACTOR times its number, so chains of forms are short
and free of cycles; they are followed by joins that double their reach.

Rows: null texts have no words; a missing doc_id is an empty one in the digest
that plants slips; repeated rows count as often as they stand; other columns
are ignored; an empty table gives no rows. Of neighbours with equal numbers the
smallest in code-point order is the form. A word longer than a shard is one by
itself; memory for a block is BLOCK_BYTES or that of its longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One of so many occurrences loses a letter.
SLIP = 199
#: Nodes of a shard (its last word may exceed them), and bytes of the shards that are broadcast together.
SHARD_NODES, BLOCK_BYTES = 500_000, 64 << 20
#: Letters of a shard's first and last word that tell whether a word can have neighbours in it.
EDGE = 64
#: Words that a task looks up at a time.
TASK_WORDS = 20_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words that occur at least ``least`` times."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    # a slip only shortens a run, so shorter ones can't become words
    lower = runs.where(F.length("run") >= LEAST_LETTERS).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = lower.withColumn("h", h).select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- tries


class Trie:
    """A trie in level order: node v's children are ``first[v]`` to ``first[v + 1]``,
    sorted by ``label``; ``word[v]`` is the number of the word that ends there, or -1."""

    def __init__(self, blob: bytes):
        nodes, own = np.frombuffer(blob, dtype="<i8", count=2).tolist()
        view, at = memoryview(blob), 16
        self.label = bytes(view[at : at + nodes])
        at += -(-nodes // 8) * 8
        ints = []
        for n in (nodes + 1, nodes, nodes):
            ints.append(view[at : at + 4 * n].cast("i"))
            at += -(-4 * n // 8) * 8
        self.first, self.parent, self.word = ints
        self.n = view[at : at + 8 * own].cast("q")

    def text(self, v: int) -> bytes:
        """The word that ends at a node."""
        out = bytearray()
        while v:
            out.append(self.label[v])
            v = self.parent[v]
        out.reverse()
        return bytes(out)


def _padded(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def packed_trie(sorted_words: list[bytes], numbers: list[int]) -> bytes:
    """The bytes of the Trie of distinct, ascending, one-byte-a-letter words."""
    label, depth, parent, ends = bytearray(1), [0], [0], []
    path, last = [0], b""
    for w in sorted_words:
        common, most = 0, min(len(w), len(last))
        while common < most and w[common] == last[common]:
            common += 1
        del path[common + 1 :]
        for d in range(common, len(w)):
            label.append(w[d])
            depth.append(d + 1)
            parent.append(path[-1])
            path.append(len(depth) - 1)
        ends.append(path[-1])
        last = w
    order = np.argsort(np.array(depth, dtype=np.int32), kind="stable")
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    above = rank[np.array(parent, dtype=np.int32)[order]]
    first = np.zeros(len(order) + 1, dtype=np.int32)
    np.cumsum(np.bincount(above[1:], minlength=len(order)), out=first[1:])
    first += 1  # the root is nobody's child
    word = np.full(len(order), -1, dtype=np.int32)
    word[rank[np.array(ends, dtype=np.int64)]] = np.arange(len(ends), dtype=np.int32)
    head = np.array([len(order), len(ends)], dtype="<i8").tobytes()
    return head + _padded(np.frombuffer(bytes(label), dtype=np.uint8)[order]) + b"".join(_padded(x.astype("<i4")) for x in (first, above, word)) + np.array(numbers, dtype="<i8").tobytes()


def one_away(word: bytes, trie: Trie, exact: int) -> Iterator[int]:
    """The nodes of the trie's words that are exactly one edit from ``word`` and
    begin with its first ``exact`` letters, depth first."""
    label, first, ends, size = trie.label, trie.first, trie.word, len(word)
    v = 0
    for d in range(exact):
        v = label.find(word[d], first[v], first[v + 1])
        if v < 0:
            return
    # a state: node, depth, whether no error was made yet, and whether, after one, depth - 1, depth or depth + 1 letters are read
    stack = [(v, exact, True, False, False, exact < size)]
    while stack:
        v, d, clean, short, even, ahead = stack.pop()
        if ends[v] >= 0 and not (clean and d == size) and (short and d - 1 == size or even and d == size or ahead and d + 1 == size):
            yield v
        lo, hi = first[v], first[v + 1]
        if lo == hi:
            continue
        here = word[d] if d < size else -1
        before = word[d - 1] if short and d - 1 < size else -1
        after = word[d + 1] if ahead and d + 1 < size else -1
        if clean:  # any child: its letter is right, replaced, or one too many
            longer = d + 1 < size
            for u in range(lo, hi):
                x = label[u]
                right = x == here
                stack.append((u, d + 1, right, True, d < size or even and right, x == after or right and longer))
            continue
        wanted = {before, here if even else -1, after}
        wanted.discard(-1)
        for x in wanted:
            u = label.find(x, lo, hi)
            if u >= 0:
                stack.append((u, d + 1, False, x == before, even and x == here, x == after))


def neighbours(word: bytes, forward: list[Trie], backward: list[Trie]) -> Iterator[tuple[bytes, int]]:
    """(neighbour, its number) of the word in the shards, each once."""
    half = len(word) // 2
    for trie in forward:
        for v in one_away(word, trie, half):
            yield trie.text(v), trie.n[trie.word[v]]
    turned = word[::-1]
    for trie in backward:
        for v in one_away(turned, trie, len(word) - half):
            other = trie.text(v)[::-1]
            if other[:half] != word[:half]:  # else the other run tells it
                yield other, trie.n[trie.word[v]]


# ---------------------------------------------------------------- shards


_SHARD_COLUMNS = ["part", "number", "backward", "low", "high", "words", "bytes", "trie"]


def shards(counted: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """(part, number, backward, low, high, words, bytes, trie): the tries of all
    words and of all reversed words, in sorted runs of SHARD_NODES nodes; low and
    high enclose a shard's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        numbers: list[int] = []
        nodes, turned = 0, False

        def shard() -> pa.RecordBatch:
            nonlocal made, nodes
            blob = packed_trie(held, numbers)
            low, high = held[0][:EDGE].decode("latin-1"), held[-1][:EDGE].decode("latin-1") + "\U0010ffff"
            row = [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([turned]), pa.array([low]), pa.array([high]), pa.array([len(held)], pa.int64()), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())]
            held.clear()
            numbers.clear()
            made, nodes = made + 1, 0
            return pa.RecordBatch.from_arrays(row, names=_SHARD_COLUMNS)

        for b in batches:
            for back, key, n in zip(b.column("backward").to_pylist(), b.column("key").to_pylist(), b.column("n").to_pylist()):
                if held and (nodes >= SHARD_NODES or back != turned):
                    yield shard()
                held.append(key.encode("latin-1"))
                numbers.append(n)
                nodes, turned = nodes + len(key), back
        if held:
            yield shard()

    both = counted.select(F.lit(False).alias("backward"), F.col("word").alias("key"), "n").unionAll(counted.select(F.lit(True).alias("backward"), F.reverse("word").alias("key"), "n"))
    dealt = both.repartitionByRange(partitions, "backward", "key").sortWithinPartitions("backward", "key")
    return scratch.keep(dealt.mapInArrow(run, "part int, number int, backward boolean, low string, high string, words long, bytes long, trie binary"), "tries")


def blocks(tries: DataFrame) -> list[list[Row]]:
    """The shards that are broadcast together, by name and borders. There is one row
    a shard, so the list is shorter than the words by four orders of magnitude."""
    out: list[list[Row]] = [[]]
    size = 0
    for r in tries.drop("trie").orderBy("part", "number").toLocalIterator():
        if out[-1] and size + r.bytes > BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r.bytes
    return [b for b in out if b]


def _may_meet(block: list[Row]) -> Column:
    """Whether a word's automaton can pass the borders of the block's shards: words
    that begin with its exact letters lie between them."""
    half = F.floor(F.length("word") / 2)
    meets = F.lit(False)
    for back in (False, True):
        if mine := [r for r in block if r.backward == back]:  # in order: the shards between are enclosed
            key = F.substring(F.reverse("word") if back else F.col("word"), F.lit(1), (F.length("word") - half if back else half).cast("int"))
            meets |= (key <= mine[-1].high) & ((key >= mine[0].low) | F.startswith(F.lit(mine[0].low), key))
    return meets


def _search(counted: DataFrame, tries: DataFrame, block: list[Row]) -> tuple[DataFrame, Broadcast]:
    """(word, n_near, best_n, best) of every word with neighbours in one block of shards."""
    spark = counted.sparkSession
    name = F.struct("part", "number")
    at = lambda r: F.struct(F.lit(r.part), F.lit(r.number))
    mine = tries.where(name.between(at(block[0]), at(block[-1])))  # consecutive names
    sent = spark.sparkContext.broadcast([(r.backward, bytes(r.trie)) for r in mine.select("backward", "trie").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = [Trie(blob) for back, blob in sent.value if not back]
        backward = [Trie(blob) for back, blob in sent.value if back]
        for b in batches:
            out: list[tuple] = []
            for word in b.column("word").to_pylist():
                found, best, most = 0, b"", -1
                for other, m in neighbours(word.encode("latin-1"), forward, backward):
                    found += 1
                    if m > most or m == most and other < best:
                        best, most = other, m
                if found:
                    out.append((word, found, most, best.decode("latin-1")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    # words cost far more than their bytes suggest: they are dealt out by number
    parts = max(spark.sparkContext.defaultParallelism, sum(r.words for r in block) // TASK_WORDS + 1)
    dealt = counted.select("word").where(_may_meet(block)).repartition(parts, "word")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string"), sent


def near_words(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, n_near, form, form_n) of all rows of ``counted`` (word, n), a kept table."""
    letters = counted.agg(F.sum(F.length("word"))).first()[0] or 0
    tries = shards(counted, scratch, max(1, 2 * letters // (4 * SHARD_NODES)))
    found = None
    for block in blocks(tries):
        part, sent = _search(counted, tries, block)
        part = scratch.keep(part, "near")
        sent.destroy()
        found = part if found is None else found.unionAll(part)
    scratch.drop(tries)
    none = {"n_near": F.lit(0).cast("long"), "form": F.lit(None).cast("string"), "form_n": F.lit(None).cast("long")}
    if found is None:
        return counted.withColumns(none)
    # the best is the largest number, then the smallest word: the least of (-number, word)
    least = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    told = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least)
    whole = counted.join(told, "word", "left")
    form: Column = (-F.col("b.m") >= FACTOR * F.col("n")) & F.col("b").isNotNull()
    return whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("b.w")).alias("form"), F.when(form, -F.col("b.m")).alias("form_n"))


def with_roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``root``: the last word of the chain of forms, the word itself without one."""
    links = scratch.keep(found.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = scratch.keep(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        scratch.drop(links)
        links = joined
        if not joined.where("moved").limit(1).count():
            break
    return found.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(words(docs, id_col, text_col), "words")
    found = scratch.keep(near_words(counted, scratch), "variants")
    return with_roots(found, scratch).select("word", "form", "root", "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The digest is computed byte by byte from its table of 256 entries.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r WHERE length(run) >= 6),
b AS (SELECT run, flatten(list_transform(string_split(d || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)) AS b FROM l),
h AS (SELECT run, xor(list_reduce(b, lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
n AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING count(*) >= 5),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, n.word, n.n FROM v a JOIN n ON a.less = n.word UNION SELECT n.word, n.n, a.word, a.n FROM v a JOIN n ON a.less = n.word),
o AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM p),
f AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n.n THEN other END AS form, CASE WHEN m >= 5 * n.n THEN m END AS form_n FROM n LEFT JOIN o ON o.word = n.word AND k = 1),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""
