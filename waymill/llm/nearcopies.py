"""The pipeline's form of operator 1: near copies by 5-word shingles.

Two texts are linked if the Jaccard similarity of their shingles (lower-cased
runs of SIZE words between white space; a shorter text is one shingle) is at
least LEAST. Operator 1's SimHash links (fingerprints of the same shingles, 4
bits, pigeonring chains) propose pairs, but at a similarity of 0.8 fingerprints
differ in about 10 of 64 bits, which no pigeonring key can reach. So pairs are
also proposed by MinHash: candidates share one of BANDS keys, each made of ROWS
minimum hashes; a pair at 0.8 shares none with a probability of
(1 - 0.8 ** ROWS) ** BANDS, 5e-8. The exact similarity of the two texts decides.

Components are what is wanted, so a large group is not compared pair by pair.
SimHash links and each key's members against its hub (the member whose keys
have the most members: the text that others are copies of) come first. Of keys
that this does not connect, the texts outside the largest component are then
compared with the key's others, in cells of sketches: the 32-bit hashes of all
shingles, or of SKETCH of a longer text's by value. A sketch of all shingles
never understates a similarity, a sample does by more than SLACK with a
probability below 1e-7; what passes is verified on the texts.

Rows: null text counts as empty, and texts without words are equal; equal texts
are one node; a row without doc_id links like any other but never stands for its
component, and stays; an id on several rows names each of them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER, Scratch, balanced, connected_components, mixed, one_of_each, packed, run_hashes, runs, shingle_hashes, steps

SIZE, BANDS, ROWS = 5, 32, 4
#: The similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Hashes in a text's sketch, and what a sample of a longer text's may understate.
SKETCH, SLACK = 512, 0.13
#: Texts of a cell: those outside the largest component, and those that they meet.
FEW, MANY = 256, 1024
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_rng = np.random.default_rng(17)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, one at least, and the n+1 bounds."""
    data, ends = packed(column)
    data = LOWER[data]
    starts, stops, bounds = runs(data, ends, _WORD)
    words = run_hashes(data, starts, stops)
    found, out = shingle_hashes(words, bounds, size)
    short = np.flatnonzero(np.diff(out) == 0)
    whole = []
    for i in short.tolist():
        h = 0
        for w in words[bounds[i] : bounds[i + 1]].tolist():
            h = (h * 0xD6E8FEB86659FD93 + w + 1) & 0xFFFFFFFFFFFFFFFF
        whole.append(h)
    found = np.insert(found, out[short], np.array(whole, dtype=np.uint64))
    out[1:] += np.cumsum(np.diff(out) == 0)
    return found, out


def band_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of the texts' shingles."""
    keys = np.zeros((len(bounds) - 1, BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BANDS * ROWS):
            low = np.minimum.reduceat((h ^ _XOR[i]) * _TIMES[i], bounds[:-1])
            keys[:, i // ROWS] = mixed(keys[:, i // ROWS] + low + np.uint64(i + 1))
    return keys


def simhashes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprints of the texts' shingles: bits set in over half of the hashes."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    for i in range(64):
        ones = np.add.reduceat((h >> np.uint64(i) & np.uint64(1)).astype(np.int64), bounds[:-1])
        out |= (ones * 2 > np.diff(bounds)).astype(np.uint64) << np.uint64(i)
    return out


def sketch(h: np.ndarray) -> tuple[int, int, bytes]:
    """Of a text's shingle hashes: how many are distinct, the level (hashes below
    2 ** (32 - level) are kept, SKETCH at most), and those kept, as 32 bits."""
    own = np.unique(h)
    level = max(0, int(np.ceil(np.log2(len(own) / SKETCH))))
    while (n := int(np.searchsorted(own, np.uint64(1 << (64 - level)))) if level else len(own)) > SKETCH:
        level += 1
    return len(own), level, (own[:n] >> np.uint64(32)).astype(np.uint32).tobytes()


def are_near(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether each two texts' similarity is at least LEAST, exactly."""
    (x, p), (y, q) = shingles(a), shingles(b)
    out = np.zeros(len(a), dtype=bool)
    for i in range(len(a)):
        left, right = np.unique(x[p[i] : p[i + 1]]), np.unique(y[q[i] : q[i + 1]])
        both = len(np.intersect1d(left, right, assume_unique=True))
        out[i] = both * LEAST[1] >= (len(left) + len(right) - both) * LEAST[0]
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "text"):
        h, bounds = shingles(b.column("text"))
        keys, fp = band_keys(h, bounds), simhashes(h, bounds)
        at = pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))], names=["node", "fp", "keys"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "text"):
        h, bounds = shingles(b.column("text"))
        size, level, kept = zip(*(sketch(h[s:e]) for s, e in zip(bounds, bounds[1:])))
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(size, pa.int64()), pa.array(level, pa.int32()), pa.array(kept, pa.binary())], names=["node", "size", "level", "sketch"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for half in steps([batch], "a"):
            for b in steps([half], "b"):
                ok = pa.array(are_near(b.column("a"), b.column("b")))
                yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], names=["u", "v"])


def similar(lead: np.ndarray, part: np.ndarray, size: np.ndarray, level: np.ndarray, sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lead, other) places of a cell's rows that may be near: of different
    parts, and similar enough by sizes and sketches."""
    out_p, out_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    least = LEAST[0] / LEAST[1]
    for top in np.unique(level).tolist():
        rows = np.flatnonzero(level <= top)
        own = [sketches[i] if level[i] == top else sketches[i][sketches[i] < np.uint32(1 << (32 - top))] for i in rows]
        count = np.array([len(x) for x in own])
        values, at = np.unique(np.concatenate(own), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), count)
        is_lead = lead[rows]
        # a hash counts if a lead and another row have it
        often = (np.bincount(at, minlength=len(values)) > 1) & (np.bincount(at, weights=is_lead[row], minlength=len(values)) > 0)
        place = np.cumsum(often) - 1
        used = often[at]
        row, col = row[used], place[at[used]]
        leads = np.flatnonzero(is_lead)
        both = np.zeros((len(leads), len(rows)), dtype=np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for first in range(0, int(often.sum()), 8192):
            s, e = np.searchsorted(col, [first, first + 8192])
            x = np.zeros((len(rows), 8192), dtype=np.float32)
            np.add.at(x, (row[s:e], col[s:e] - first), 1)
            both += x[leads] @ x.T
        # hashes that sketches repeat (equal 32 bits) count more often: similarities are overstated at most
        both = np.minimum(both, np.minimum(count[leads][:, None], count[None, :]))
        share = both / np.maximum(count[leads][:, None] + count[None, :] - both, 1)
        n, m = size[rows][leads][:, None], size[rows][None, :]
        ok = (part[rows][leads][:, None] != part[rows][None, :]) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9)
        ok &= (np.maximum(level[rows][leads][:, None], level[rows][None, :]) == top) & (share >= (least - 1e-6 if top == 0 else least - SLACK))
        p, q = np.nonzero(ok)
        out_p.append(rows[leads[p]])
        out_q.append(rows[q])
    return np.concatenate(out_p), np.concatenate(out_q)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, node, lead, part, size, level, sketch) sorted by the
    first two: pairs (u, v) of a cell that may be near."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key, cell, node, lead, part, size, level = (t.column(c).to_numpy() for c in ("key", "cell", "node", "lead", "part", "size", "level"))
        sketches = [np.frombuffer(x, dtype=np.uint32) for x in t.column("sketch").to_pylist()]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), [True])))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(first, first[1:]):
            p, q = similar(lead[s:e], part[s:e], size[s:e], level[s:e], sketches[s:e])
            us.append(node[s:e][p])
            vs.append(node[s:e][q])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        if held and (key[0] != held[-1].column("key")[-1].as_py() or cell[0] != held[-1].column("cell")[-1].as_py()):
            yield done(held)
            held = []
        last = (key == key[-1]) & (cell == cell[-1])
        cut = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield done([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield done(held)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_near, "u long, v long")


def _proposed(nodes: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of operator 1's links and of each key's members with its hub."""
    fps = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    bits = simhash.links(fps, scratch)
    bits = bits.join(fps.select(F.col("fp").alias("a"), F.col("low").alias("u")), "a").join(fps.select(F.col("fp").alias("b"), F.col("low").alias("v")), "b").select("u", "v")
    equal = nodes.join(fps, "fp").select(F.col("low").alias("u"), F.col("node").alias("v"))
    popular = members.groupBy("node").agg(F.sum("n").alias("popular"))
    hubs = members.join(popular, "node").groupBy("key").agg(F.max(F.struct("popular", "node")).alias("hub")).select("key", F.col("hub.node").alias("u"))
    stars = members.join(hubs, "key").select("u", F.col("node").alias("v"))
    pairs = bits.unionAll(equal).unionAll(stars).where("u <> v")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _rest(members: DataFrame, comps: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) that may be near, of keys whose members are not one component."""
    parts = members.join(comps, members.node == comps.id, "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    sizes = parts.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"))
    split = sizes.where("n > top.n").select("key", F.col("top.part").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / FEW).cast("long").alias("few"), F.ceil(F.col("n") / MANY).cast("long").alias("many"))
    parts = scratch.keep(parts.join(split, "key"), "parts")
    sketches = scratch.keep(texts.join(parts.select("node").distinct(), "node", "left_semi").mapInArrow(_sketched, "node long, size long, level int, sketch binary"), "sketches")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    over = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    leads = parts.where("part <> top").withColumn("o", over("many")).select("key", (at("few") * F.col("many") + F.col("o")).alias("cell"), "node", F.lit(True).alias("lead"), "part")
    others = parts.withColumn("o", over("few")).select("key", (F.col("o") * F.col("many") + at("many")).alias("cell"), "node", F.lit(False).alias("lead"), "part")
    dealt = leads.unionAll(others).join(sketches, "node").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.select("key", "cell", "node", "lead", "part", "size", "level", "sketch").mapInArrow(_met, "u long, v long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but near copies: of each component the row with the
    smallest doc_id stays. All columns are kept."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    nodes = scratch.keep(balanced(slim.select("node", "text")).mapInArrow(_keyed, "node long, fp long, keys array<long>").dropDuplicates(["node"]), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.keep(keyed.join(shared, "key"), "members")
    others = scratch.keep(members.select("node").distinct(), "others")
    texts = scratch.keep(slim.select("node", "text").join(others, "node", "left_semi").dropDuplicates(["node"]), "texts")
    pairs = scratch.keep(_proposed(nodes.select("node", "fp").join(others, "node", "left_semi"), members, scratch), "pairs")
    links = scratch.keep(_linked(pairs, texts), "links")
    comps = connected_components(links, scratch)
    rest = scratch.keep(_rest(members, comps, texts, scratch), "rest")
    comps = connected_components(links.unionAll(scratch.keep(_linked(rest, texts), "links")), scratch)
    found = slim.select("doc_id", "node").join(comps, F.col("node") == F.col("id"), "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    return one_of_each(docs, found, scratch, id_col, text_col)
