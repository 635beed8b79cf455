"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into RING segments that form a ring. If two fingerprints
differ in at most ``distance`` bits, some segment starts a chain whose first l
segments differ in at most floor(l * distance / RING) bits, for every l. The
first CHAIN segments of such a chain are the join key, at every corpus size: a
row probes every key within the chain's budgets, 37 rows a fingerprint. The
longer prefixes of the chain prune candidates, and only what survives gets the
full Hamming check.

A hot key (more than CELL owners and probes) is compared in two passes. First
its rows are dealt out over cells of about CELL rows, each with the key's
smallest owner as a pivot; that connects a dense group. Then the rows outside
the key's largest component, and only they, meet all of the key's rows, in
cells again. No link is lost, no row is in a cell of unbounded size, and what
a dense group costs grows with its stragglers rather than its square.

Components are those of fingerprints; they are named by the smallest doc_id of
their rows. Rows: null text counts as empty; a text without words has
fingerprint zero, which links like any other; repeated rows share a fingerprint
and so a component; rows of one doc_id with different texts are rows of their
own; a row without doc_id links like any other and gets its component, but
never names one (a component of such rows alone has none). Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, balanced, connected_components, one_of_each, steps, table

RING = 5
_WIDTHS = [13, 13, 13, 13, 12]
_FROM = np.cumsum([0, *_WIDTHS])[:-1]
SEGMENTS = [((1 << w) - 1) << int(s) for w, s in zip(_WIDTHS, _FROM)]
#: Segments of the join key.
CHAIN = 2
#: Rows of a key beyond which it is dealt out over cells of about so many.
CELL = 4096
#: Hot keys up to this number (16 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, size: int = 4) -> int:
    """64 bits: bit i is set if it is in over half the XXH64 (seed 42) of the
    ``size`` word shingles, repeats included."""
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(buf, 42)
    stop = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    start = np.concatenate(([0], stop[: len(words) - size] + 1)).tolist()
    stop = stop[size - 1 :].tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(start), 1 << 14):
        to = at + (1 << 14)
        h = np.array([digest(buf[s:e], 42) for s, e in zip(start[at:to], stop[at:to])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            fp = np.array([fingerprint((t or "").encode(), size) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, fp long")


def chain_masks(start: int, chain: int, distance: int) -> list[int]:
    """All differences that the first ``chain`` segments from ``start`` may show:
    the sum over the first l of them is at most floor(l * distance / RING)."""
    found = [(0, 0)]
    for l in range(1, chain + 1):
        k = (start + l - 1) % RING
        bits = [1 << (int(_FROM[k]) + j) for j in range(_WIDTHS[k])]
        budget, grown = l * distance // RING, []
        for mask, used in found:
            layer = [(mask, used, 0)]
            while layer:
                grown += [(m, u) for m, u, _ in layer]
                layer = [(m | bits[j], u + 1, j + 1) for m, u, at in layer if u < budget for j in range(at, len(bits))]
        found = grown
    return [m for m, _ in found]


def _regions(chain: int) -> list[int]:
    """The key's bits for each start."""
    out = []
    for start in range(RING):
        region = 0
        for l in range(chain):
            region |= SEGMENTS[(start + l) % RING]
        out.append(region)
    return out


def _keyed(chain: int, distance: int):
    """(start, key, fp) rows: one with the own bits (the row owns that key) and
    one for each difference whose highest bit is clear here (the probes: of two
    fingerprints that differ there, just one probes the other)."""
    plan = [(start, region, [m for m in chain_masks(start, chain, distance) if m]) for start, region in enumerate(_regions(chain))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                fp = fps[at : at + 4096]
                for start, region, masks in plan:
                    own = fp & np.uint64(region)
                    keys, rows = [own], [fp]
                    for m in masks:
                        clear = (own >> np.uint64(m.bit_length() - 1)) & np.uint64(1) == 0
                        keys.append(own[clear] ^ np.uint64(m))
                        rows.append(fp[clear])
                    key, row = np.concatenate(keys), np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), start, np.int32)), pa.array(key.view(np.int64)), pa.array(row.view(np.int64))], names=["start", "key", "fp"])

    return run


def _linked(chain: int, distance: int, lead: str):
    """From rows (start, key, cell, fp, lead, component) sorted by the first
    three to edges (a, b) that connect what is linked within each cell. The rows
    of ``lead`` (the key's owners, or the rows marked so) are compared with the
    cell's others; what has one component already gives no further edge, nor
    does a pair of which neither owns the key (another key has it)."""
    regions = np.array(_regions(chain), dtype=np.uint64)
    # prefix masks of the ring from each start, with their budgets
    prefix = np.zeros((RING, RING), dtype=np.uint64)
    for start in range(RING):
        m = 0
        for l in range(RING):
            m |= SEGMENTS[(start + l) % RING]
            prefix[start, l] = m
    budgets = [(l + 1) * distance // RING for l in range(RING)]

    def edges(start, key, cell, fp, marked, component) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (start[1:] != start[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        run = np.cumsum(new) - 1
        owns = (fp & regions[start]) == key
        leads = owns if lead == "owners" else marked
        order = np.lexsort((~leads, run))
        start, fp, run, owns, leads, component = (x[order] for x in (start, fp, run, owns, leads, component))
        first = np.flatnonzero(np.diff(run, prepend=-1))
        size, n_lead = np.diff(np.append(first, len(fp))), np.add.reduceat(leads.astype(np.int64), first)
        rows = np.flatnonzero(((n_lead > 0) & (size > 1))[run])
        # rows of a run that are connected already begin with one label
        by = np.lexsort((component, run))
        same = np.zeros(len(fp), dtype=bool)
        same[1:] = (run[by][1:] == run[by][:-1]) & (component[by][1:] == component[by][:-1])
        label = np.empty(len(fp), dtype=np.int64)
        label[by] = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(fp))))]
        out_a, out_b, k = [], [], 0
        while len(rows):
            pivot = first[run[rows]] + k
            ahead = rows > pivot
            r, p = rows[ahead], pivot[ahead]
            apart = (label[r] != label[p]) & (owns[r] | owns[p])
            r, p = r[apart], p[apart]
            x = fp[r] ^ fp[p]
            for l in range(1, RING):  # the chain's longer prefixes; the last is the full Hamming check
                if l < chain and l + 1 < RING:
                    continue
                ok = np.bitwise_count(x & prefix[start[r], l]) <= budgets[l]
                r, p, x = r[ok], p[ok], x[ok]
            if len(r):
                out_a.append(fp[r])
                out_b.append(fp[p])
                to = np.arange(len(fp))
                # of several rows with one label, any stands for it: all get the pivot's
                to[label[r]] = label[p]
                label[rows] = to[label[rows]]
            k += 1
            rows = rows[n_lead[run[rows]] > k]
        none = np.zeros(0, dtype=np.uint64)
        return np.concatenate([*out_a, none]), np.concatenate([*out_b, none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            a, b = edges(*(np.concatenate(x) for x in zip(*parts)))
            ok = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(b[ok].view(np.int64))], names=["a", "b"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "key", "cell", "fp", "lead", "component")]
            cols[1], cols[3] = cols[1].view(np.uint64), cols[3].view(np.uint64)
            if held and any(c[0] != h[-1] for c, h in zip(cols[:3], held[-1])):
                yield done(held)
                held = []
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = n - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield done([*held, [c[:cut] for c in cols]])
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield done(held)

    return run


def _hot_keys(distinct: DataFrame, scratch: Scratch, chain: int, distance: int) -> DataFrame:
    """(start, key, n) of the keys with more than CELL rows. Owners are counted;
    probes follow from the owners of the keys around, of which those with few
    owners are left out (their probes are below the number of differences times
    CELL / 32)."""
    own = _owned(distinct, chain)
    warm = scratch.keep(own.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > CELL // 32), "warm")
    masks = F.array([F.array([F.lit(_signed(m)) for m in chain_masks(s, chain, distance) if m]) for s in range(RING)])
    tops = F.array([F.array([F.lit(_signed(1 << (m.bit_length() - 1))) for m in chain_masks(s, chain, distance) if m]) for s in range(RING)])
    around = warm.select("start", "key", "n", F.explode(F.arrays_zip(masks[F.col("start")].alias("m"), tops[F.col("start")].alias("t"))).alias("d"))
    around = around.where(F.col("key").bitwiseAND(F.col("d.t")) == 0).select("start", F.col("key").bitwiseXOR(F.col("d.m")).alias("key"), "n")
    return warm.unionByName(around).groupBy("start", "key").agg(F.sum("n").alias("n")).where(F.col("n") > CELL)


def _owned(distinct: DataFrame, chain: int) -> DataFrame:
    regions = _regions(chain)
    own = F.array([F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(regions[s]))).alias("key")) for s in range(RING)])
    return distinct.select("fp", F.explode(own).alias("k")).select("fp", "k.start", "k.key")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, scratch: Scratch, distance: int = 4, chain: int = CHAIN) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) whose components
    are those of all pairs within ``distance`` bits."""
    if not 0 <= distance < 2 * RING:
        raise ValueError("distance must be 0 to 9")
    distinct = distinct.select("fp")
    rows = distinct.mapInArrow(_keyed(chain, distance), "start int, key long, fp long")
    edge, cells = "a long, b long", ["start", "key", "cell"]
    hot = scratch.keep(_hot_keys(distinct, scratch, chain, distance), "hot")
    n_hot = hot.count()

    def compared(rows: DataFrame, lead: str) -> DataFrame:
        dealt = rows.select(*cells, "fp", "lead", "component").repartition(*cells).sortWithinPartitions(*cells)
        return dealt.mapInArrow(_linked(chain, distance, lead), edge)

    plain = lambda d, cell: d.select("start", "key", cell.alias("cell"), "fp", F.lit(False).alias("lead"), F.col("fp").alias("component"))
    if not n_hot:
        return compared(plain(rows, F.lit(0)), "owners")
    few = n_hot <= MOST_BROADCAST
    side = lambda d: F.broadcast(d) if few else d
    first = _owned(distinct, chain).join(side(hot), ["start", "key"]).groupBy("start", "key").agg(F.min("fp").alias("fp"))
    hot = scratch.keep(hot.join(first, ["start", "key"], "left").withColumn("cells", F.when(F.col("fp").isNotNull(), F.ceil(F.col("n") / CELL).cast("int") + 1).otherwise(0)), "hot")
    told = rows.join(side(hot.select("start", "key", "cells")), ["start", "key"], "left")
    told, hot = told.where("cells is null or cells > 0"), hot.where("cells > 0")  # probes alone link nothing
    spread = plain(told, F.coalesce(F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"), F.lit(0)))
    pivots = plain(hot.select("start", "key", "fp", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("c")), F.col("c"))
    found = scratch.keep(compared(spread.unionByName(pivots), "owners"), "links")

    comps = connected_components(found, scratch)
    hot_rows = scratch.keep(rows.join(side(hot.select("start", "key")), ["start", "key"]), "rows")
    hot_rows = hot_rows.join(comps, hot_rows.fp == comps.id, "left").select("start", "key", "fp", F.coalesce("component", "fp").alias("component"))
    hot_rows = scratch.keep(hot_rows, "rows")
    sizes = hot_rows.groupBy("start", "key", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("start", "key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    split = sizes.where("n > top.n").select("start", "key", F.col("top.component").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / CELL).cast("int").alias("few"), F.ceil(F.col("n") / CELL).cast("int").alias("all"))
    told = hot_rows.join(side(split), ["start", "key"])
    at = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("long")
    over = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    leads = told.where("component <> top").withColumn("o", over("all")).select("start", "key", (at("few") * F.col("all") + F.col("o")).alias("cell"), "fp", F.lit(True).alias("lead"), "component")
    others = told.withColumn("o", over("few")).select("start", "key", (F.col("o") * F.col("all") + at("all")).alias("cell"), "fp", F.lit(False).alias("lead"), "component")
    return found.unionAll(compared(leads.unionByName(others), "marked"))


def fingerprint_components(distinct: DataFrame, scratch: Scratch, distance: int = 4, chain: int = CHAIN) -> DataFrame:
    """(fp, component) of the fingerprints that are linked with others."""
    comps = connected_components(scratch.keep(links(distinct, scratch, distance, chain), "links"), scratch)
    return comps.union(comps.select(F.col("component").alias("id"), "component").distinct()).select(F.col("id").alias("fp"), "component")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4, chain: int = CHAIN) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs, id_col, text_col, size), "fingerprints")
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    comps = scratch.keep(fingerprint_components(reps, scratch, distance, chain).join(reps, "fp"), "components")
    low = comps.groupBy("component").agg(F.min("rep").alias("low"))
    named = reps.join(comps.join(low, "component").select("fp", "low"), "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs``, with all columns, but one for each component (see
    ``one_of_each``); rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    fps = scratch.keep(fingerprints(slim.select(F.xxhash64("text").alias("doc_id"), "text"), size=size).distinct().withColumnRenamed("doc_id", "node"), "fingerprints")
    comps = fingerprint_components(fps.select("fp").distinct(), scratch, distance)
    found = slim.select("doc_id", F.xxhash64("text").alias("node")).join(fps.join(comps, "fp", "left"), "node").select("doc_id", "node", F.coalesce("component", "fp").alias("component"))
    return one_of_each(docs, found, scratch, id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
