"""Embedding near-duplicates by NN-descent.

Equal vectors of a label become one node. Each node holds a list of its NEAREST
nodes so far. The lists start from blocks of vectors that random hyperplanes
order alike (TREES orders), and are refined in rounds: every node introduces
its neighbours, in both directions, to each other, and whoever finds a nearer
one keeps it. Rounds end when few lists change. A list is saturated if all of
its entries are links, so that it may miss some: such lists are doubled and
refined again, WIDER times. List entries at the threshold, verified in double
precision, are the graph's edges.

Nodes whose lists are saturated even then are dense. Their links to other
components are searched for without lists: they are dealt out to chunks of one
component, and every two chunks whose balls come near enough are compared. (A
list with a non-link in it holds its node's links.) How many links a dense node
has is counted against its component, chunk by chunk, so no task ever holds a
component and no list of its links is made; this costs as many products as a
dense group has pairs, and each vector is sent once for every CHUNK dense ones.

Recall is audited against brute force on AUDIT nodes chosen by hash, half of
them with found links, half without, also where none was found. Each half
counts by how many nodes it stands for, and the recall of nodes with true links
is given with the lower end of its interval. Below TARGET, or with misses and a
lower end below LOWEST, all lists are doubled and refined anew, twice; the run
fails rather than return less. Where nothing is missed, but links are so rare
that the sample can't tell more, the log says so.

A search that passes its audit may still have lost a link here and there. So an
exact check follows (``complete``): nodes of a label and length are dealt out to
parts, every two parts are multiplied in single precision, and what is near the
threshold is decided in double. It adds the links that were missed, to the counts
and to the components. No list of links is made: a pair of parts gives one count a
node and one link for two components. This costs a product for every two nodes
of a label, spread over all tasks, and sends a vector once for every part.

Rows: vectors that are null, zero or hold null or non-finite components, and
rows with null label, link with nothing and are their own component; vectors of
different lengths never link; repeated rows are linked rows of their own; a
row without vec_id counts as a vector but never names a component, and is not
kept; other columns are ignored; an empty table gives no rows. Two vectors that
share a node's 64-bit hash end the run with an error.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table

THRESHOLD = 0.93
#: List length, blocks of the first lists, orders, rounds, and the gain in similarity, as a share, at which rounds end.
NEAREST, BLOCK, TREES, ROUNDS, SETTLED = 10, 256, 4, 4, 0.002
#: How much longer saturated lists become, and the rounds in which they fill.
WIDER, WIDER_ROUNDS = 4, 2
#: Members of a component's chunk.
CHUNK = 1024
#: Nodes of the audit, how often half of them may be doubled, the recall asked for and its interval's least lower end.
AUDIT, AUDIT_STEPS, TARGET, LOWEST = 1024, 4, 0.95, 0.9
#: Standard errors of a 95 % interval.
Z = 1.96
#: Balls compared with one another at a time.
BALLS = 1024
#: Values (nodes by length) of a part of the check, and the parts that smaller labels of at least so many nodes each are dealt out to.
PANEL, SPREAD, SMALL = 1 << 21, 4, 256
#: Similarities that the check computes at a time.
TILE = 1 << 21
#: Half precision may understate a link by this much; double precision decides.
SLACK = 0.004

log = logging.getLogger(__name__)


def _unit(vectors: pa.Array) -> list[bytes | None]:
    """Each vector at length 1, in double precision, or None if it can't link."""
    out = []
    for v in vectors.to_pylist():
        x = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
        top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0
        if not top:
            out.append(None)
            continue
        x = x / top  # so that squares neither vanish nor overflow
        out.append((x / np.sqrt(x @ x)).tobytes())
    return out


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, node, label, unit): node is a hash of label and direction, null
    for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                c = b.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([c.column("vec_id"), c.column("label"), pa.array(_unit(c.column("embedding")), pa.binary())], names=["vec_id", "label", "unit"])

    slim = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    units = slim.mapInArrow(run, "vec_id long, label string, unit binary")
    return units.select("vec_id", F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), F.xxhash64("label", "unit")).alias("node"), "label", "unit")


def _matrix(column: pa.Array, kind=np.float64) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, as tables that end where a key does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k in keys:
            col = batch.column(k)
            col = col.to_numpy() if pa.types.is_integer(col.type) else np.asarray(col.to_pylist(), dtype=object)
            same &= col == col[-1]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if not cut and held and any(held[-1].column(k)[-1] != batch.column(k)[-1] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bounds(*columns: list | np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(columns[0])
    new = np.zeros(n + 1, dtype=bool)
    new[[0, n]] = True
    for c in columns:
        c = np.asarray(c, dtype=object if isinstance(c, list) else None)
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(s, np.float32))], names=["u", "v", "s"])


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest entries but its own."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(sims) - 1)
    cols = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), cols.ravel()


def _first_lists(k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("label", "dim")):
            node = t.column("node").to_numpy()
            unit = _matrix(t.column("half"), np.float16)
            b = _bounds(t.column("label").to_pylist(), t.column("dim").to_numpy())
            for s, e in zip(b, b[1:]):
                n = max(1, round((e - s) / block))
                for part in np.array_split(np.arange(s, e), n):
                    if len(part) < 2:
                        continue
                    x = np.vstack([unit[i] for i in part]).astype(np.float32)
                    sims = x @ x.T
                    r, c = _top(sims, k)
                    yield _edges(node[part[r]], node[part[c]], sims[r, c])

    return run


def _introduced(k: int):
    """Rows (c, m, worst, half) sorted by c: the members of c's circle. Each
    member gets those of the others that are nearer than its worst entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("c",)):
            center, m, worst = (t.column(x).to_numpy() for x in ("c", "m", "worst"))
            half = _matrix(t.column("half"), np.float16)
            b = _bounds(center)
            us, vs, ss = [], [], []
            for s, e in zip(b, b[1:]):
                if e - s < 2:
                    continue
                x = np.vstack(half[s:e]).astype(np.float32)
                sims = x @ x.T
                r, c = _top(sims, k)
                sim = sims[r, c]
                ok = (sim > worst[s:e][r]) & (m[s:e][r] != m[s:e][c])
                us.append(m[s:e][r[ok]])
                vs.append(m[s:e][c[ok]])
                ss.append(sim[ok])
            if us:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k nearest of its entries; equal ones by node."""
    nearest = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return edges.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k).drop("_r")


def descend(nodes: DataFrame, scratch: Scratch, k: int, trees: int = TREES, rounds: int = ROUNDS, block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """Edges (u, v, s) of each node's k nearest. ``nodes``: (node, label, dim, half)."""
    edges = known
    for tree in range(trees):

        def ordered(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            planes = {}
            for b in batches:
                code = []
                for x in _matrix(b.column("half"), np.float16):
                    if len(x) not in planes:
                        planes[len(x)] = np.random.default_rng([tree, len(x)]).normal(size=(16, len(x))).astype(np.float32)
                    code.append(int(np.packbits(planes[len(x)] @ x.astype(np.float32) > 0).view(">u2")[0]))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("node", "label", "dim", "half")] + [pa.array(code, pa.int32())], names=["node", "label", "dim", "half", "code"])

        coded = nodes.mapInArrow(ordered, "node long, label string, dim int, half binary, code int")
        dealt = coded.repartitionByRange("label", "dim", "code", "node").sortWithinPartitions("label", "dim", "code", "node")
        lists = dealt.mapInArrow(_first_lists(k, block), "u long, v long, s float")
        edges = lists if edges is None else edges.unionAll(lists)
    return refined(nodes, scratch.keep(_best(edges, k), "lists"), scratch, k, rounds)


def refined(nodes: DataFrame, now: DataFrame, scratch: Scratch, k: int, rounds: int = ROUNDS, only: DataFrame | None = None) -> DataFrame:
    """The lists after rounds of introductions, of k entries; with ``only`` (u),
    lists of other nodes stay as they are."""
    kept = None
    if only is not None:
        only = scratch.keep(only, "only")
        kept = scratch.keep(now.join(only, "u", "left_anti"), "kept")
        now = scratch.keep(now.join(only, "u", "left_semi"), "lists")
    total = lambda d: d.agg(F.sum("s")).first()[0] or 0.0
    before = total(now)
    for _ in range(rounds):
        every = now if kept is None else now.unionAll(kept)
        # a node's circle: its list and, of those that list it, the nearest
        back = _best(every.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"), k)
        circle = every.select(F.col("u").alias("c"), F.col("v").alias("m")).union(back.select("u", "v")).distinct()
        # those that don't look for more (worst 3, above any similarity) are introduced alone
        worst = now.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        own = nodes.select("node", "half").join(worst, F.col("node") == F.col("u"), "left").select(F.col("node").alias("m"), F.coalesce("worst", F.lit(-2.0 if only is None else 3.0)).cast("float").alias("worst"), "half")
        if only is not None:
            seekers = circle.join(only.select(F.col("u").alias("m")), "m", "left_semi").select("c").distinct()
            circle = circle.join(seekers, "c", "left_semi")
        met = circle.join(own, "m").select("c", "m", "worst", "half").repartition("c").sortWithinPartitions("c")
        found = met.mapInArrow(_introduced(k), "u long, v long, s float")
        new = scratch.keep(_best(now.unionAll(found), k), "lists")
        after = total(new)
        scratch.drop(now)
        now = new
        if after - before <= SETTLED * abs(before):
            break
        before = after
    return now if kept is None else now.unionAll(kept)


def saturated(lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(u) of the nodes whose k entries are all links."""
    return lists.groupBy("u").agg(F.min("s").alias("s"), F.count("*").alias("n")).where((F.col("s") >= threshold - SLACK) & (F.col("n") >= k)).select("u")


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = _matrix(b.column("a")), _matrix(b.column("b"))
            ok = np.array([x @ y >= threshold for x, y in zip(a, c)], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], names=["u", "v"])

    return run


def _counted(threshold: float):
    """Rows (component, i, j, node, dense, copies, unit) sorted by the first
    three: for each dense node, the copies of linked rows among the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("component", "i", "j")):
            comp, i, j, node, copies = (t.column(x).to_numpy() for x in ("component", "i", "j", "node", "copies"))
            dense = t.column("dense").to_numpy()
            unit = _matrix(t.column("unit"))
            b = _bounds(comp, i, j)
            nodes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(b, b[1:]):
                left, right = s + np.flatnonzero(dense[s:e]), s + np.flatnonzero(~dense[s:e])
                if len(left) and len(right):
                    x, y = (np.vstack([unit[q] for q in side]) for side in (left, right))
                    nodes.append(node[left])
                    counts.append((x @ y.T >= threshold) @ copies[right])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts).astype(np.int64))], names=["node", "n"])

    return run


def dense_counts(members: DataFrame, threshold: float = THRESHOLD, chunk: int | None = None) -> DataFrame:
    """(node, n) for each dense node: the rows of its component that link with
    it, its own included. ``members`` is (node, component, dense, copies, unit)
    of the components that have dense nodes."""
    chunk = chunk or CHUNK
    parts = lambda n: F.greatest(F.ceil(n / chunk), F.lit(1)).cast("int")
    sizes = members.groupBy("component").agg(parts(F.sum(F.col("dense").cast("long"))).alias("left"), parts(F.count("*")).alias("right"))
    m = members.join(sizes, "component")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["component", "i", "j", "node", "dense", "copies", "unit"]
    seeking = m.where("dense").withColumn("i", at("left")).withColumn("j", over("right")).select(columns)
    others = m.withColumn("dense", F.lit(False)).withColumn("j", at("right")).withColumn("i", over("left")).select(columns)
    dealt = seeking.unionAll(others).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(_counted(threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (component, chunk): each chunk's mean direction and the
    largest angle to it, with the chunk's place (label, dim)."""
    for t in _runs(batches, ("component", "chunk")):
        comp, chunk, dim = (t.column(x).to_numpy() for x in ("component", "chunk", "dim"))
        label, unit = t.column("label").to_pylist(), _matrix(t.column("unit"))
        first = _bounds(comp, chunk)
        centers, radii = [], []
        for s, e in zip(first, first[1:]):
            x = np.vstack(unit[s:e])
            mean = x.sum(axis=0)
            size = np.sqrt(mean @ mean)
            center = mean / size if size > 1e-9 else x[0]
            centers.append(center.tobytes())
            radii.append(float(np.arccos(np.clip(x @ center, -1, 1)).max()))
        at = first[:-1]
        yield pa.RecordBatch.from_arrays([pa.array([label[i] for i in at], pa.string()), pa.array(dim[at], pa.int32()), pa.array(comp[at]), pa.array(chunk[at], pa.int32()), pa.array(centers, pa.binary()), pa.array(radii, pa.float64())], names=["label", "dim", "component", "chunk", "center", "radius"])


def _close(threshold: float):
    """Rows (label, dim, i, j, part, component, chunk, center, radius) sorted by
    the first four: pairs of chunks of two components that can hold a link."""
    reach = float(np.arccos(threshold)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("label", "dim", "i", "j")):
            dim, i, j, part, comp, chunk, radius = (t.column(x).to_numpy() for x in ("dim", "i", "j", "part", "component", "chunk", "radius"))
            center = _matrix(t.column("center"))
            b = _bounds(t.column("label").to_pylist(), dim, i, j)
            for s, e in zip(b, b[1:]):
                left = np.arange(s, e)[part[s:e] == i[s]]
                right = np.arange(s, e)[part[s:e] == j[s]]
                if not len(left) or not len(right):
                    continue
                y = np.vstack([center[q] for q in right])
                for at in range(0, len(left), 256):
                    some = left[at : at + 256]
                    angle = np.arccos(np.clip(np.vstack([center[p] for p in some]) @ y.T, -1, 1))
                    ok = (angle <= radius[some][:, None] + radius[right][None, :] + reach) & (comp[some][:, None] != comp[right][None, :])
                    if i[s] == j[s]:
                        ok &= some[:, None] < right[None, :]
                    p, q = np.nonzero(ok)
                    p, q = some[p], right[q]
                    yield pa.RecordBatch.from_arrays([pa.array(comp[p]), pa.array(chunk[p]), pa.array(comp[q]), pa.array(chunk[q])], names=["ca", "ka", "cb", "kb"])

    return run


def _met(threshold: float):
    """Rows (ca, ka, cb, kb, component, node, unit) sorted by the first four: a
    link between the two chunks, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("ca", "ka", "cb", "kb")):
            ca, ka, cb, kb, comp, node = (t.column(x).to_numpy() for x in ("ca", "ka", "cb", "kb", "component", "node"))
            unit = _matrix(t.column("unit"))
            b = _bounds(ca, ka, cb, kb)
            us, vs = [], []
            for s, e in zip(b, b[1:]):
                one = np.arange(s, e)[comp[s:e] == ca[s]]
                two = np.arange(s, e)[comp[s:e] == cb[s]]
                sims = np.vstack([unit[p] for p in one]) @ np.vstack([unit[q] for q in two]).T
                p, q = np.unravel_index(int(sims.argmax()), sims.shape)
                if sims[p, q] >= threshold:
                    us.append(node[one[p]])
                    vs.append(node[two[q]])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def bridges(members: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Links (u, v) that connect components as all links between their dense nodes
    do: ``members`` is (node, component, label, dim, unit) of these."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    m = members.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    m = scratch.keep(m.select("component", "chunk", "node", "label", "dim", "unit"), "dense")
    dealt = m.repartition("component", "chunk").sortWithinPartitions("component", "chunk")
    balls = scratch.keep(dealt.mapInArrow(_balls, "label string, dim int, component long, chunk int, center binary, radius double"), "balls")
    parts = balls.groupBy("label", "dim").agg(F.ceil(F.count("*") / BALLS).cast("int").alias("parts"))
    d = balls.join(parts, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("component", "chunk"), F.col("parts")).cast("int"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.select("label", "dim", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "component", "chunk", "center", "radius")
    d = d.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j")
    close = scratch.keep(d.mapInArrow(_close(threshold), "ca long, ka int, cb long, kb int"), "close")
    sides = close.withColumn("side", F.explode(F.array(F.struct(F.col("ca").alias("component"), F.col("ka").alias("chunk")), F.struct(F.col("cb").alias("component"), F.col("kb").alias("chunk")))))
    sides = sides.select("ca", "ka", "cb", "kb", "side.component", "side.chunk").join(m, ["component", "chunk"]).select("ca", "ka", "cb", "kb", "component", "node", "unit")
    dealt = sides.repartition("ca", "ka", "cb", "kb").sortWithinPartitions("ca", "ka", "cb", "kb")
    return dealt.mapInArrow(_met(threshold), "u long, v long")


def _checked(threshold: float):
    """Rows (label, dim, i, j, part, node, component, copies, unit) sorted by the
    first four: for each node of the two parts, the copies it links with in the
    other part (u, n), and a link (u, v) for every two components that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("label", "dim", "i", "j")):
            dim, i, j, part, node, comp, copies = (t.column(x).to_numpy() for x in ("dim", "i", "j", "part", "node", "component", "copies"))
            unit = _matrix(t.column("unit"))
            b = _bounds(t.column("label").to_pylist(), dim, i, j)
            for s, e in zip(b, b[1:]):
                left = np.arange(s, e)[part[s:e] == i[s]]
                right = left if i[s] == j[s] else np.arange(s, e)[part[s:e] == j[s]]
                if not len(left) or not len(right):
                    continue
                x = np.vstack([unit[q] for q in left])
                y = x if right is left else np.vstack([unit[q] for q in right])
                x4, y4 = x.astype(np.float32), y.astype(np.float32)
                unsure = float(dim[s] + 2) * 2.0**-22  # more than single precision can be off
                counts, joined = np.zeros(e - s), {}
                step = max(1, TILE // len(right))
                for at in range(0, len(left), step):
                    first = at if right is left else 0  # a part with itself: later ones only
                    sims = x4[at : at + step] @ y4[first:].T
                    hit = np.flatnonzero(sims >= threshold - unsure)
                    p, q = np.divmod(hit, sims.shape[1])
                    ok = sims.ravel()[hit] >= threshold + unsure
                    p, q = p + at, q + first
                    near = np.flatnonzero(~ok)
                    ok[near] = [x[a] @ y[c] >= threshold for a, c in zip(p[near], q[near])]
                    if right is left:
                        ok &= q > p
                    p, q = left[p[ok]], right[q[ok]]
                    counts += np.bincount(p - s, copies[q], e - s) + np.bincount(q - s, copies[p], e - s)
                    apart = comp[p] != comp[q]
                    p, q = p[apart], q[apart]
                    pairs, one = np.unique(np.sort(np.stack([comp[p], comp[q]], axis=1), axis=1), axis=0, return_index=True)
                    for pair, k in zip(pairs.tolist(), one):
                        joined.setdefault(tuple(pair), (node[p[k]], node[q[k]]))
                linked = np.flatnonzero(counts)
                us = np.concatenate([node[s + linked], np.array([u for u, _ in joined.values()], np.int64)])
                vs = [None] * len(linked) + [int(v) for _, v in joined.values()]
                ns = [int(n) for n in counts[linked]] + [None] * len(joined)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], names=["u", "v", "n"])

    return run


def checked(members: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """By comparing all nodes of a label: (node, n), the rows that link with each
    node that has links, its own copies left out, and (u, v), links between
    components. ``members`` is (node, component, label, dim, copies, unit)."""
    few = F.least(F.lit(SPREAD), F.ceil(F.count("*") / SMALL))
    parts = members.groupBy("label", "dim").agg(F.greatest(F.ceil(F.count("*") * F.col("dim") / PANEL), few).cast("int").alias("parts"))
    d = members.join(parts, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.select("label", "dim", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "node", "component", "copies", "unit")
    d = d.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j")
    told = scratch.keep(d.mapInArrow(_checked(threshold), "u long, v long, n long"), "checked")
    counts = told.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    return counts, told.where("v is not null").select("u", "v")


@dataclass
class Audit:
    """Recall over nodes with true links: estimate and lower end of its 95 %
    interval (None without a true link in the sample), links and nodes it rests on,
    and how many of the sampled nodes without found links have true ones."""

    recall: float | None
    low: float | None
    links: int
    nodes: int
    missed: int


def _estimated(found_total: int, found: tuple[int, float, float], lost_total: int, lost: tuple[int, int]) -> tuple[float | None, float | None]:
    """Recall and its lower end from two strata, each weighted by its size: nodes
    with found links (sampled nodes, sum and sum of squares of their recalls) and
    nodes without (sampled nodes, those with true links)."""
    n, total, squares = found
    mean = total / n if n else 1.0
    error = 0.0 if n < 2 or n >= found_total else float(np.sqrt(max(squares / n - mean * mean, 0.0) / (n - 1)))
    size, hits = lost
    share = hits / size if size else 0.0
    most = share if size >= lost_total else (share + Z * Z / (2 * size) + Z * np.sqrt(share * (1 - share) / size + Z * Z / (4 * size * size))) / (1 + Z * Z / size)
    if not found_total and not hits:
        return None, None
    part = lambda m, lacking: found_total * m / (found_total + lacking * lost_total)
    return part(mean, share), max(0.0, part(max(mean - Z * error, 0.0), most))


def _audited(nodes: DataFrame, counts: DataFrame, threshold: float, most: int) -> Audit:
    """Recall against brute force: ``most`` nodes chosen by hash, half of them of
    those with found links, half of the others, are compared with all nodes. While
    nothing is missed but the interval's lower end is too low to tell, the second
    sample is enlarged, up to AUDIT_STEPS times. These nodes go to all tasks (so
    many vectors, whatever the table's size)."""
    mine = nodes.join(counts, "node", "left").select("node", "label", "dim", "unit", F.coalesce("n", F.lit(0)).alias("n"))
    totals = mine.agg(F.count(F.when(F.col("n") > 0, 1)), F.count(F.when(F.col("n") == 0, 1))).first()

    def chosen(size: int) -> DataFrame:
        share = [1 << 31 if total <= want else int((1 << 31) * want / total) for total, want in zip(totals, (most // 2, size))]
        return mine.where(F.pmod(F.hash("node"), F.lit(1 << 31)) < F.when(F.col("n") > 0, F.lit(share[0])).otherwise(F.lit(share[1])))

    size = most // 2
    for step in range(AUDIT_STEPS):
        held = chosen(size).toPandas()
        if not len(held):
            return Audit(None, None, 0, 0, 0)
        true = _true_links(nodes, held, threshold)
        rates = [min(n, true[q]) / true[q] for q, n in zip(held["node"].tolist(), held["n"].tolist()) if n and true.get(q)]
        without = held["node"][held["n"] == 0].tolist()
        missed = sum(q in true for q in without)
        recall, low = _estimated(totals[0], (len(rates), float(np.sum(rates)), float(np.sum(np.square(rates)))), totals[1], (len(without), missed))
        if missed or len(without) >= totals[1] or low is not None and low >= LOWEST:
            break
        size *= 2
    return Audit(recall, low, sum(true.values()), len(held), missed)


def _true_links(nodes: DataFrame, held: pd.DataFrame, threshold: float) -> dict[int, int]:
    """How many links each of the held nodes has among all nodes, by brute force; those without have no entry."""
    groups = {key: (d["node"].to_numpy(), np.vstack([np.frombuffer(x) for x in d["unit"]])) for key, d in held.groupby(["label", "dim"])}
    shared = nodes.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[int, int] = {}
            label, dim, node, copies, unit = b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("node").to_numpy(), b.column("copies").to_numpy(), _matrix(b.column("unit"))
            for key in set(zip(label, dim)):
                if key not in shared.value:
                    continue
                at = np.array([i for i, k in enumerate(zip(label, dim)) if k == key])
                ids, x = shared.value[key]
                links = (x @ np.vstack([unit[i] for i in at]).T >= threshold) & (ids[:, None] != node[at][None, :])
                for q, n in zip(ids.tolist(), (links @ copies[at]).tolist()):
                    if n:
                        got[q] = got.get(q, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], names=["node", "true_n"])

    truth = nodes.select("label", "dim", "node", "copies", "unit").mapInArrow(run, "node long, true_n long").groupBy("node").agg(F.sum("true_n").alias("true_n"))
    out = {r.node: r.true_n for r in truth.collect()}  # one row a held node
    shared.destroy()
    return out


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEAREST, audit: int = AUDIT, report: dict | None = None, complete: bool = True, **columns) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. ``report`` receives
    the audited recall (None without links), the links it was measured on, the
    list length and what the check added; they are logged too. Without ``complete``
    the search isn't checked: for labels with too many rows to compare all pairs."""
    scratch = Scratch(rows.sparkSession)
    own = scratch.keep(vectors(rows, **columns), "vectors")
    unit = F.when(F.min("unit") == F.max("unit"), F.min("unit")).otherwise(F.raise_error(F.lit("two vectors share a hash")).cast("binary"))
    nodes = own.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), unit.alias("unit"))

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("unit"))
            half = pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "rep", "copies", "label", "unit")), pa.array([len(v) for v in x], pa.int32()), half], names=["node", "rep", "copies", "label", "unit", "dim", "half"])

    nodes = scratch.keep(nodes.mapInArrow(halved, "node long, rep long, copies long, label string, unit binary, dim int, half binary"), "nodes")
    slim, lists = nodes.select("node", "label", "dim", "half"), None
    for attempt in range(3):
        lists = descend(slim, scratch, k, known=lists, block=max(BLOCK, 4 * k))
        full = scratch.keep(saturated(lists, threshold, k), "saturated")
        if full.limit(1).count():
            lists = refined(slim, lists, scratch, WIDER * k, WIDER_ROUNDS, only=full)
            full = scratch.keep(saturated(lists, threshold, WIDER * k), "saturated")
        near = lists.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = near.join(nodes.select(F.col("node").alias("u"), F.col("unit").alias("a")), "u").join(nodes.select(F.col("node").alias("v"), F.col("unit").alias("b")), "v")
        links = scratch.keep(pairs.select("u", "v", "a", "b").mapInArrow(_verified(threshold), "u long, v long"), "links")
        comps = connected_components(links, scratch)
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(nodes.select(F.col("node").alias("v"), "copies"), "v")
        counts = both.groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("n"))
        if full.limit(1).count():
            placed = nodes.join(comps, nodes.node == comps.id, "left").select("node", "label", "dim", "copies", "unit", F.coalesce("component", "node").alias("component"))
            across = scratch.keep(bridges(placed.join(full, placed.node == full.u, "left_semi").select("node", "component", "label", "dim", "unit"), scratch, threshold), "bridges")
            if across.limit(1).count():
                comps = connected_components(links.union(across), scratch)
                placed = nodes.join(comps, nodes.node == comps.id, "left").select("node", "copies", "unit", F.coalesce("component", "node").alias("component"))
            placed = placed.join(full, placed.node == full.u, "left").select("node", "component", F.col("u").isNotNull().alias("dense"), "copies", "unit")
            packed = placed.where("dense").select("component").distinct()
            dense = dense_counts(placed.join(packed, "component", "left_semi"), threshold)
            dense = dense.join(nodes.select("node", "copies"), "node").select("node", (F.col("n") - F.col("copies")).alias("n"))
            counts = counts.join(dense.select("node"), "node", "left_anti").unionAll(dense)
        counts = scratch.keep(counts, "counts")
        seen = _audited(nodes, counts, threshold, audit)
        log.info("recall %s (at least %s) over %d links of %d nodes, %d missed, lists of %d", seen.recall, seen.low, seen.links, seen.nodes, seen.missed, k)
        if report is not None:
            report |= {**vars(seen), "k": k}
        # a lower end that is low though nothing was missed says that links are too rare to tell more
        if seen.recall is None or seen.recall >= TARGET and (seen.low >= LOWEST or not seen.missed):
            break
        if attempt == 2:
            raise RuntimeError(f"recall {seen.recall:.3f} (at least {seen.low:.3f}) is below {TARGET} with lists of {k}")
        k *= 2
    if complete:
        placed = nodes.join(comps, nodes.node == comps.id, "left").select("node", F.coalesce("component", "node").alias("component"), "label", "dim", "copies", "unit")
        true, across = checked(placed, scratch, threshold)
        short = true.withColumnRenamed("n", "true_n").join(counts, "node", "left").where(F.col("true_n") > F.coalesce("n", F.lit(0)))
        short = scratch.keep(short.select("node", F.col("true_n").alias("n"), (F.col("true_n") - F.coalesce("n", F.lit(0))).alias("added")), "short")
        added = short.agg(F.count("*"), F.coalesce(F.sum("added"), F.lit(0))).first()
        log.info("the check added %d links of %d nodes", added[1], added[0])
        if report is not None:
            report |= {"short": added[0], "added": added[1]}
        if added[0]:
            counts = counts.join(short, "node", "left_anti").unionAll(short.select("node", "n"))
            if across.limit(1).count():
                comps = connected_components(comps.select(F.col("id").alias("u"), F.col("component").alias("v")).unionAll(across), scratch)
    comps = scratch.keep(comps.union(comps.select(F.col("component").alias("id"), "component").distinct()), "components")
    named = nodes.select("node", "rep", "copies").join(comps, nodes.node == comps.id, "left").join(counts, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    low = named.groupBy("component").agg(F.min("rep").alias("low"))
    named = named.join(low, "component").select("node", "n_links", "low")
    out = own.select("vec_id", "node").join(named, "node", "left")
    own_id = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("vec_id") == own_id, F.lit(False)).alias("kept"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with a near copy of every row (5 in 100 off, similarity over
    0.99), and of every tenth 30 (3 in 100 off, over 0.99 to one another)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("c", F.explode(F.when(F.col("vec_id") % 10 == 0, F.sequence(F.lit(0), F.lit(30))).otherwise(F.array(F.lit(0), F.lit(1)))))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x) / F.size("e"))
    share = F.when(F.col("vec_id") % 10 == 0, F.lit(0.03)).otherwise(F.lit(0.05))
    moved = F.transform("e", lambda x, i: F.when((F.col("c") > 0) & ((i * 7 + F.col("c") * 11) % 5 < 2), x + share * size).otherwise(x))
    return rows.select((F.col("vec_id") * 32 + F.col("c")).alias("vec_id"), "label", moved.alias("embedding"))


def planted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on a table that has links (``embeddings`` has none)."""
    return near_duplicates(planted(spark, sf_dir))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_SQL = """
WITH RECURSIVE {rows}v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {table} WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach AS (SELECT vec_id AS id, vec_id AS r FROM {table} UNION SELECT reach.id, link.w FROM reach JOIN link ON link.u = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM {table} JOIN c ON c.id = vec_id LEFT JOIN n ON n.u = vec_id
"""
ORACLE_SQL = _SQL.format(rows="", table="embeddings", threshold=THRESHOLD)
PLANTED_SQL = _SQL.format(
    rows="""planted AS MATERIALIZED (SELECT vec_id * 32 + c AS vec_id, label,
    list_transform(e, lambda x, i: CASE WHEN c > 0 AND ((i - 1) * 7 + c * 11) % 5 < 2 THEN x + CASE WHEN vec_id % 10 = 0 THEN 0.03 ELSE 0.05 END * sqrt(list_sum(list_transform(e, lambda y: y * y)) / len(e)) ELSE x END) AS embedding
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, unnest(range(CASE WHEN vec_id % 10 = 0 THEN 31 ELSE 2 END)) AS c FROM embeddings)),
""",
    table="planted",
    threshold=THRESHOLD,
)
