"""What the operators of this subpackage share: shared-folder tables, bounded
Arrow batches, vectorised word hashing and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python worker holds at a time (one longer text is a step of its own).
STEP_BYTES = 2 << 20
#: Nodes that a task of the components holds at a time.
FOREST = 1_000_000

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``;
    a folder of our own where that setting is absent, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own_dirs.get(app) or _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="waymill-"))
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder: they cut the lineage and survive the
    loss of executors. ``drop`` removes one that nothing reads any more; the rest
    go when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        made = f"{shared_dir(self.spark)}/waymill/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly, made)
        return made

    def keep(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path = self.path(name)
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and (path := self._paths.pop(id(df), None)):
            _delete(self.spark, path)

    def _quietly(self, path: str) -> None:
        try:
            _delete(self.spark, path)
        except Exception:  # the session may be gone at exit
            pass


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column with null as empty, and the n+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    size = pc.binary_length(filled).to_numpy(zero_copy_only=False)
    ends = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=ends[1:])
    start = int(np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset]) if len(filled) else 0
    data = np.frombuffer(filled.buffers()[2] or b"", dtype=np.uint8) if ends[-1] else np.zeros(0, np.uint8)
    return data[start : start + int(ends[-1])], ends


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_pow_cache: list[np.ndarray] = [_powers(_BASE, 1), _powers(pow(_BASE, -1, 1 << 64), 1)]


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow_cache[0]) < n:
        size = max(n, 1 << 16)
        _pow_cache[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _pow_cache[0], _pow_cache[1]


def runs(data: np.ndarray, ends: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``member[byte]`` that stay inside a text:
    starts, ends (exclusive) and the number of runs before each text (n+1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    is_in = member[data]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    at = ends[:-1][ends[:-1] < len(data)]
    first[at] = is_in[at]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    stop = ends[1:][ends[1:] > 0] - 1
    last[stop] = is_in[stop]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each run, independent of where the run stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _pows(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        h = (total[stops] - total[starts]) * down[starts]
    return mixed(h + (stops - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size`` word shingles of each text and the n+1 bounds;
    texts with fewer words have none."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    out = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    if len(words) < size or not out[-1]:
        return np.zeros(0, np.uint64), out * 0
    with np.errstate(over="ignore"):
        h = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k]
    take = np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mixed(h[take]), out


#: Lower-casing of ASCII, and what counts as part of a word: ASCII letters, digits and every byte of other characters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of the column's texts, and the n+1 bounds."""
    data, ends = packed(column)
    data = LOWER[data]
    starts, stops, bounds = runs(data, ends, WORD)
    return run_hashes(data, starts, stops), bounds


def balanced(df: DataFrame) -> DataFrame:
    """A plain scan with fewer partitions than the cluster has cores, as of one
    small file, dealt out over all of them; anything else as it is."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan or "Adaptive" in plan or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges by (node, least node reachable within them),
    for at most FOREST nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def found() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if root(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])
        parent.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST:
            yield from found()
    yield from found()


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of the (long, long) edges but components'
    least nodes: alternating large-star and small-star steps until nothing
    changes. Group minima are aggregated partially before their shuffle; a hub's
    edges meet its minimum in a sort-merge join, which streams them and which the
    adaptive skew join splits. Each round is a table in the shared folder."""
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    e = scratch.keep(e.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    before = sign(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.distinct(), "small")
        scratch.drop(large)
        after = sign(new)
        scratch.drop(e)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def one_of_each(docs: DataFrame, found: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, but one for each component.
    ``found`` is (doc_id, node, component) of every row, node being the text's
    xxhash64. The row with the smallest (doc_id, node) stays, once; rows without
    doc_id stay, and never stand for a component."""
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    named = found.where("doc_id is not null")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    told = scratch.keep(named.join(first, "component").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), stays.alias("stays")), "told")
    # by shuffle at every size: how many go grows with the input, so they are no side to broadcast
    gone = told.where("not stays").select("_doc", "_node").distinct().hint("merge")
    out = docs.join(gone, (text == F.col("_node")) & (docs[id_col].cast("long") == F.col("_doc")), "left_anti")
    if told.where("stays").groupBy("_doc", "_node").count().where("count > 1").limit(1).count():  # a row repeated: one stays
        named = out.where(F.col(id_col).isNotNull()).withColumn("_node", text).dropDuplicates([id_col, "_node"]).drop("_node")
        out = named.unionByName(out.where(F.col(id_col).isNull()))
    return out
