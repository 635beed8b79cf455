"""Quality classifier by positive-unlabelled learning.

A small network scores whole texts on counts of characters, words, lines and
repeats. It is trained on trusted positives and unlabelled web text alone, by
the non-negative unbiased risk: with prior p,
    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)),
and when the bracket is negative a step is taken against it. Labels of 0 are
never read as such. The prior is estimated from positives and unlabelled rows
too, by the best bin: a first network tells the two apart on one half of them;
on the other half, the share of unlabelled rows that score above a threshold is
divided by that of positives, at the threshold where the bound on this ratio is
least.

Training reads about MOST_LABELLED labelled documents (one text of each) and
MOST_UNLABELLED unlabelled rows at most, taken by a hash of id and text from the
training rows, repeated rows once; scoring reads all.

Rows: null text counts as empty and is scored like an empty one; missing or
repeated doc_id pass through (a row without doc_id is never held out and never
trains); label rows without doc_id or quality are ignored, and of several
labels of a document the least counts; without labelled positives every score
is 0.5; other columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD, balanced, packed, run_hashes, runs, shingle_hashes, steps, table

MOST_LABELLED = 20_000
MOST_UNLABELLED = 20_000
PREDICT_AT = 0.3

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "space", "newline", "sentence_end", "comma", "other_sign", "high_byte",
    "mean_word", "long_words", "short_words", "distinct_words", "top_word", "same_next", "distinct_pairs", "distinct_fives",
    "words_per_line", "same_lines", "sign_after_word", "bar", "lines_log", "word_share",
)

_CLASS = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "newline": (10,), "sentence_end": b".!?", "comma": b",;:",
    "other_sign": b"\"#$%&*+/<=>@[\\]^_`{}~", "high_byte": range(128, 256), "bar": b"|",
}
_CODE = np.zeros(256, dtype=np.int32)
for _k, _members in enumerate(_CLASS.values()):
    _CODE[list(_members)] = _k + 1
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _sorted(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all texts, sorted within each text (44 bits of each hash
    below the text's number), and where a new value begins."""
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    key = np.sort((row << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return key, new


def _distinct(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct values of each text, for whole steps at once."""
    key, new = _sorted(h, bounds)
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=len(bounds) - 1)


def _top(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each text's commonest value occurs."""
    key, new = _sorted(h, bounds)
    at = np.flatnonzero(new)
    out = np.zeros(len(bounds) - 1, dtype=np.int64)
    np.maximum.at(out, (key[at] >> np.uint64(44)).astype(np.int64), np.diff(at, append=len(key)))
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all are zero for an empty one."""
    data, ends = packed(column)
    n = np.diff(ends)
    size = np.maximum(n, 1)
    row = np.repeat(np.arange(len(n), dtype=np.int32) * 16, n)
    row += _CODE[data]
    counts = np.bincount(row, minlength=16 * len(n)).reshape(-1, 16) / size[:, None]
    out = {"log_bytes": np.log1p(n)} | {name: counts[:, k + 1] for k, name in enumerate(_CLASS)}
    low = LOWER[data]
    s, e, w = runs(low, ends, WORD)
    h = run_hashes(low, s, e)
    long, count = e - s, np.diff(w)
    words = np.maximum(count, 1)
    per = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[w])
    out |= {"log_words": np.log1p(count), "mean_word": per(long) / words, "long_words": per(long > 14) / words, "short_words": per(long <= 3) / words}
    out |= {"distinct_words": _distinct(h, w) / words, "top_word": _top(h, w) / words, "word_share": per(long) / size}
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[w[:-1][w[:-1] < len(h)]] = False
    out["same_next"] = per(same) / words
    for name, k in (("distinct_pairs", 2), ("distinct_fives", 5)):
        sh, at = shingle_hashes(h, w, k)
        parts = np.diff(at)
        out[name] = np.where(parts > 0, _distinct(sh, at) / np.maximum(parts, 1), 1.0 * (n > 0))
    odd = np.zeros(256, dtype=bool)
    odd[[*_CLASS["other_sign"], *_CLASS["bar"]]] = True
    after = np.zeros(len(s), dtype=bool)
    inside = e < len(data)
    after[inside] = odd[data[e[inside]]]
    out["sign_after_word"] = per(after) / words
    ls, le, lines = runs(low, ends, _LINE)
    n_lines = np.diff(lines)
    out |= {"words_per_line": np.log1p(count / np.maximum(n_lines, 1)), "lines_log": np.log1p(n_lines), "same_lines": 1 - _distinct(run_hashes(low, ls, le), lines) / np.maximum(n_lines, 1)}
    out["same_lines"] *= n_lines > 0
    return np.column_stack([out[f] for f in FEATURES]).astype(np.float64)


class Network:
    """One hidden layer; the output is the log-odds of label 1."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1])

    def logit(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip((raw - self.mean) / self.scale, -8, 8)
        return self.hidden(x) @ self.weights[2] + self.weights[3]

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(raw), -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, units: int = 24, epochs: int = 60, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Minimises the non-negative risk with the logistic loss by Adam."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-6, [rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], units)), np.zeros(units), rng.normal(0, 0.1, units), np.zeros(1)])
    xp, xu = (np.clip((x - net.mean) / net.scale, -8, 8) for x in (positive, unlabelled))
    m, v, t = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        n_steps = max(1, int(np.ceil(len(xu) / batch)))
        order_u, order_p = rng.permutation(len(xu)), rng.permutation(len(xp))
        for k in range(n_steps):
            bu, bp = xu[order_u[k::n_steps]], xp[order_p[k::n_steps]] if len(xp) >= n_steps else xp
            x = np.vstack([bp, bu])
            hid = net.hidden(x)
            z = hid @ net.weights[2] + net.weights[3]
            zp, zu = z[: len(bp)], z[len(bp) :]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # d/dz of the mean losses: -sig(-z) for label 1, sig(z) for label 0
            if negative >= 0:
                g = np.concatenate([prior * (-sig(-zp) - sig(zp)) / len(bp), sig(zu) / len(bu)])
            else:
                g = -np.concatenate([-prior * sig(zp) / len(bp), sig(zu) / len(bu)])
            back = np.outer(g, net.weights[2]) * (1 - hid**2)
            grads = [x.T @ back, back.sum(0), hid.T @ g, np.array([g.sum()])]
            t += 1
            for i, w in enumerate(net.weights):
                d = grads[i] + decay * w
                m[i] += 0.1 * (d - m[i])
                v[i] += 0.001 * (d * d - v[i])
                w -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled rows, by the best bin."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    h, k = len(p) // 2, len(u) // 2
    net = train(positive[p[:h]], unlabelled[u[:k]], 0.5, epochs=30)
    sp, su = np.sort(net.logit(positive[p[h:]])), np.sort(net.logit(unlabelled[u[k:]]))
    share_p = 1 - np.searchsorted(sp, sp, side="left") / len(sp)
    share_u = 1 - np.searchsorted(su, sp, side="left") / len(su)
    width = np.sqrt(np.log(4 / delta) / 2 / len(sp)) + np.sqrt(np.log(4 / delta) / 2 / len(su))
    best = (share_u / share_p + (1 + slack) / share_p * width).argmin()
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def held_out(id_col: Column | str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col), F.lit(5)) == 0, F.lit(False))


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            x = features(b.column("text"))
            x = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("positive"), b.column("unlabelled"), x], names=["doc_id", "positive", "unlabelled", "x"])

    return docs.mapInArrow(run, "doc_id long, positive boolean, unlabelled boolean, x array<double>")


def _share(n: int, most: int) -> int:
    """Of 2**32 hash values, those that take about ``most`` of n rows."""
    return (1 << 32) if n <= most else int((1 << 32) * (most / n))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, most_unlabelled: int = MOST_UNLABELLED) -> Network | None:
    """A network from the training rows, or None without labelled positives."""
    taken = lambda n, most, *by: F.pmod(F.xxhash64(*by), F.lit(1 << 32)) < F.lit(_share(n, most))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    n = known.count()
    if not n:
        return None
    slim = balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).where("doc_id is not null").where(~held_out())
    total = slim.select("doc_id").count()
    trusted = known.where(taken(n, most_labelled, "doc_id")).select("doc_id", F.lit(True).alias("positive"))
    # about MOST_LABELLED ids at most, so they can go to every task
    rows = slim.join(F.broadcast(trusted), "doc_id", "left").select("doc_id", "text", F.col("positive").isNotNull().alias("positive"), taken(total, most_unlabelled, "doc_id", "text").alias("unlabelled"))
    # one text for each positive id, so its number bounds them however often it stands; repeated rows once
    chosen = rows.where("positive").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.lit(True).alias("positive"), F.lit(False).alias("unlabelled"))
    drawn = rows.where("unlabelled").select("doc_id", "text").distinct().select("doc_id", "text", F.lit(False), F.lit(True))
    rows = chosen.unionAll(drawn)
    got = _feature_rows(rows).toPandas().sort_values(["doc_id", "x"], kind="stable", key=lambda c: c.map(tuple) if c.name == "x" else c)
    if not got["positive"].any():
        return None
    x = np.vstack(got["x"].to_numpy())
    positive, unlabelled = x[got["positive"].to_numpy()], x[got["unlabelled"].to_numpy()] if got["unlabelled"].any() else x
    return train(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            p = shared.value.score(features(b.column("text"))) if shared.value else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, net: Network | None, at: float = PREDICT_AT, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that score at least ``at``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text_col):
            good = shared.value.score(features(b.column(text_col))) >= at if shared.value else np.ones(b.num_rows, dtype=bool)
            yield b.filter(pa.array(good))

    return balanced(docs).mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
