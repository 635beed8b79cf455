"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. A byte costs
-log2 of its share in the longest context that the language has seen; a context
without the byte costs its escape (distinct followers / (occurrences +
distinct)) and passes on to the next shorter one, down to 1/256. The statistics
are frozen after training, so these costs are a table (single precision), and
the code length of a whole text is a sum of look-ups (double precision).
Contexts that occur less than LEAST times in every language are no part of the
trees: their shorter ones stand for them.

Training takes at most about MOST_DOCS training rows of each language, chosen by a
hash of doc_id; every row is scored. The models are held by the driver and all
workers: their size grows with the contexts (bounded by the sample) times
languages, and models of more than MOST_BYTES are refused, not sent.

Rows: null texts and texts without a letter (Unicode category L) are ``und`` with score 0, as is
everything when nothing can be learned; equal code lengths give the first
language by name; a row without doc_id is not held out and never trains; rows
with null lang never train; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import balanced, packed, steps, table

ORDER = 3
LEAST = 4
MOST_DOCS = 1500
#: The models' table of code lengths and the table of states (4 bytes an entry) hold at most so many bytes together.
MOST_BYTES = 256 << 20

_LETTER = regex.compile(r"\p{L}")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _shifted(values: np.ndarray, ends: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places before each, 0 before a text's beginning."""
    out = np.zeros_like(values)
    out[by:] = values[:-by] if by else values
    for k in range(by):
        at = ends[:-1] + k
        out[at[at < ends[1:]]] = 0
    return out


def _grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number."""
    v = data.astype(np.int64)
    out = v.copy()
    for k in range(1, ORDER + 1):
        out |= _shifted(v, ends, k) << (8 * k)
    return out


class Models:
    """All languages' code lengths as one table."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int = LEAST):
        self.langs = sorted(counts)
        n_lang = len(self.langs)
        seen = np.unique(np.concatenate([g for g, _ in counts.values()]))
        parts = [(seen >> (8 * k)) & 255 for k in range(ORDER + 1)]
        used = np.unique(np.concatenate([np.zeros(1, np.int64), *parts]))
        self.symbol = np.full(256, len(used), dtype=np.int32)  # bytes never seen share one symbol
        self.symbol[used] = np.arange(len(used))
        a = self.a = len(used) + 1
        cost, states, below = [], [np.zeros(1, np.int64)], None
        for depth in range(ORDER + 1):
            # contexts of this depth, newest byte in the lowest digit
            per = []
            for name in self.langs:
                g, n = counts[name]
                ctx = np.zeros(len(g), np.int64)
                for k in range(depth, 0, -1):
                    ctx = ctx * a + self.symbol[(g >> (8 * k)) & 255]
                key, at = np.unique(ctx * a + self.symbol[g & 255], return_inverse=True)
                per.append((key, np.bincount(at, weights=n)))
            if depth:
                often = [np.unique(k // a)[np.bincount(np.unique(k // a, return_inverse=True)[1], weights=n) >= least] for k, n in per]
                here = np.unique(np.concatenate(often))
                # a context stands only if its shorter one does
                here = here[np.isin(here % a ** (depth - 1), states[depth - 1])]
                states.append(here)
                self._fits(states, n_lang)
                base = below[np.searchsorted(states[depth - 1], here % a ** (depth - 1))]
            else:
                here = states[0]
                self._fits(states, n_lang)
                base = np.full((1, a, n_lang), 8.0)
            table = base.copy()
            for l, (key, n) in enumerate(per):
                own = np.isin(key // a, here)
                at, sym, n = np.searchsorted(here, key[own] // a), key[own] % a, n[own]
                total = np.bincount(at, weights=n, minlength=len(here))
                distinct = np.bincount(at, minlength=len(here))
                known = total > 0
                table[known, :, l] += -np.log2(distinct[known] / (total[known] + distinct[known]))[:, None]
                table[at, sym, l] = -np.log2(n / (total[at] + distinct[at]))
            cost.append(table.astype(np.float32))
            below = table
        first = np.cumsum([0, *(len(s) for s in states)])
        self.cost = np.ascontiguousarray(np.concatenate(cost).reshape(-1, n_lang).T)
        # the state of the last ORDER symbols: their deepest context
        self.state = np.zeros(a**ORDER, dtype=np.int32)
        cells = np.arange(a**ORDER)
        for depth in range(1, ORDER + 1):
            short = cells % a**depth
            pos = np.searchsorted(states[depth], short)
            pos[pos == len(states[depth])] = 0
            if len(states[depth]):
                ok = states[depth][pos] == short
                self.state[ok] = first[depth] + pos[ok]

    def _fits(self, states: list[np.ndarray], n_lang: int) -> None:
        """Raises before a depth's costs are made if the models would outgrow MOST_BYTES."""
        contexts = sum(len(s) for s in states)
        if contexts * self.a * n_lang * 4 + self.a**ORDER * 4 > MOST_BYTES:
            raise ValueError(f"{contexts} contexts of {n_lang} languages exceed MOST_BYTES; train on fewer rows or raise it")

    def bits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of every text under every language, in bits."""
        out = np.zeros((len(ends) - 1, len(self.langs)))
        if not len(data):
            return out
        sym = self.symbol[data]
        ctx = np.zeros(len(data), dtype=np.int32)
        for k in range(ORDER, 0, -1):
            ctx *= self.a
            ctx += _shifted(sym, ends, k)
        at = self.state[ctx] * self.a
        at += sym
        some = np.flatnonzero(np.diff(ends))
        for l in range(len(self.langs)):
            out[some, l] = np.add.reduceat(self.cost[l].take(at), ends[some], dtype=np.float64)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        letters = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], dtype=bool)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        bits = self.bits(*packed(column))
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        return [self.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())], np.where(letters, share, 0.0)


def fit(docs: DataFrame, most: int = MOST_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = slim.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, (1 << 32) if n <= most else int((1 << 32) * most / n))])
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < limit[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            langs = np.array(b.column("lang").to_pylist())
            for lang in np.unique(langs):
                g, n = np.unique(_grams(*packed(b.column("text").filter(pa.array(langs == lang)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(g)), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    got = taken.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "gram"])
    if not len(got):
        return None
    return Models({lang: (d["gram"].to_numpy(), d["n"].to_numpy().astype(float)) for lang, d in got.groupby("lang")})


def identify(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", 1 << 20):
            lang, score = shared.value.predict(b.column("text")) if shared.value else (["und"] * b.num_rows, np.zeros(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
