"""Columns that the span finders share."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,stop:int>>"
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

Span = tuple[int, int, str]


def as_arrow(found: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "stop": e} for s, e, k in x] for x in found], ARROW_SPAN)


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed, then end."""
    return sorted(spans, key=lambda x: (x[0], kinds.index(x[2]), x[1]))


class Taken:
    """The stretches that spans cover, as disjoint sorted intervals."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for s, e, *_ in sorted(spans):
            if self.stops and s <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], e)
            else:
                self.starts.append(s)
                self.stops.append(e)

    def free(self, start: int, stop: int) -> bool:
        at = bisect.bisect_right(self.stops, start)
        return at == len(self.starts) or self.starts[at] >= stop


def joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digests(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """(doc_id, n_<kind> of each base kind, base_sha256, spans) of (doc_id, spans)."""
    own = F.filter("spans", lambda x: x["kind"].isin(*base))
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
