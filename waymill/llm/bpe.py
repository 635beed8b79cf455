"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts texts into chunks, so a passage
that documents share is cut alike in each of them. A chunk is encoded once, from
cut to cut, and its tokens are reused by every later document of the worker
process, in this task and later ones (a bounded store, see STORE_BYTES).

Tokens near a cut are wrong in general, so each join of two chunks is repaired.
An agreement point is a white space after a visible character: the
pre-tokeniser always splits there. The join is encoded anew from the agreement
point before the last one ahead of the cut to that after the first one behind
it. If the outer stretches' tokens are those that the two chunks have there,
they agree exactly and the tokens between replace the chunks' own; otherwise
the window grows by one agreement point on either side and is encoded again. It
ends, at the latest, where the neighbouring joins do. Cuts without an agreement
point between them count as one. The concatenation is therefore the encoding of
the whole text, for every text.

A store for the whole corpus would have to shuffle all texts and their ids
twice; chunks are shared within each worker process instead, which keeps memory
bounded and needs no shuffle.

Rows: null text counts as empty and has no ids; ids of repeated or missing
doc_id pass through; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import balanced, packed, steps, table

WINDOW = 16
#: A cut needs this many zero bits: 512 bytes between cuts on average.
CUT_BITS = 9
#: A cut counts only if the one before is as far away.
LEAST_CHUNK = 32
#: Bytes of chunks that a worker stores at most; when full, it starts anew.
STORE_BYTES = 48 << 20

# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Of each vocabulary: the chunks and joins that this worker process has encoded, and their size.
_stores: dict[str, tuple[dict, list[int]]] = {}

_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# last bytes of visible characters: ASCII signs, or no last byte of a Unicode space
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x80:] = True
_VISIBLE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1
    characters stand for themselves, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {chr(b): b for b in own}, 0x100
    for b in range(256):
        if b not in own:
            out[chr(more)] = b
            more += 1
    return out


class Codec:
    """Encodes and decodes whole pieces; equal to the tokenizers library's
    ``encode(text, add_special_tokens=False)`` and ``decode(ids, skip_special_tokens=False)``."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level vocabularies without normaliser or prefix space")
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens must match literally")
        if any(c.isspace() for t in self.special for c in t):
            raise ValueError("added tokens must not hold white space, which would be no agreement point there")
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][t] for t in joined]
        if order != sorted(order):
            raise ValueError("ids must follow the order of merges")
        self.plain = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self._marks = [s.encode() for s in self.special]
        lengths = {i: len(t) for t, i in ranks.items()} | {i: len(t.encode()) for t, i in self.special.items()}
        self.lengths = np.array([lengths.get(i, 0) for i in range(max(lengths) + 1)], dtype=np.uint32)
        self._other = None

    def ids(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8")
        try:
            if any(m in piece for m in self._marks):
                return self.plain.encode(text, allowed_special="all")
            return self.plain.encode_ordinary(text)
        except BaseException as e:  # the pattern engine gives up on very long runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self._other is None:
                from tokenizers import Tokenizer

                self._other = Tokenizer.from_file(self.path)
                self._other.no_truncation()
                self._other.no_padding()
            return self._other.encode(text, add_special_tokens=False).ids

    def text_bytes(self, ids: list[int]) -> bytes:
        return self.plain.decode_bytes(ids)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions before which the rolling hash cuts, apart from the texts' ends."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    h, k = _GEAR[data], 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS - 4)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    text_start = ends[np.searchsorted(ends, at, side="right") - 1]
    at = at[at - text_start >= WINDOW]
    return at[np.diff(at, prepend=-LEAST_CHUNK) >= LEAST_CHUNK]


def agreement(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted agreement points of all texts, their beginnings and ends among them."""
    point = np.zeros(len(data) + 1, dtype=bool)
    point[1:-1] = _SPACE[data[1:]] & _VISIBLE[data[:-1]]
    point[ends] = True
    return np.flatnonzero(point)


class Tokens:
    """The tokens of a stretch of text: ids, where each ends, and what they decode to."""

    __slots__ = ("ids", "ends", "text")

    def __init__(self, use: Codec, piece: bytes):
        ids = use.ids(piece)
        self.ids = array("I", ids)
        self.ends = array("I", np.cumsum(use.lengths[self.ids], dtype=np.uint32).tobytes())
        self.text = use.text_bytes(ids)

    def between(self, start: int, stop: int) -> array | None:
        """The ids from one place in the stretch to another; None if either splits a token."""
        a = bisect_left(self.ends, start) + 1 if start else 0
        b = bisect_left(self.ends, stop) + 1 if stop else 0
        if start and (a > len(self.ends) or self.ends[a - 1] != start) or stop and (b > len(self.ends) or self.ends[b - 1] != stop):
            return None
        return self.ids[a:b]


class Store:
    """Encodes stretches of text, each once as long as it is stored."""

    def __init__(self, path: str, known: dict, size: list[int]):
        self.use, self.known, self.size = codec(path), known, size

    def tokens(self, piece: bytes) -> Tokens:
        found = self.known.get(piece)
        if found is None:
            found = Tokens(self.use, piece)
            if self.size[0] > STORE_BYTES:
                self.known.clear()
                self.size[0] = 0
            self.known[piece] = found
            self.size[0] += 2 * len(piece) + 8 * len(found.ids) + 450
        return found


def repaired(store: Store, raw: bytes, points: list[int], left: tuple[int, Tokens], right: tuple[int, Tokens], i: int, j: int, first: int, last: int) -> tuple[int, int, array, bytes]:
    """The join of two chunks, each given with its beginning: where it starts and
    stops, as indices of ``points``, its ids and what they decode to. The cut is
    between points i and j; first and last are where the neighbouring joins end."""
    while True:
        a, b = max(i - 1, first), min(j + 1, last)
        lo, hi, p, q = points[a], points[b], points[i], points[j]
        anew = store.tokens(raw[lo:hi])
        inner = anew.between(p - lo, q - lo)
        before = p == lo or anew.between(0, p - lo) == left[1].between(lo - left[0], p - left[0])
        after = q == hi or anew.between(q - lo, hi - lo) == right[1].between(q - right[0], hi - right[0])
        if inner is not None and before and after:
            return i, j, inner, anew.text[p - lo : q - lo]
        i, j = a, b


def encode_column(column: pa.Array, path: str, known: dict, size: list[int]) -> tuple[list[bytes], list[bytes]]:
    """For each text: its ids as little-endian 32-bit integers, and the bytes
    they decode to."""
    store = Store(path, known, size)
    data, ends = packed(column)
    raw, at = data.tobytes(), agreement(data, ends)
    c = cuts(data, ends)
    before, after = np.searchsorted(at, c, side="right") - 1, np.searchsorted(at, c)
    kept = np.diff(before, prepend=-1) > 0  # cuts without an agreement point between them count as one
    c, before, after = c[kept], before[kept].tolist(), after[kept].tolist()
    of = np.searchsorted(c, ends).tolist()
    c, points = c.tolist(), at.tolist()
    bound = np.searchsorted(at, ends).tolist()
    all_ids, all_text = [], []
    for n, (start, stop) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        ids, text = [], []
        marks = range(of[n], of[n + 1])
        chunk, begin, from_point = store.tokens(raw[start : c[marks[0]] if marks else stop]), start, bound[n]
        for k in marks:
            to = c[k + 1] if k + 1 < marks.stop else stop
            following = store.tokens(raw[c[k] : to])
            i, j = before[k], after[k]
            last = before[k + 1] if k + 1 < marks.stop else bound[n + 1]
            i, j, join, joined = repaired(store, raw, points, (begin, chunk), (c[k], following), i, j, from_point, last)
            s, e = points[from_point] - begin, points[i] - begin
            ids += (chunk.between(s, e), join)
            text += (chunk.text[s:e], joined)
            chunk, begin, from_point = following, c[k], j
        s = points[from_point] - begin
        ids.append(chunk.between(s, stop - begin))
        text.append(chunk.text[s:])
        all_ids.append(b"".join([x.tobytes() if _LITTLE else np.array(x, dtype="<u4").tobytes() for x in ids]))
        all_text.append(b"".join(text))
    return all_ids, all_text


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as binary, little-endian unsigned 32-bit
    integers; decoded as text. ``vocabulary`` is the path of the vocabulary file
    on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from waymill.llm import bpe  # the module itself: its store outlives the task

        known, size = bpe._stores.setdefault(vocabulary, ({}, [0]))
        for b in steps(batches, "text", 2 << 20):
            ids, text = encode_column(b.column("text"), vocabulary, known, size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())], names=["doc_id", "ids", "decoded"])

    return balanced(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), default_vocabulary()))
