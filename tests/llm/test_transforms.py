"""Fill-in-middle, spelling variants and token-id files against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymill.llm import bpe, infill, planes, variants
from waymill.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, word string, n int, form string, h string, id int, run string"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (None, "plain words here"), (None, None), (4, "same words twice"), (4, "same words twice"), (4, "other words"), (5, "marks <P> in <S> it"), (6, "long wörds " * 40_000), (7, "x" * 300_000), (8, "  lead and trail \n\n"), (9, "😀 <|endoftext|> a\x0bb\x0cc é")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, "w", 3, "f", "h", 1, "r") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE).cache()


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# ---------------------------------------------------------------- 11 fill-in-middle


def plain_infill(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100)])
def test_infill_equals_the_plain_version(spark, edge, rate, spm):
    got = [tuple(r) for r in infill.infill(edge, rate=rate, spm=spm).collect()]
    assert key(got) == key([plain_infill(i, t, rate=rate, spm=spm) for i, t in EDGE])


def test_infill_restores_every_text(spark, edge):
    found = infill.infill(edge, rate=100, spm=50)
    got = found.select("doc_id", infill.restored("output", "form").alias("t")).collect()
    assert key([tuple(r) for r in got]) == key([(i, t or "") for i, t in EDGE])


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 50), st.text(alphabet="ab <PSM>\t\n é😀", max_size=30)), min_size=1, max_size=25))
def test_infill_of_any_texts(spark, rows):
    got = [tuple(r) for r in infill.infill(frame(spark, rows), rate=100, spm=40).collect()]
    assert key(got) == key([plain_infill(i, t, rate=100, spm=40) for i, t in rows])


def test_infill_query_and_empty_table(spark):
    got = {r.doc_id: r for r in infill.op11_infill(spark, SF).collect()}
    for i, t in texts(spark):
        want = plain_infill(i, t)
        assert tuple(got[i])[:5] == want[:5]
        assert got[i].output_sha256 == hashlib.sha256(want[5].encode()).hexdigest() and got[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert infill.digests(infill.infill(frame(spark, []))).count() == 0


def test_infill_shuffles_a_text_once(spark):
    """Only cut texts, by their row; window, join and sums keep that partitioning."""
    plan = infill.infill(frame(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 12 spelling variants


def plain_words(rows, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


_letters = st.text(alphabet="abcÀé÷", min_size=1, max_size=9)


@settings(max_examples=200, deadline=None)
@given(found=st.lists(_letters, min_size=1, max_size=40, unique=True), per_shard=st.integers(1, 40))
def test_automata_over_shards_equal_brute_force(found, per_shard):
    pairs = sorted((w.encode("latin-1"), i) for i, w in enumerate(found))
    turned = sorted((w[::-1], i) for w, i in pairs)
    tries = lambda rows: [variants.Trie(variants.packed_trie([w for w, _ in rows[a : a + per_shard]], [i for _, i in rows[a : a + per_shard]])) for a in range(0, len(rows), per_shard)]
    forward, backward = tries(pairs), tries(turned)
    for w in found:
        got = sorted(variants.neighbours(w.encode("latin-1"), forward, backward))
        assert got == sorted((x.encode("latin-1"), i) for i, x in enumerate(found) if one_edit(w, x))


def slips(rng, words, n):
    """Texts over words and words that are one letter off."""
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(80)):
            w = rng.choice(words)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "q", "q" + w[at]]) + w[at + 1 :]
            text.append(w)
        out.append((i, " ".join(text)))
    return out


def test_variants_equal_the_plain_version_over_many_shards(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["ÀÉÎõüß", "Ünïque", "x" * 5000, "x" * 4999 + "y"]
    rows = slips(rng, words, 120) + [(i, "common Common COMMON commo comon coommon " * 9) for i in range(200, 300)] + EDGE
    monkeypatch.setattr(variants, "SHARD_NODES", 400)
    monkeypatch.setattr(variants, "BLOCK_BYTES", 20_000)
    scratch = Scratch(spark)
    counted = scratch.keep(variants.words(frame(spark, rows)), "w")
    tries = variants.shards(counted, scratch, 3)
    assert len(variants.blocks(tries)) > 3 and tries.where("backward").count() > 3
    assert sorted(map(tuple, variants.variants(frame(spark, rows)).collect()), key=str) == sorted(plain_variants(rows), key=str)


def test_variants_of_a_chain_and_of_nothing(spark):
    chain = ["abcdefgh", "abcdefg", "abcdef"]
    rows = [(i, f" {w} ") for w, n in zip(chain, (250, 40, 7)) for i in range(n)]
    got = {r.word: r for r in variants.variants(frame(spark, rows)).collect()}
    want = {r[0]: r for r in plain_variants(rows)}
    assert {w: tuple(r) for w, r in got.items()} == want and got["abcdef"].root == "abcdefgh"
    assert variants.variants(frame(spark, [])).count() == 0 and variants.variants(frame(spark, [(1, None), (2, "ab cd")])).count() == 0


# ---------------------------------------------------------------- 13 token-id files

_ids = st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40), max_size=12)


@settings(max_examples=80, deadline=None)
@given(docs=_ids, kind=st.sampled_from([planes.BYTES, planes.BITS]), block=st.sampled_from([1, 7, 64]), data=st.data())
def test_files_give_back_what_was_written(docs, kind, block, data):
    old, planes.BLOCK_IDS = planes.BLOCK_IDS, block
    try:
        w = planes.Writer(3, 1, kind)
        for i, ids in enumerate(docs):
            w.add(None if i % 5 == 4 else i - 2, np.array(ids, "<u4"))
        r = planes.Reader(w.finish() + planes.CLOSING)
        got = [(name, start, np.concatenate(p).tolist() if p else []) for name, start, p in r.documents()]
        starts = np.cumsum([0] + [len(d) for d in docs]).tolist()
        assert got == [(None if i % 5 == 4 else i - 2, starts[i], ids) for i, ids in enumerate(docs)] and (r.part, r.number) == (3, 1)
        whole = [x for d in docs for x in d]
        a = data.draw(st.integers(0, len(whole)))
        b = data.draw(st.integers(a, len(whole)))
        assert r.range(a, b).tolist() == whole[a:b]
    finally:
        planes.BLOCK_IDS = old


def test_damaged_files_are_told():
    w = planes.Writer()
    w.add(1, np.arange(5000, dtype="<u4"))
    good = w.finish() + planes.CLOSING
    assert planes.Reader(good).range(10, 13).tolist() == [10, 11, 12]
    for bad in (good[:-1], good[: len(good) // 2], b"", good[:-70] + bytes([good[-70] ^ 1]) + good[-69:]):
        with pytest.raises(ValueError):
            planes.Reader(bad)
    flipped = bytearray(good)
    flipped[len(planes.OPENING) + 30] ^= 255
    with pytest.raises((ValueError, __import__("zstandard").ZstdError)):
        planes.Reader(bytes(flipped)).range(0, 5000)


def plain_planes(rows, library):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_token_files_equal_the_plain_version(spark, library):
    assert sorted(map(tuple, planes.op13_planes(spark, SF).collect())) == plain_planes(texts(spark), library)


@pytest.mark.parametrize("kind", [planes.BYTES, planes.BITS])
def test_token_files_of_odd_rows_in_many_files(spark, edge, library, monkeypatch, kind):
    monkeypatch.setattr(planes, "FILE_IDS", 500)
    monkeypatch.setattr(planes, "BLOCK_IDS", 128)
    monkeypatch.setattr(planes, "PIECE_BYTES", 4096)
    path = Scratch(spark).path("planes")
    planes.write_ids(planes.token_ids(edge, bpe.default_vocabulary()), path, kind)
    got = [tuple(r) for r in planes.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want = plain_planes(EDGE, library)
    total = sum(r[2] for r in want)
    # rows with one id follow each other in either order: their places are compared as a whole
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in want)
    spans = sorted((r[1], r[1] + r[2], str(r[0])) for r in got)
    assert spans[0][0] == 0 and spans[-1][1] == total and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [s[2] for s in spans] == [str(r[0]) for r in want]
    whole = {(r.start): np.frombuffer(r.ids, "<u4").tolist() for r in planes.read_ids(spark, path).collect()}
    for start, ids in whole.items():
        assert ids[-1] == 2 and library.decode(ids[:-1], skip_special_tokens=False) in {t or "" for _, t in EDGE}


def test_token_files_of_nothing(spark):
    path = Scratch(spark).path("planes")
    planes.write_ids(planes.token_ids(frame(spark, []), bpe.default_vocabulary()), path)
    assert planes.read_digests(spark, path).count() == 0 and planes.read_ids(spark, path).count() == 0
