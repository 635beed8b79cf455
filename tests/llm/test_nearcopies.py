import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from waymill.llm import nearcopies

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(texts):
    """Index of each text -> least index that 5-word Jaccard links of 0.8 reach."""
    sets = [plain_shingles(t) for t in texts]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < i}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    groups = plain_groups([r.text for r in rows])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {rows[g].doc_id for g in groups}


def test_edited_copies_nulls_and_repeated_ids(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 700]))]
        texts += [" ".join(words), *(edited(rng, words, len(words) // 60 + 1) for _ in range(4))]
    chain = [f"c{i}" for i in range(200)]  # each next to the one before, the ends far apart
    for i in range(8):
        texts.append(" ".join(chain[i * 10 : i * 10 + 120]))
    texts += ["", None, " \n", "One two", "one TWO", "two one", "a b c d e", "A b\tc d e"]
    rng.shuffle(texts)
    groups = plain_groups(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    # one id on two rows, one a near copy of the first text and one of its own
    rows += [(901, "two texts of one id", "p"), (901, "that have nothing to do with one another", "q")]
    rows += [(900, texts[0], "y"), (900, "a text that stands nowhere else at all", "z"), (None, texts[0], "n"), (0, texts[0], "again")]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([*set(groups), 900, 901, 901])
    assert [r.source for r in kept if r.doc_id == 900] == ["z"]
    assert sum(r.doc_id is None for r in kept) == 1
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert nearcopies.keep_one(none).count() == 0


def test_pairs_at_the_limit_share_a_key():
    rng = np.random.default_rng(1)
    a, b = [], []
    for _ in range(1000):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 94)]
        a.append(" ".join(words))
        words[10], words[-1] = "x", "y"
        b.append(" ".join(words))
    x, y = pa.array(a), pa.array(b)
    assert nearcopies.are_near(x, y).all()
    assert (nearcopies.band_keys(*nearcopies.shingles(x)) == nearcopies.band_keys(*nearcopies.shingles(y))).any(axis=1).all()


def test_cells_lose_no_similar_pair():
    rng = random.Random(4)
    texts = []
    for n in (30, 400, 3000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(words), *(edited(rng, words, k) for k in (1, n // 60 + 1, n // 50 + 1, n // 40, n // 20))]
    h, bounds = nearcopies.shingles(pa.array(texts))
    size, level, kept = zip(*(nearcopies.sketch(h[s:e]) for s, e in zip(bounds, bounds[1:])))
    assert max(level) > 0 and all(len(k) <= 4 * nearcopies.SKETCH for k in kept)
    lead = np.arange(len(texts)) % 3 > 0
    p, q = nearcopies.similar(lead, np.arange(len(texts)), np.array(size), np.array(level), [np.frombuffer(k, np.uint32) for k in kept])
    found = {(min(a, b), max(a, b)) for a, b in zip(p.tolist(), q.tolist())}
    sets = [plain_shingles(t) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (lead[i] or lead[j])}
    assert near and near <= found
    assert all(len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) for i, j in found)


def test_a_large_group_of_copies_of_one_text(spark, monkeypatch):
    """Copies that are near the text but not near one another, with stragglers and a second group, in small cells."""
    monkeypatch.setattr(nearcopies, "FEW", 8)
    monkeypatch.setattr(nearcopies, "MANY", 16)
    rng = random.Random(12)
    words, texts = [f"w{i}" for i in range(100)], []
    texts = [" ".join(words)] + [edited(rng, words, rng.choice([1, 2, 3, 4])) for _ in range(120)]
    other = edited(rng, words, 6).split()
    texts += [" ".join(other)] + [edited(rng, other, 2) for _ in range(40)]
    groups = plain_groups(texts)
    kept = nearcopies.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(set(groups)) > 5 and sorted(r.doc_id for r in kept) == sorted(set(groups))
