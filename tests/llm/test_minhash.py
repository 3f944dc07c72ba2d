"""Similar texts: the pipeline's stage against brute-force Jaccard, bands, odd rows."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from sparkloom.llm import minhash
from sparkloom.llm.minhash import MinHash

from test_simhash import slow_fingerprint  # isort: skip


def slow_jaccard(a, b, words=5):
    sets = []
    for t in (a, b):
        ws = t.lower().split()
        sets.append({tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def edited():
    """(doc_id, text): families of edited copies, of copies of copies, and texts without any; similarities on both sides of 0.8."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    docs = []
    for f in range(40):
        texts = [[r.choice(words) for _ in range(r.randint(100, 300))]]
        for _ in range(f % 6):
            copy = list(r.choice(texts))
            for at in r.sample(range(len(copy)), max(1, round(len(copy) * r.uniform(0.01, 0.05)))):
                copy[at] = r.choice(words)
            texts.append(copy)
        docs += [" ".join(t) for t in texts]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, edited):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in edited], "doc_id long, text string, lang string, source string, n_chars long")
    prints = [slow_fingerprint(t, 5) for _, t in edited]
    group, missed = list(range(len(edited))), 0
    for i, a in edited:
        for j, b in edited[:i]:
            near = bin(prints[i] ^ prints[j]).count("1") <= 4
            similar = slow_jaccard(a, b) >= 0.8
            missed += similar and not near
            if near or similar:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert missed > 20  # pairs that the fingerprints alone don't link
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect()) == sorted(set(group))


def test_pairs_of_just_the_least_similarity_share_a_band():
    rng, spec, met, few = np.random.default_rng(0), MinHash(), 0, 0
    for _ in range(2000):
        x = rng.integers(0, 2**63, 100, np.uint64)
        a, b = np.unique(x[:90]), np.unique(x[10:])
        assert minhash.jaccard(a, b) == 0.8
        met += bool((minhash.band_hashes(minhash.minima(a, spec), spec) == minhash.band_hashes(minhash.minima(b, spec), spec)).any())
        few += int((minhash.minima(a, spec) == minhash.minima(b, spec)).sum() < spec.agreeing)
    assert met >= 1998 and few == 0


def test_shingles_are_those_of_words():
    for a, b in [("a b c d e f g", "A  b c d e f\nh"), ("x y", "x y"), ("x y", "y x"), ("a b c d e", "a b c d e a b c d e")]:
        assert minhash.jaccard(*(minhash.shingles(t.encode(), 5) for t in (a, b))) == slow_jaccard(a, b)
    assert len(minhash.shingles(b" \n", 5)) == 0


def near_copies(n, parts, seed):
    """n copies of one text, each with as many replaced words as ``parts`` says by turns, and texts that a copy of them differs from in one word."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for k in range(n):
        copy = list(base)
        for at in r.sample(range(150), parts[k % len(parts)]):
            copy[at] = word()
        texts.append(copy)
        if k % 10 == 0:
            texts.append([*copy[:-1], word()])
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("parts, spec", [((3,), MinHash()), ((1, 2, 3, 4), MinHash(few=4))])
def test_large_groups_of_copies_are_not_compared_pair_by_pair(spark, monkeypatch, parts, spec):
    texts = near_copies(300, parts, 5)
    group = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if group[i] != group[j] and slow_jaccard(a, b) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    compared, similar = [], minhash._similar
    monkeypatch.setattr(minhash, "_similar", lambda pairs, *more: (compared.append(pairs.count()), similar(pairs, *more))[1])
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "t long, r long, text string")
    found = {r["node"]: r["root"] for r in minhash.joined(rows, rows.select("t", "t").toDF("t", "c"), spec).collect()}
    of = [found.get(i, i) for i in range(len(texts))]
    assert len(set(zip(of, group, strict=True))) == len(set(of)) == len(set(group))
    assert compared[1] <= len(texts) ** 2 / 10
