"""Decontamination: alignment against the textbook recurrence, planted copies, odd rows."""

import random

import numpy as np
import pytest

from sparkloom.llm import decontam
from sparkloom.llm.decontam import Alignment


def slow_score(a, b, spec):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = spec.match if a[i - 1] == b[j - 1] else spec.mismatch
            h[i, j] = max(0, h[i - 1, j - 1] + same, h[i - 1, j] + spec.gap, h[i, j - 1] + spec.gap)
    return int(h.max())


def test_alignment_against_the_recurrence():
    rng = np.random.default_rng(1)
    for spec in (Alignment(), Alignment(match=3, mismatch=-2, gap=-2)):
        for _ in range(60):
            a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 40))
            assert decontam.smith_waterman(a, b, spec)[0] == slow_score(a, b, spec)


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(r.randint(15, 50)))) for i in range(20)]
    docs, truth = [], set()
    for d in range(160):
        body = say(r.randint(30, 200))
        if d % 4 == 0:
            i, text = r.choice(items)
            copy = text.split()
            if d % 8 == 0:  # edited: a twelfth each replaced, dropped and doubled
                chance = [r.random() for _ in copy]
                copy = [w for x, p in zip(copy, chance, strict=True) for w in ([r.choice(words)] if p < 1 / 12 else [] if p < 2 / 12 else [x, x] if p < 3 / 12 else [x])]
            at = r.randint(0, len(body))
            body[at:at] = [copy[0].upper() + ",", *copy[1:]]
            truth.add((d, i))
        docs.append((d, " ".join(body)))
    # An item that a third of all documents holds has no rare n-gram of its own, and is found all the same.
    common = " ".join(say(25))
    items.append((99, common))
    for d in range(200, 280):
        docs.append((d, " ".join(say(10)) + " " + common))
        truth.add((d, 99))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), truth


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_planted_copies_and_nothing_else(planted, block):
    docs, items, truth = planted
    rows = decontam.with_hits(docs, items, Alignment(block_words=block)).collect()
    assert {(r["doc_id"], h["item_id"]) for r in rows for h in r["hits"]} == truth
    for r in rows:
        for h in r["hits"]:
            assert 0.4 <= h["score"] <= 1 and 0 <= h["first_word"] < h["end_word"]


def test_query(spark, small):
    import re

    hits = decontam.op5_decontaminate(spark, small).collect()
    assert hits
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    docs = {r["doc_id"]: flat(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: flat(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    assert exact <= {(h["doc_id"], h["item_id"]) for h in hits}


def test_odd_rows(spark, odd, clashing, nothing, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (1, odd_rows[0][1]), (2, None), (3, ""), (4, "x"), (None, odd_rows[0][1]), (5, "wort und satz wort")], "item_id long, text string")
    for docs in (odd, clashing):
        got = decontam.with_hits(docs, items, out="found").collect()
        by = sorted((str(r["doc_id"]), [h["item_id"] for h in r["found"]]) for r in got)
        whole = [1, 1, None]
        assert by == sorted([("1", whole), ("2", whole), ("3", []), ("4", []), ("5", []), ("None", whole), ("6", []), ("7", [5]), ("8", whole), ("8", whole), ("9", []), ("None", [])])
    assert decontam.with_hits(nothing, items).count() == 0
    assert all(r["hits"] == [] for r in decontam.with_hits(odd, items.limit(0)).collect())


def test_only_copies_with_many_edits(spark):
    """The n-grams that no document has are those the edits broke; the ones kept are the more frequent."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    items, docs = [], []
    for i in range(60):
        copy = [r.choice(words) for _ in range(r.randint(20, 40))]
        items.append((i, " ".join(copy)))
        # Every fourth word replaced, or every third but the last few, which leaves a run to find it by.
        at = range(3, len(copy), 4) if i % 2 else range(2, len(copy) - 4, 3)
        for j in at:
            copy[j] = r.choice(words)
        body = [r.choice(words) for _ in range(100)]
        body[50:50] = copy
        docs.append((i, " ".join(body)))
    got = decontam.with_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    spec = Alignment()
    truth = set()
    for d, t in docs:
        for i, x in items:
            a, b = (np.array([hash(w) for w in y.split()]) for y in (x, t))
            if i == d and slow_score(a, b, spec) / (spec.match * len(a)) >= spec.least:
                truth.add((d, i))
    assert len(truth) >= 45
    assert {(g["doc_id"], h["item_id"]) for g in got for h in g["hits"]} == truth


def test_query_against_alignment_of_all_pairs(spark, small):
    """op5 on the small tables: every pair of document and item, aligned over the whole text."""
    import re

    spec = Alignment()
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    docs = [(r["doc_id"], words(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], words(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    number, truth = {}, set()
    of = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    docs, items = [(d, of(w)) for d, w in docs if w], [(i, of(w)) for i, w in items if len(w) >= spec.n]
    for i, item in items:
        for d, text in docs:
            if np.isin(item, text).sum() >= spec.least * len(item):  # else no alignment reaches the score
                best = max(decontam.smith_waterman(item, text[at : at + 4 * len(item)], spec)[0] for at in range(0, len(text), 2 * len(item)))
                if best >= max(spec.least, min(1.0, spec.least_words / len(item))) * spec.match * len(item):
                    truth.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op5_decontaminate(spark, small).collect()}
    assert len(truth) >= 3 and got == truth


def test_short_items_match_as_a_whole(spark):
    items = spark.createDataFrame([(1, "what is the capital of france"), (2, "is the capital"), (3, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "berlin is the capital city of a country"), (2, "tell me what is the capital of france now"), (3, "one two three")], "doc_id long, text string")
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.with_hits(docs, items).collect()}
    assert got == {1: [2], 2: [1, 2], 3: []}
