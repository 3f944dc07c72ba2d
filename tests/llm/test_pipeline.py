"""The pipeline: every stage on its input, the whole on small tables, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sparkloom.llm import langid, mixing
from sparkloom.llm.common import written

from test_simhash import slow_components, slow_fingerprint  # isort: skip


def slow_shingles(text, words=5):
    ws = text.lower().split()
    return {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))}


def names(docs):
    return sorted(docs.columns)


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = written(stage(spark, docs, small), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def test_stages_are_those_asked_for(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    assert all(names(a) == names(b) for a, b in stages[:-1])


def test_language_id_keeps_what_has_letters(stages):
    before, after = stages[0]
    assert after.count() == before.count()  # all documents at this size are clean


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = before.orderBy("doc_id").collect()
    groups = slow_components([r["doc_id"] for r in rows], [slow_fingerprint(r["text"], 5) for r in rows], 4)
    sets = [slow_shingles(r["text"]) for r in rows]
    for i, a in enumerate(sets):  # pairs of similarity 0.8 or more are linked as well, with whatever the fingerprints say
        for j, b in enumerate(sets[:i]):
            if groups[i] != groups[j] and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((groups[i], groups[j]))
                groups = [low if g == high else g for g in groups]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(groups))


def test_copies_of_items_go_and_clean_documents_stay(spark, small, stages):
    before, after = stages[2]
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: flat(r["text"]) for r in before.collect()}
    assert {r["doc_id"] for r in after.collect()} == {d for d, t in rows.items() if not any(i in t for i in items)}


def test_mix_repeats_as_planned(stages):
    before, after = stages[3]
    plan = mixing.plan_mixture(P._with_row(before), key=P.ROW).select(P.ROW, F.size("positions").alias("n"))
    expected = {r["doc_id"]: r["n"] for r in P._with_row(before).join(plan, P.ROW).collect() if r["n"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == expected


def test_every_row_has_a_place(stages):
    before, after = stages[4]
    rows = after.collect()
    assert len(rows) == before.count()
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_run_is_the_stages_one_after_another(spark, small, stages):
    key = lambda df: sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in df.collect())
    assert key(P.run(spark, small)) == key(stages[-1][1])


def test_odd_rows_pass_every_stage(spark, small, odd, clashing, nothing):
    for docs in (odd, clashing):
        after = P.language_id(spark, docs, small)
        assert names(after) == names(docs) and {r["doc_id"] for r in after.collect()} >= {1, 2, 8}
        assert all(r["text"] for r in after.collect())
        after = P.near_duplicates(spark, docs, small)
        kept = [r["doc_id"] for r in after.collect()]
        assert names(after) == names(docs) and kept.count(1) == 1 and 2 not in kept and 8 not in kept
        assert names(P.decontaminate(spark, docs, small)) == names(docs)
        after = P.mix_sources(spark, docs, small)
        assert names(after) == names(docs) and after.count() > 0
        assert P.shard(spark, docs, small).count() == docs.count()
    for _, stage in P.STAGES:
        assert stage(spark, nothing, small).count() == 0
    assert langid.UNKNOWN == "und"


def test_rows_equal_in_all_stay_once(spark, small):
    docs = spark.createDataFrame([(5, "a b c d e f g", "en", "s", 1)] * 3 + [(None, "p q r s t u v", "en", "s", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in P.near_duplicates(spark, docs, small).collect()) == ["5", "None"]


def test_without_labels_documents_with_a_letter_stay(spark, small):
    docs = spark.createDataFrame([(1, "some text", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1), (4, "ü", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.language_id(spark, docs, small).collect()) == [1, 4]
