"""Language identification: held-out accuracy, windows, odd rows."""

import numpy as np

from sparkloom.llm import langid
from sparkloom.llm.langid import Network, Scorer


def test_held_out_accuracy(spark, small):
    got = {r["doc_id"]: r for r in langid.op6_langid(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    out = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert 0.1 < len(out) / len(docs) < 0.4
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in out) / len(out) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def small_model():
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 105, 64) for _ in range(200)] + [rng.integers(110, 118, 64) for _ in range(200)]
    return langid.train(np.array(texts, np.uint8), np.array([0] * 200 + [1] * 200), ("aa", "nn"), Network(window=64, filters=4))


def test_tables_of_pairs_give_what_the_filters_give():
    model = small_model()
    x = np.random.default_rng(1).integers(0, 256, (50, 64)).astype(np.uint8)
    pooled = np.concatenate([r.max(axis=1) for r in langid._responses(model.tables, x)], axis=1) + model.bias
    plain = langid._softmax(np.maximum(pooled, 0) @ model.dense + model.shift)
    assert np.allclose(Scorer(model).windows(x), plain, atol=1e-5)


def test_blocks_of_windows_do_not_matter():
    scorer = Scorer(small_model())
    texts = [b"abc", b"abcdefgh" * 100, b"nopq" * 33, b"ab" * 64]
    assert np.allclose(scorer.texts(texts), scorer.texts(texts, block=1))
    assert scorer.texts(texts).argmax(axis=1).tolist() == [0, 0, 1, 0]


def test_odd_rows(odd, clashing, nothing):
    model = langid.fit(odd)
    assert set(model.labels) <= {"en", "de"}
    for docs in (odd, clashing):
        got = langid.predict(docs, model, label="found", score="p").collect()
        assert len(got) == 12
        for r in got:
            unknown = r["text"] is None or not any(c.isalpha() for c in r["text"])
            assert (r["found"] == "und" and r["p"] == 0) if unknown else r["found"] in model.labels
    assert langid.fit(nothing) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def slow_scores(model, text):
    """Filter by filter and place by place, on windows of the text one after another, weighted by their bytes."""
    data, total = text.encode(), np.zeros(len(model.labels))
    for at in range(0, len(data), model.window):
        piece = data[at : at + model.window]
        x = piece + bytes(model.window - len(piece))
        n, pooled = model.window - max(model.tables) + 1, []
        for w, t in model.tables.items():
            pooled += [max(sum(float(t[k, x[p + k], f]) for k in range(w)) for p in range(n)) for f in range(t.shape[2])]
        hidden = np.maximum(np.array(pooled) + model.bias, 0)
        e = np.exp(hidden @ model.dense + model.shift)
        total += e / e.sum() * len(piece)
    return total / total.sum()


def test_predictions_against_plain_filters(spark):
    model = small_model()
    texts = ["abc", "abcdefgh" * 20, "nopq" * 33 + "abc" * 50, "nopqrstu" * 9, "q"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        p = slow_scores(model, r["text"])
        assert r["lang_pred"] == model.labels[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4


def test_numbers_are_no_letters(spark):
    rows = [(1, "½ ²"), (2, "Ⅷ 12"), (3, "①"), (4, "½ ü"), (5, "ª"), (6, "_")]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), small_model()).collect()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {i for i, t in rows if not any(c.isalpha() for c in t)} == {1, 2, 3, 6}


def test_sample_is_bounded_whatever_the_keys(spark):
    rows = [(1, f"text {i} of one key", "en") for i in range(5000)] + [(2, "the same row", "de")] * 3000 + [(None, f"no key {i}", "fr") for i in range(40)]
    docs, net = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), Network(per_label=128, per_text=2)
    _, y, labels = langid.sample_windows(docs, net, "text", "lang", "doc_id")
    n = dict(zip(labels, np.bincount(y).tolist(), strict=True))
    assert labels == ("de", "en", "fr") and 64 < n["en"] <= 256 and n["de"] == 2 and n["fr"] >= 40
