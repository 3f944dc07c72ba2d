"""Suffix arrays against sorting, and removal of repeats against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import suffix_dedup
from sparkloom.llm.suffix_dedup import Repeats, repeated_text
from sparkloom.llm.suffix_groups import lyndon_groups, suffix_arrays


def laid_out(texts):
    sizes = np.array([len(t) + 1 for t in texts])
    chars = np.concatenate([np.append(np.asarray(t, int) + 1, 0) for t in texts])
    return chars, np.cumsum(sizes) - sizes, sizes


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        texts = [rng.integers(0, rng.integers(1, 5), rng.integers(0, 60)).tolist() for _ in range(rng.integers(1, 9))]
        chars, base, size = laid_out(texts)
        got = suffix_arrays(chars, base, size)
        for t, b, n in zip(texts, base, size, strict=True):
            assert (got[b : b + n] - b).tolist() == sorted(range(n), key=lambda i, t=t: t[i:])
    assert len(suffix_arrays(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))) == 0


@pytest.mark.parametrize("text", [b"a" * 300, b"ab" * 150, b"abracadabra" * 20, bytes(range(1, 200)), bytes(range(200, 1, -1))])
def test_periodic_texts(text):
    chars, base, size = laid_out([list(text)])
    assert suffix_arrays(chars, base, size).tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])


def test_groups_are_longest_lyndon_prefixes():
    text = b"graindraining"
    chars, base, size = laid_out([list(text)])
    group, _ = lyndon_groups(chars, base, size)

    def lyndon(i):
        s = bytes(x - 1 if x else 0 for x in chars[i:])
        return max((s[:k] for k in range(1, len(s) + 1) if all(s[:k] < s[j:k] for j in range(1, k))), key=len)

    by = {}
    for i in range(len(chars)):
        by.setdefault(int(group[i]), set()).add(lyndon(i))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def slow(rows, length=50):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for i, text in order:
        data = (text or "").encode()
        key = 2**70 if i is None else i
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if first.setdefault(data[k : k + length], key) < key:
                gone[k : k + length] = True
        edge = np.diff(gone.astype(int), prepend=0, append=0)
        out.append((i, len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(suffix_dedup.op10_repeats(spark, small)) == slow(rows)


def passages():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 8)).tolist()).decode() for _ in range(60)]
    say = lambda n: " ".join(words[k] for k in rng.integers(0, 60, n))
    shared = [say(n) for n in (8, 12, 30, 80)] + ["ä" * 40, "ab" * 60, "a" * 49, "a" * 50, "a" * 51]
    rows = []
    for i in range(120):
        parts = [say(int(rng.integers(0, 30)))]
        for _ in range(rng.integers(0, 4)):
            parts += [shared[rng.integers(0, len(shared))], say(int(rng.integers(0, 6)))]
        rows.append((int(rng.integers(0, 100)), " ".join(parts)))
    return rows + [(None, shared[3]), (None, shared[3]), (500, shared[3]), (501, shared[3][1:]), (502, None), (503, ""), (3, rows[5][1]), (3, rows[5][1])]


@pytest.mark.parametrize("spec", [Repeats(), Repeats(stretches=1), Repeats(stretches=4, batch_mb=0.001), Repeats(gram=13), Repeats(gram=24), Repeats(gram=40, stretches=2), Repeats(cut_mb=0.001, pack_mb=0.001, task_rows=7)])
def test_shared_passages(spark, spec):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(repeated_text(docs, spec)) == slow(rows)


def test_spans_cover_what_is_removed(spark):
    docs = spark.createDataFrame([(1, "k" * 10 + "0123456789" * 6), (2, "xyz" + "0123456789" * 6 + "end")], "doc_id long, text string")
    got = {r["doc_id"]: (r["starts"], r["ends"]) for r in repeated_text(docs).collect()}
    assert got == {1: ([], []), 2: ([3], [63])}


def test_many_equal_rows(spark):
    text = "one text that stands in the table many times over, and that no other row has"
    rows = [(7, text)] * 500 + [(None, text)] * 300 + [(1, "x")]
    assert found(repeated_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), Repeats(task_rows=16))) == slow(rows)


def test_odd_rows(odd, clashing, nothing, odd_rows):
    expected = slow([(r[0], r[1]) for r in odd_rows])
    assert found(repeated_text(odd)) == expected and found(repeated_text(clashing)) == expected
    assert repeated_text(nothing).count() == 0


def test_stretches_of_a_common_anchor_are_not_asked_for_by_chance():
    rng, spec, spare = np.random.default_rng(2), Repeats(), np.zeros(64, np.uint8)
    noise = lambda n: rng.integers(0, 256, n, np.uint8)
    some = np.concatenate([noise(50_000), spare])
    r = suffix_dedup.stretches(some, np.zeros(1, np.int64), np.array([50_000]), spec)
    at = (r["at"] + r["shift"])[np.argmin(r["anchor"] >> np.uint64(32))]
    size = np.full(500, 136)
    data = np.concatenate([*(np.concatenate([noise(60), some[at : at + 16], noise(60)]) for _ in size), spare])
    r = suffix_dedup.stretches(data, np.cumsum(size) - size, size, spec)
    assert np.unique(r["anchor"], return_counts=True)[1].max() > 400  # different stretches of one anchor, which share no string
    r |= {"row": r["doc"], "id": r["doc"], "anchor": r["anchor"] >> np.uint64(32)}
    kind = suffix_dedup.STRETCH
    packed = suffix_dedup._batch([(kind, 0, suffix_dedup._pack(kind, r))])
    met = suffix_dedup._meet(spec, 1)((packed["kind"][0], packed["target"][0]), pa.Table.from_batches([packed])).to_pylist()
    assert sum(len(suffix_dedup._unpack(x["kind"], [x["packed"]])["row"]) for x in met) < 40

def test_work_of_a_task_does_not_grow_with_packets_times_rows(monkeypatch):
    """A task gets a packet of documents from every part of the input; what it knows of them is sorted once, not for each packet."""
    spec, rows = Repeats(), 40
    text = np.frombuffer(bytes(range(200)), np.uint8)
    asked = {"row": np.arange(rows), "id": np.arange(rows), "low": np.zeros(rows), "count": np.full(rows, 3), "shift": np.zeros(rows), "bucket": np.zeros(rows)} | {k: np.zeros(rows, np.uint64) for k in ("anchor", "content", "more")}
    settled = {"row": np.arange(rows), "id": np.arange(rows), "low": np.full(rows, 5), "mask": np.ones(rows)}
    table = lambda packets: pa.Table.from_batches([suffix_dedup._batch(packets)])

    def work(per):
        packets = []
        for a in range(0, rows, per):
            n = min(per, rows - a)
            own = np.arange(a, a + n)
            packets.append((suffix_dedup.DOCS, 0, suffix_dedup._pack(suffix_dedup.DOCS, {"row": own, "id": own, "copies": np.ones(n), "size": np.full(n, 200)}, text.tobytes() * n)))
        sorted_rows, lexsort, argsort = [], np.lexsort, np.argsort
        monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
        monkeypatch.setattr(np, "argsort", lambda x, **more: sorted_rows.append(len(x)) or argsort(x, **more))
        got = suffix_dedup._fetch(spec, 1, 1)((), table(packets), table([(suffix_dedup.ASK, 0, suffix_dedup._pack(suffix_dedup.ASK, asked))]))
        clean = suffix_dedup._clean(spec)((), table(packets), table([(suffix_dedup.SETTLED, 0, suffix_dedup._pack(suffix_dedup.SETTLED, settled))]))
        monkeypatch.undo()
        assert clean.column("n_removed").to_pylist() == [50] * rows and clean.column("starts").to_pylist() == [[5]] * rows
        return got.num_rows, sum(sorted_rows)

    assert work(1) == work(rows) and work(1)[0] == 1


def test_a_part_of_the_input_sends_few_packets(spark):
    """Stretches of several batches go to a task together."""
    rng = np.random.default_rng(5)
    rows = [(i, bytes(rng.integers(97, 123, 300).tolist())) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows], "row": [i for i, _ in rows], "id": [i for i, _ in rows]})
    out = list(suffix_dedup._cut(Repeats(cut_mb=0.001), 4, 4)(iter([batch])))
    assert sum(b.num_rows for b in out) <= 8
