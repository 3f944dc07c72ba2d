"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

All n-grams of a test item are its seeds: an edited copy may have kept any of them,
the frequent ones included. Where a seed occurs in a passage, the passage around it
is aligned with the item, unless it has too few of the item's words for any
alignment to reach the score. The best local alignment's score, as a share of the
score of a perfect copy, decides, so that edited and paraphrased copies are found
as well as exact ones.

Test items are the bounded side: they are worked through in blocks of at most
``block_words`` words, each block against all documents, whose hits so far are
written out before the next block is read. Nothing is shuffled.

Defined cases: null and empty texts have no hits; items that are null or shorter
than the n-gram have none either; repeated rows are judged alike; equal items
are all reported; an empty table on either side gives no hits. Columns of the
documents are passed on and only the text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, travels, written

travels(__name__)

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Alignment:
    """n: words of a seed. match, mismatch, gap: scores of the alignment. least: share of a
    perfect copy's score from which a passage is a copy, and least_words: words that
    must match at least, all of an item that has fewer. block_words: bound on the
    items' words that are held at once."""

    n: int = 3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    least: float = 0.4
    least_words: int = 6
    block_words: int = 1_000_000


class Items:
    """A block of test items: word ids, and n-grams as numbers in a sorted array."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        words = [WORD.findall(t.lower()) for _, t in rows]
        kept = [(i, w) for (i, _), w in zip(rows, words, strict=True) if len(w) >= n]
        self.ids = [i for i, _ in kept]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in kept for w in ws))}
        self.base = len(self.vocabulary) + 1
        if self.base**n >= 2**62:
            raise ValueError("block_words is too large for n")
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in kept]
        grams = [self.grams(w) for w in self.words]
        self.codes = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        self.places = [np.searchsorted(self.codes, g) for g in grams]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(ids) - self.n + 1), np.int64)
        for k in range(self.n):
            out = out * self.base + ids[k : k + len(out)]
        return out

    def word_ids(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))

    def shared(self, k: int, ids: np.ndarray) -> int:
        """Words that item k and ``ids`` have in common, repeated ones as often as in both: no alignment matches more."""
        words, often = self.bags[k]
        i = np.minimum(np.searchsorted(words, ids), len(words) - 1)
        return int(np.minimum(np.bincount(i[words[i] == ids], minlength=len(words)), often).sum())

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, n-gram) wherever an n-gram of the items stands in ``ids``."""
        places = max(0, len(ids) - self.n + 1)
        known = ids >= 0
        ok = np.ones(places, bool)
        for k in range(self.n):
            ok &= known[k : k + places]
        at = np.flatnonzero(ok)
        if not len(at):
            return at, at
        code = np.zeros(len(at), np.int64)
        for k in range(self.n):
            code = code * self.base + ids[at + k]
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[i] == code
        return at[hit], i[hit]


def item_blocks(items: DataFrame, item_id: str, text: str, spec: Alignment) -> Iterator[Items]:
    """The items in blocks; ties of item_id are ordered by text."""
    held, words = [], 0
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        size = len(WORD.findall(r["t"]))
        if held and words + size > spec.block_words:
            yield Items(held, spec.n)
            held, words = [], 0
        held.append((r["i"], r["t"]))
        words += size
    if held:
        yield Items(held, spec.n)


def all_seeds(items: Items) -> dict[int, list[tuple[int, int]]]:
    """n-gram -> (item, offset), for all n-grams of each item."""
    seeds: dict[int, list[tuple[int, int]]] = {}
    for k, places in enumerate(items.places):
        for offset, gram in enumerate(places.tolist()):
            seeds.setdefault(gram, []).append((k, offset))
    return seeds


def smith_waterman(item: np.ndarray, words: np.ndarray, spec: Alignment) -> tuple[int, int]:
    """Best local score and the place behind its end in ``words``. A row at a time:
    gaps along the row are a running maximum."""
    steps = np.arange(len(words) + 1) * -spec.gap
    above, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for w in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(words == w, spec.match, spec.mismatch), above[1:] + spec.gap)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def align(items: Items, seeds: dict, ids: np.ndarray, spec: Alignment) -> list[tuple[int, float, int, int, int]]:
    """(item_id, share, first word, word behind the last, seeds) of the best passage of every item that has one."""
    at, gram = items.found(ids)
    around: dict[int, list[int]] = {}
    for p, g in zip(at.tolist(), gram.tolist(), strict=True):
        for k, offset in seeds.get(g, ()):
            around.setdefault(k, []).append(p - offset)
    out = []
    for k, starts in around.items():
        item = items.words[k]
        slack = max(8, len(item) // 2)
        least = max(spec.least, min(1.0, spec.least_words / len(item)))
        starts.sort()
        best = (0.0, 0, 0)
        low = starts[0]
        for s, after in zip(starts, [*starts[1:], None], strict=True):
            if after is not None and after - s <= len(item) + 2 * slack:
                continue
            left, right = max(0, low - slack), min(len(ids), s + len(item) + slack)
            low = after
            if spec.match * items.shared(k, ids[left:right]) / (spec.match * len(item)) < least:
                continue
            score, end = smith_waterman(item, ids[left:right], spec)
            share = score / (spec.match * len(item))
            if share >= least and share > best[0]:
                _, back = smith_waterman(item[::-1], ids[left : left + end][::-1], spec)
                best = (share, left + end - back, left + end)
        if best[0]:
            out.append((items.ids[k], *best, len(starts)))
    return sorted(out, key=lambda x: (x[0] is None, x[0], x[1:]))


HIT = "array<struct<item_id: bigint, score: double, first_word: bigint, end_word: bigint, seeds: bigint>>"


def with_hits(docs: DataFrame, benchmark: DataFrame, spec: Alignment | None = None, text: str = "text", out: str = "hits", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the test items of which each text holds a copy: an array of
    item_id, score (share of a perfect copy's), span in words, and seeds found."""
    spec = spec or Alignment()
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("seeds", pa.int64())]))
    found, blocks = None, item_blocks(benchmark, item_id, item_text, spec)
    items = next(blocks, None)
    while items is not None:
        seeds = all_seeds(items)

        def hits(batches: Iterator[pa.Array], items=items, seeds=seeds) -> Iterator[pa.Array]:
            names = ("item_id", "score", "first_word", "end_word", "seeds")
            for batch in batches:
                rows = [align(items, seeds, items.word_ids(t), spec) if t else [] for t in batch.to_pylist()]
                yield pa.array([[dict(zip(names, h, strict=True)) for h in r] for r in rows], kind)

        own = F.arrow_udf(_one_argument(hits), HIT)(F.col(text))
        docs = docs.withColumn(out, own if found is None else F.concat(found, own))
        found, items = F.col(out), next(blocks, None)
        if items is not None:  # so that no one holds more than a block
            docs = written(docs, "hits")
    return docs if found is not None else docs.withColumn(out, F.array().cast(HIT))


def _one_argument(f):
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return f(batches)

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return scored


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds a copy of."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, read_table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.score", "h.first_word", "h.end_word", "h.seeds")
