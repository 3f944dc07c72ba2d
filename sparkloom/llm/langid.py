"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length; filters of several widths slide
over a window's bytes, the maximum over the window is taken of each filter, and
a softmax layer gives probabilities. A text's probabilities are the mean over
all of its windows, weighted by their bytes. The network is trained in numpy.

Defined cases: a null text and a text without a letter get ``und`` and score 0;
with nothing to learn from, every text does; a very long text is worked through
in blocks of windows; columns of the input are passed on and only the text is
read, so that neither nulls nor clashing names in other columns matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, travels

travels(__name__)

UNKNOWN = "und"


@dataclass(frozen=True)
class Network:
    """window: bytes of a window. widths and filters: filters of each width.
    per_label and per_text bound the sample that is learned from: rows for each
    label, and windows for each row, both spread by hashes. epochs, rate: of Adam."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    per_label: int = 768
    per_text: int = 4
    epochs: int = 4
    rate: float = 0.004
    seed: int = 7


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    tables: dict  # width -> array (width, 256, filters): what each byte adds at each place
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray
    window: int


def _responses(tables: dict, x: np.ndarray) -> list[np.ndarray]:
    """For each width, the responses (windows, places, filters); all widths share the places."""
    reach = max(tables)
    n = x.shape[1] - reach + 1
    return [sum(t[k][x[:, k : k + n]] for k in range(w)) for w, t in tables.items()]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, targets: np.ndarray, labels: tuple[str, ...], net: Network) -> Model:
    """Adam on the cross-entropy; through the maximum only its place gets a gradient."""
    rng = np.random.default_rng(net.seed)
    tables = {w: rng.normal(0, 0.1, (w, 256, net.filters)).astype(np.float32) for w in net.widths}
    size = net.filters * len(net.widths)
    bias, shift = np.zeros(size, np.float32), np.zeros(len(labels), np.float32)
    dense = rng.normal(0, 0.3, (size, len(labels))).astype(np.float32)
    params = [*tables.values(), bias, dense, shift]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(net.epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            x, y = windows[order[at : at + 64]], targets[order[at : at + 64]]
            found = [(r.argmax(axis=1), r.max(axis=1)) for r in _responses(tables, x)]
            pooled = np.concatenate([b for _, b in found], axis=1) + bias
            hidden = np.maximum(pooled, 0)
            delta = _softmax(hidden @ dense + shift)
            delta[np.arange(len(y)), y] -= 1
            delta /= len(y)
            back = (delta @ dense.T) * (pooled > 0)
            grads = []
            rows, cols = np.arange(len(y))[:, None], np.arange(net.filters)[None, :]
            for i, (w, t) in enumerate(tables.items()):
                g, own = np.zeros_like(t), back[:, i * net.filters : (i + 1) * net.filters]
                for k in range(w):
                    np.add.at(g[k], (x[rows, found[i][0] + k], cols), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= net.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(labels, tables, bias, dense, shift, net.window)


class Scorer:
    """Applies a model with tables of byte pairs, so that a place costs few look-ups."""

    def __init__(self, model: Model):
        self.model, self.widths = model, list(model.tables)
        f = next(iter(model.tables.values())).shape[2]
        first, self.rest = [], []
        for i, (w, t) in enumerate(model.tables.items()):
            first.append(self._pairs(t, 0, w))
            self.rest += [(k, slice(i * f, (i + 1) * f), self._pairs(t, k, w) if k + 1 < w else np.ascontiguousarray(t[k]), k + 1 < w) for k in range(2, w, 2)]
        self.first = np.ascontiguousarray(np.concatenate(first, axis=1))

    @staticmethod
    def _pairs(t: np.ndarray, k: int, w: int) -> np.ndarray:
        second = t[k + 1] if k + 1 < w else np.zeros_like(t[k])
        return np.ascontiguousarray((t[k][:, None, :] + second[None, :, :]).reshape(65536, -1))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of windows (n, window), in blocks that stay in the cache."""
        model, n = self.model, x.shape[1] - max(self.widths) + 1
        out = np.empty((len(x), len(model.labels)), np.float32)
        for at in range(0, len(x), 32):
            part = x[at : at + 32]
            pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            r = self.first[pairs[:, :n]]
            for k, span, table, double in self.rest:
                r[:, :, span] += table[(pairs if double else part)[:, k : k + n]]
            hidden = np.maximum(r.max(axis=1) + model.bias, 0)
            out[at : at + 32] = _softmax(hidden @ model.dense + model.shift)
        return out

    def texts(self, texts: list[bytes], block: int = 1 << 14) -> np.ndarray:
        """Mean probabilities of each text; at most ``block`` windows are held at a time."""
        w, out = self.model.window, np.zeros((len(texts), len(self.model.labels)))
        held: list[tuple[int, bytes]] = []
        count = 0

        def flush() -> None:
            nonlocal held, count
            if not held:
                return
            own = np.array([-(-len(b) // w) for _, b in held])
            x = np.zeros(own.sum() * w, np.uint8)
            start = np.concatenate([[0], np.cumsum(own)])
            for (_, b), s in zip(held, start, strict=False):
                x[s * w : s * w + len(b)] = np.frombuffer(b, np.uint8)
            p = self.windows(x.reshape(-1, w)).astype(np.float64)
            weight = np.full(len(p), w, np.float64)
            weight[start[1:] - 1] = [len(b) - (k - 1) * w for (_, b), k in zip(held, own, strict=True)]
            np.add.at(out, np.repeat([i for i, _ in held], own), p * weight[:, None])
            held, count = [], 0

        for i, text in enumerate(texts):
            for at in range(0, len(text), block * w):
                piece = text[at : at + block * w]
                held.append((i, piece))
                count += -(-len(piece) // w)
                if count >= block:
                    flush()
        flush()
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(text: bytes) -> bool:
    """Whether a character is a letter; signs that stand for numbers alone, as in "½ Ⅷ ①", aren't."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(c.group().isalpha() for c in _LETTER.finditer(text.decode("utf-8", "replace")))


def _as_bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_binary()).to_pylist()


def sample_windows(docs: DataFrame, net: Network, text: str, label: str, key: str) -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """A bounded sample of (windows, targets, labels): per_label rows of each label
    (from 64 strata of a hash of key and text, so that no label is a hot key) and per_text
    windows of each, cut to various lengths as the last window of a text is. Rows equal
    in key, label and text count once; a null key is a key like any other."""
    from pyspark.sql import Window

    row = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("sample")).alias("k")
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(row, F.col(label).cast("string").alias("y"), F.col(text).alias("t"))
    order = Window.partitionBy("y", F.pmod("k", F.lit(64))).orderBy("k")
    picked = rows.select("k", "y").withColumn("r", F.row_number().over(order)).where(F.col("r") <= -(-net.per_label // 64)).select("k", "y").distinct()
    rows = rows.join(F.broadcast(picked), ["k", "y"]).dropDuplicates(["k", "y"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, ys, ws = [], [], []
            for k, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _as_bytes(batch.column(2)), strict=True):
                rng = np.random.default_rng([net.seed, k % 2**64])
                for j in range(net.per_text if t and _has_letter(t) else 0):
                    size = net.window if j % 2 else int(rng.integers(16, net.window + 1))
                    at = int(rng.integers(0, max(1, len(t) - size + 1)))
                    ks.append(f"{k}/{j}")
                    ys.append(y)
                    ws.append(t[at : at + size])
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ys, pa.string()), pa.array(ws, pa.binary())], names=["k", "y", "w"])

    got = rows.select("k", "y", "t").mapInArrow(cut, "k string, y string, w binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["k"], r["y"], r["w"]))
    labels = tuple(sorted({r["y"] for r in got}))
    x = np.zeros((len(got), net.window), np.uint8)
    for i, r in enumerate(got):
        x[i, : len(r["w"])] = np.frombuffer(r["w"], np.uint8)
    index = {y: i for i, y in enumerate(labels)}
    return x, np.array([index[r["y"]] for r in got], int), labels


def fit(docs: DataFrame, net: Network | None = None, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model | None:
    net = net or Network()
    x, y, labels = sample_windows(docs, net, text, label, key)
    return train(x, y, labels, net) if labels else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of every whole text and its probability."""
    if model is None:
        return docs.withColumn(label, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    kind = pa.struct([("lang", pa.string()), ("p", pa.float64())])

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            texts = _as_bytes(batch)
            known = [i for i, t in enumerate(texts) if t and _has_letter(t)]
            langs, ps = [UNKNOWN] * len(texts), [0.0] * len(texts)
            p = scorer.texts([texts[i] for i in known])
            for i, row in zip(known, p, strict=True):
                best = int(row.argmax())
                langs[i], ps[i] = model.labels[best], min(1.0, float(row[best]))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(ps, pa.float64())], fields=list(kind))

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(scored, "lang string, p double").asNondeterministic()  # else the optimizer scores again for each of the two columns
    out = docs.withColumn("_lid", udf(F.col(text)))
    return out.withColumn(label, F.col("_lid.lang")).withColumn(score, F.col("_lid.p")).drop("_lid")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
