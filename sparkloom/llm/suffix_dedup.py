"""Remove text that an earlier document has: every byte in a string of ``length``
bytes that also starts in a document with a smaller id, strings judged on the input.

A suffix array over all text isn't dealt out by documents but by content. Each
string of ``length`` bytes has an anchor, the ``gram`` bytes within it whose hash
is smallest: equal strings have equal anchors at equal places. Strings with one
anchor stand next to each other in a document and make up one stretch of it.

1. ``cut``: documents are cut into stretches. Equal stretches that meet in one
   task leave only the smallest document's; the others are settled.
2. ``meet``: stretches, as hashes, are dealt out by anchor. Equal stretches of
   several documents are settled (equal in bucket, 32 more bits of the anchor's
   hash and 64 of the content's). Where an anchor has different stretches, two can
   share a string only if they agree on the bytes before the anchor or on those
   after it, half a string's rest on one side; of both sides each record holds 16 bits.
   Stretches that agree with another document's are asked for, all of an anchor
   together, or, where that is more than a suffix array is to hold, those of one
   side. Only what is still larger is asked for string by string.
3. ``fetch``: documents give the bytes asked for, dealt out by anchor.
4. ``sort``: stretches of one anchor become a text whose suffix array (linear
   grouping construction, all anchors of a batch in lock step) brings equal
   strings together; strings that a smaller document has are settled.
5. ``clean``: documents remove what has been settled.

Steps 3 and 5 share one shuffle of the texts, which move compressed, to tasks of
about ``task_mb`` and ``task_rows``; rows equal in id and text move once from each
task, with their number. Nothing is capped: what exceeds a limit takes the other,
exact way. A row is known by its id and 64 bits of its text's hash.

Defined cases: a null or empty text has no bytes and loses none; a text shorter
than ``length`` loses none; documents with equal ids, repeated rows included, are
no reason to remove from each other; a null id is larger than all others; an
empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, travels, written
from sparkloom.llm.suffix_groups import suffix_arrays

travels(__name__)

LAST = 2**63 - 1
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SETTLED, STRETCH, ASK, ASK_EACH, TEXT, SINGLE, DOCS = range(7)
PACKET = "kind int, target int, packed binary"


@dataclass(frozen=True)
class Repeats:
    """length: of the strings, in bytes. gram: bytes of an anchor. task_mb, task_rows: text and
    documents that a task takes at a time; cut_mb: text that is cut into stretches at a time, pack_mb: that is
    compressed at a time. anchor_mb: text whose stretches make up one bucket of anchors.
    stretches: of one anchor, up to which they are sorted together. batch_mb: text
    that is sorted in lock step. deal_mb: what is held before it is packed for the tasks it goes to."""

    length: int = 50
    gram: int = 16
    task_mb: int = 12
    task_rows: int = 1024
    pack_mb: float = 24.0
    cut_mb: float = 2.0
    anchor_mb: int = 32
    stretches: int = 64
    batch_mb: float = 1.5
    deal_mb: int = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that changes every bit of the result with about half of all inputs' bits."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; data has 8 bytes to spare."""
    return np.ndarray((len(data) - 8,), np.uint64, data.data, strides=(1,)).copy()


_KEPT_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd number and of its inverse, modulo 2 ** 64; kept up to a bound."""
    if _KEPT_POWERS and len(_KEPT_POWERS[0]) >= n:
        return _KEPT_POWERS[0][:n], _KEPT_POWERS[1][:n]
    out = []
    for base in (0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n <= 1 << 23:
        _KEPT_POWERS[:] = out
    return out[0], out[1]


def _sides(spec: Repeats, count: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a stretch has strings that reach half the rest of a string before the anchor, and ones that reach more than half behind it.

    Each string does one or the other: the rest is what an anchor leaves of it.
    """
    span = spec.length - spec.gram
    return shift.astype(np.int64) >= span // 2, shift.astype(np.int64) - count.astype(np.int64) + 1 < span // 2


def _context(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """16 bits of a hash of the ``width`` bytes from each place on."""
    words, out = _words(data), np.zeros(len(at), np.uint64)
    if width < 8:
        out = _mixed(words[at] & np.uint64((1 << 8 * width) - 1))
    for k in [*range(0, width - 8, 8), width - 8] if width >= 8 else ():
        out = _mixed(out * M3 + words[at + k])
    return (out >> np.uint64(48)).astype(np.uint16)


def stretches(data: np.ndarray, start: np.ndarray, size: np.ndarray, spec: Repeats) -> dict[str, np.ndarray]:
    """The stretches of documents that lie one after another in ``data``: doc, low
    (first string's place in the document), count (strings), shift (the anchor's place
    in the first string), anchor, content and more (hashes), and at (low's place in data). Of either side's 16 bits
    content ends with the upper 8, and more holds the lower 8.

    ``data`` has 64 bytes to spare at its end.
    """
    n, span = int(start[-1] + size[-1]) if len(start) else 0, spec.length - spec.gram
    whole = np.flatnonzero(size >= spec.length)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "low", "count", "shift", "at")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "content")} | {"more": np.zeros(0, np.uint16)}
    if not len(whole):
        return empty
    parts = _mixed(_words(data) * M1 + M2)
    hashes = parts[: n + 1].copy()
    for k in range(8, spec.gram - 7, 8):
        hashes = _mixed(hashes * M3 + parts[k : k + n + 1])
    if spec.gram % 8:
        hashes = _mixed(hashes * M3 + parts[spec.gram - 8 : spec.gram - 8 + n + 1])
    value, off, width = (hashes >> np.uint64(32)).astype(np.uint32), np.zeros(n + 1, np.uint8), 1
    while width < span + 1:  # minima over twice the width, the leftmost among equals
        by = min(width, span + 1 - width)
        left, right = value[:-by], value[by:]
        later = right < left
        off = np.where(later, off[by:] + np.uint8(by), off[:-by])
        value, width = np.minimum(left, right), width + by
    valid = np.zeros(n + 1, np.int8)
    valid[start[whole]] += 1
    valid[start[whole] + size[whole] - spec.length + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:n], dtype=np.int8))
    place = at + off[at]
    doc = np.repeat(whole, size[whole] - spec.length + 1)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    low, doc, place = at[first], doc[first], place[first]
    powers, back = _powers(n + 1)
    sums = np.zeros(n + 2, np.uint64)
    np.cumsum(parts[: n + 1] * powers, out=sums[1:])
    end = low + count + spec.length - 8  # places of 8 bytes that lie within the stretch
    content = (sums[end] - sums[low]) * back[low]
    shift = place - low
    content = _mixed(content ^ (count.astype(np.uint64) << np.uint64(40)) ^ (shift.astype(np.uint64) << np.uint64(8)))
    before, after = _sides(spec, count, shift)
    half, rest = span // 2, span - span // 2 + 1
    left, right = _context(data, np.where(before, place - half, 0), half), _context(data, place + spec.gram, rest)
    left, right = np.where(before, left, 0).astype(np.uint16), np.where(after, right, 0).astype(np.uint16)
    content = (content & ~np.uint64(0xFFFF)) | (left >> 8).astype(np.uint64) | (right & 0xFF00).astype(np.uint64)
    return {"doc": doc, "low": low - start[doc], "count": count, "shift": shift, "anchor": hashes[place], "content": content, "more": (left & 0xFF) | (right << 8), "at": low}


#: An anchor is its bucket, which a packet is sent to, and 32 more bits; in what is asked of documents the bucket goes along.
RECORD = [("anchor", "<u4"), ("content", "<u8"), ("more", "<u2"), ("row", "<i8"), ("id", "<i8"), ("low", "<u4"), ("count", "u1"), ("shift", "u1")]
ASKED = [*RECORD, ("bucket", "<i4")]
DOCUMENT = [("row", "<i8"), ("id", "<i8"), ("copies", "<i8"), ("size", "<i8")]
PLACES = {DOCS: DOCUMENT, SETTLED: [("row", "<i8"), ("id", "<i8"), ("low", "<u4"), ("mask", "<u8")], STRETCH: RECORD, ASK: ASKED, ASK_EACH: ASKED, SINGLE: [("key", "<u8"), ("key2", "<u8"), ("row", "<i8"), ("id", "<i8"), ("low", "<u4")]}


def _pack(kind: int, columns: dict[str, np.ndarray], more: bytes = b"") -> bytes:
    """Columns one after another, in each the first bytes of all numbers, then the second ones: these compress better than rows do."""
    n = len(next(iter(columns.values())))
    planes = (np.ascontiguousarray(columns[name].astype(t)).view(np.uint8).reshape(n, -1).T.tobytes() for name, t in PLACES[kind])
    return zstandard.ZstdCompressor(1).compress(np.int64(n).tobytes() + b"".join(planes) + more)


def _unpack(kind: int, packets: list[bytes], more: list | None = None) -> dict[str, np.ndarray]:
    """The columns of all packets together; ``more`` gets what follows them in each."""
    pieces: dict[str, list[np.ndarray]] = {name: [] for name, _ in PLACES[kind]}
    for packet in packets:
        packet = zstandard.ZstdDecompressor().decompress(packet)
        n, at = int(np.frombuffer(packet, np.int64, 1)[0]), 8
        for name, t in PLACES[kind]:
            width = np.dtype(t).itemsize
            pieces[name].append(np.ascontiguousarray(np.frombuffer(packet, np.uint8, n * width, at).reshape(width, n).T).view(t).reshape(n))
            at += n * width
        if more is not None:
            more.append(np.frombuffer(packet, np.uint8, offset=at))
    return {name: np.concatenate(p) if p else np.zeros(0, t) for (name, t), p in zip(PLACES[kind], pieces.values(), strict=True)}


def _dealt(kind: int, target: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    edges = np.flatnonzero(np.diff(target[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        some = order[a:b]
        yield kind, int(target[some[0]]), _pack(kind, {k: v[some] for k, v in columns.items()})


def _batch(packets: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, targets, packed = zip(*packets, strict=True) if packets else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(targets, pa.int32()), pa.array(packed, pa.binary())], names=["kind", "target", "packed"])


def _part(r: dict[str, np.ndarray], some: np.ndarray | slice, parts: int) -> np.ndarray:
    """The tasks that rows belong to."""
    row, own = r["row"][some].astype(np.int64).view(np.uint64), r["id"][some].astype(np.int64).view(np.uint64)
    return (_mixed(row ^ _mixed(own * M1 + M2)) % np.uint64(parts)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _all(count: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)


def _settle(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): records by anchor and content, and whether a smaller id has the content, in that order."""
    order = np.lexsort((r["content"], r["anchor"]))
    start = _runs(r["anchor"][order], r["content"][order])
    ids = r["id"][order]
    least = np.minimum.reduceat(ids, start) if len(ids) else ids
    return order, ids > np.repeat(least, np.diff(np.append(start, len(order))))


def _dealt_back(r: dict[str, np.ndarray], some: np.ndarray, low: np.ndarray, mask: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    yield from _dealt(SETTLED, _part(r, some, parts), {"row": r["row"][some], "id": r["id"][some], "low": low, "mask": mask})


def _settled(r: dict[str, np.ndarray], some: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    if len(some):
        yield from _dealt_back(r, some, r["low"][some], _all(r["count"][some]), parts)


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(data, documents) of up to ``most`` bytes of documents at a time, a longer document alone; those equal in id and text once, with their number."""
    held: dict[tuple[int, int], list] = {}
    total = 0

    def joined():
        data = np.frombuffer(b"".join(t for t, _ in held.values()) + bytes(64), np.uint8)
        size = np.array([len(t) for t, _ in held.values()], np.int64)
        row, own = (np.array([key[k] for key in held], np.int64) for k in range(2))
        return data, {"row": row, "id": own, "copies": np.array([n for _, n in held.values()], np.int64), "size": size, "start": np.cumsum(size) - size}

    for batch in batches:
        texts, rows, ids = (batch.column(k) for k in ("text", "row", "id"))
        for t, r, i in zip(texts, rows.to_pylist(), ids.to_pylist(), strict=True):
            if (r, i) in held:
                held[r, i][1] += 1
                continue
            text = t.as_py() or b""
            if held and total + len(text) > most:
                yield joined()
                held, total = {}, 0
            held[r, i] = [text, 1]
            total += len(text)
    if held:
        yield joined()


def _packed(spec: Repeats, parts: int):
    """Documents in packets for the tasks they belong to."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, d in _texts(batches, int(spec.pack_mb * (1 << 20))):
            target = _part(d, slice(None), parts)
            order = np.argsort(target, kind="stable")
            edges = np.flatnonzero(np.diff(target[order], prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                some = order[a:b]
                text = b"".join(data[x : x + n].tobytes() for x, n in zip(d["start"][some], d["size"][some], strict=True))
                yield _batch([(DOCS, int(target[some[0]]), _pack(DOCS, {k: d[k][some] for k, _ in DOCUMENT}, text))])

    return packed


def _heads(packets: list[bytes]) -> list[dict[str, np.ndarray]]:
    """The documents of each packet, without their texts, which stay compressed."""
    out, width = [], sum(np.dtype(t).itemsize for _, t in DOCUMENT)
    for packet in packets:
        with zstandard.ZstdDecompressor().stream_reader(packet) as stream:
            n = int(np.frombuffer(stream.read(8), np.int64)[0])
            planes, at, d = np.frombuffer(stream.read(n * width), np.uint8), 0, {}
        for name, t in DOCUMENT:
            size = np.dtype(t).itemsize
            d[name] = np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(t).reshape(n)
            at += n * size
        d["start"] = np.cumsum(d["size"]) - d["size"]
        out.append(d)
    return out


def _data(packet: bytes) -> np.ndarray:
    """The texts of a packet's documents, with 64 bytes to spare."""
    more: list[np.ndarray] = []
    _unpack(DOCS, [packet], more)
    return np.concatenate([more[0], np.zeros(64, np.uint8)])


def _known(heads: list[dict[str, np.ndarray]], *rows: dict[str, np.ndarray]) -> list[np.ndarray]:
    """A number for each document of ``heads``, then for each of ``rows``, the same where id and hash are.

    All are sorted once: a task has a packet from every part of the input, so that work for each packet
    on all that a task knows would grow with the square of the input.
    """
    parts = [np.concatenate([d[k] for d in heads]) if heads else np.zeros(0, np.int64) for k in ("row", "id")]
    row, own = (np.concatenate([p, *(r[k] for r in rows)]) for p, k in zip(parts, ("row", "id"), strict=True))
    order = np.lexsort((own, row))
    start = _runs(row[order], own[order])
    which = np.empty(len(row), np.int64)
    which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row))))
    return np.split(which, np.cumsum([len(parts[0]), *(len(r["row"]) for r in rows)])[:-1])


def _sorted_by(which: np.ndarray, r: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    order = np.argsort(which, kind="stable")
    return which[order], {k: v[order] for k, v in r.items()}


def _cut(spec: Repeats, buckets: int, parts: int):
    def dealt(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        r = {k: np.concatenate([h[k] for h in held]) for k, _ in RECORD}
        held.clear()
        order, later = _settle(r)
        packets = list(_settled(r, np.sort(order[later]), parts))
        keep = np.sort(order[~later])  # in the documents' order, in which ids and hashes compress
        r = {k: v[keep] for k, v in r.items()}
        target = (r["anchor"] % np.uint64(buckets)).astype(np.int64)
        r["anchor"] = r["anchor"] >> np.uint64(32)
        return _batch([*packets, *_dealt(STRETCH, target, r)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for data, d in _texts(batches, int(spec.cut_mb * (1 << 20))):
            r = stretches(data, d["start"], d["size"], spec)
            r["row"], r["id"] = d["row"][r["doc"]], d["id"][r["doc"]]
            if len(r["doc"]):
                held.append({k: r[k].astype(t if k != "anchor" else np.uint64) for k, t in RECORD})
                size += sum(v.nbytes for v in held[-1].values())
            if size > spec.deal_mb << 20:
                yield dealt(held)
                size = 0
        if held:
            yield dealt(held)

    return cut


def _packets(table: pa.Table) -> list[bytes]:
    return [x.as_py() for x in table.column("packed")]


def _meet(spec: Repeats, parts: int):
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        kind, target = key[0].as_py(), key[1].as_py()
        if kind == SETTLED:
            return table.select(["kind", "target", "packed"])
        r = _unpack(kind, _packets(table))
        r["bucket"] = np.full(len(r["row"]), target)
        order, later = _settle(r)
        out = list(_settled(r, np.sort(order[later]), parts))
        # What is left of each content stands in the smallest document; one of its places is asked for, and all of them if there are several.
        r = {k: v[order[~later]] for k, v in r.items()}
        part = lambda name, k: (r[name].astype(np.uint64) >> np.uint64(8 * k)) & np.uint64(0xFF)
        sides = [(has, part("content", k) << np.uint64(8) | part("more", k)) for k, has in enumerate(_sides(spec, r["count"], r["shift"]))]
        agree = [_agree(r, np.flatnonzero(has), bits) for has, bits in sides]
        asked = np.flatnonzero(agree[0] | agree[1])
        large = np.zeros(len(r["row"]), bool)
        large[asked] = _numbers(r["anchor"][asked]) > spec.stretches
        some, each = asked[~large[asked]], np.zeros(len(large), bool)
        out += _dealt(ASK, _part(r, some, parts), {k: r[k][some] for k, _ in ASKED})
        for k, (_, bits) in enumerate(sides):
            some = np.flatnonzero(agree[k] & large)
            lane = (_mixed((r["anchor"][some].astype(np.uint64) << np.uint64(17)) + (bits[some] << np.uint64(1)) + np.uint64(k)) >> np.uint64(32)).astype(np.uint32)
            few = _numbers(lane) <= spec.stretches
            each[some[~few]] = True
            some = some[few]
            out += _dealt(ASK, _part(r, some, parts), {k: r[k][some] for k, _ in ASKED} | {"anchor": lane[few]})
        some = np.flatnonzero(each)
        out += _dealt(ASK_EACH, _part(r, some, parts), {k: r[k][some] for k, _ in ASKED})
        return pa.Table.from_batches([_batch(out)])

    return meet


def _numbers(*keys: np.ndarray) -> np.ndarray:
    """How many have the same keys, for each."""
    order = np.lexsort(keys[::-1])
    start = _runs(*(k[order] for k in keys))
    size = np.diff(np.append(start, len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(size, size)
    return out


def _agree(r: dict[str, np.ndarray], some: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of ``some`` have another content and id beside them that agree in anchor and bits."""
    out = np.zeros(len(r["row"]), bool)
    if len(some):
        order = some[np.lexsort((bits[some], r["anchor"][some]))]
        start = _runs(r["anchor"][order], bits[order])
        differ = np.ones(len(start), bool)
        for k in ("id", "content"):
            differ &= np.minimum.reduceat(r[k][order], start) != np.maximum.reduceat(r[k][order], start)
        out[order] = np.repeat(differ, np.diff(np.append(start, len(order))))
    return out


def _fetch(spec: Repeats, buckets: int, parts: int):
    def fetch(key: tuple, docs: pa.Table, asked: pa.Table) -> pa.Table:
        kinds, packets = asked.column("kind").to_pylist(), _packets(asked)
        out: list[tuple[int, int, bytes]] = []
        wanted = {way: _unpack(way, [p for k, p in zip(kinds, packets, strict=True) if k == way]) for way in (ASK, ASK_EACH)}
        if not sum(len(w["row"]) for w in wanted.values()):
            return pa.Table.from_batches([_batch([])])
        packets = _packets(docs)
        heads = _heads(packets)
        own, *which = _known(heads, *wanted.values())
        wanted = {way: _sorted_by(w, r) for w, (way, r) in zip(which, wanted.items(), strict=True)}
        _, first = np.unique(own, return_index=True)  # of equal rows the first one gives what is asked
        gives = np.zeros(len(own), bool)
        gives[first] = True
        stretch: list[tuple[dict[str, np.ndarray], np.ndarray]] = []
        single: list[dict[str, np.ndarray]] = []

        def deal() -> None:
            """Pack what the documents so far give, one packet for each task that it goes to."""
            if stretch:
                r = {k: np.concatenate([s[k] for s, _ in stretch]) for k, _ in ASKED}
                text = np.concatenate([t for _, t in stretch])
                width = r["count"].astype(np.int64) + spec.length - 1
                begin = np.cumsum(width) - width
                order = np.argsort(r["bucket"], kind="stable")
                edges = np.flatnonzero(np.diff(r["bucket"][order], prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                    some = order[a:b]
                    out.append((TEXT, int(r["bucket"][some[0]]), _pack(STRETCH, {k: v[some] for k, v in r.items()}, text[_ranges(begin[some], width[some])].tobytes())))
            if single:
                r = {k: np.concatenate([s[k] for s in single]) for k, _ in PLACES[SINGLE]}
                later, keep = _single(r)
                out.extend(_dealt_back(r, later, r["low"][later], np.ones(len(later), np.uint64), parts))
                out.extend(_dealt(SINGLE, (r["key"][keep] % np.uint64(buckets)).astype(np.int64), {k: v[keep] for k, v in r.items()}))
            stretch.clear()
            single.clear()

        held = done = 0
        for packet, d in zip(packets, heads, strict=True):
            mine, give = own[done : done + len(d["row"])], gives[done : done + len(d["row"])]
            done += len(mine)
            asks = {}
            for way, (which, _) in wanted.items():
                a, b = np.searchsorted(which, mine), np.where(give, np.searchsorted(which, mine, side="right"), 0)
                n = np.maximum(b - a, 0)
                asks[way] = _ranges(a, n), np.repeat(d["start"], n)
            if not sum(len(ok) for ok, _ in asks.values()):
                continue
            data = _data(packet)
            ok, start = asks[ASK]
            if len(ok):
                r = {k: wanted[ASK][1][k][ok] for k, _ in ASKED}
                text = data[_ranges(start + r["low"], r["count"].astype(np.int64) + spec.length - 1)]
                stretch.append((r, text))
                held += len(text) + 41 * len(ok)
            ok, start = asks[ASK_EACH]
            if len(ok):
                r = {k: wanted[ASK_EACH][1][k][ok] for k, _ in ASKED}
                count = r["count"].astype(np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(start + r["low"], count) + step
                words = _words(data)
                one, two = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
                for k in [*range(0, spec.length - 8, 8), spec.length - 8]:
                    one, two = _mixed(one * M1 + words[place + k]), _mixed(two * M3 + (words[place + k] ^ M2))
                single.append({"key": one, "key2": two, "row": np.repeat(r["row"], count), "id": np.repeat(r["id"], count), "low": np.repeat(r["low"], count) + step})
                held += 40 * len(place)
            if held > spec.deal_mb << 20:
                deal()
                held = 0
        deal()
        return pa.Table.from_batches([_batch(out)])

    return fetch


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each start on, one range after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _single(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Strings that a smaller id among these has, and the rest but for all save one of each id."""
    order = np.lexsort((s["low"], s["row"], s["id"], s["key2"], s["key"]))
    start = _runs(s["key"][order], s["key2"][order])
    lead = np.repeat(order[start], np.diff(np.append(start, len(order))))
    later = s["id"][order] > s["id"][lead]
    return order[later], order[~later]


def sorted_repeats(r: dict[str, np.ndarray], text: np.ndarray, spec: Repeats) -> np.ndarray:
    """For each stretch the mask of its strings that a smaller id's stretch of the same anchor has.

    The stretches of an anchor, each followed by a separator, are one text; in its
    suffix array equal strings are neighbours.
    """
    width = r["count"].astype(np.int64) + spec.length - 1
    begin = np.cumsum(width) - width
    order = np.lexsort((r["low"], r["row"], r["id"], r["anchor"]))
    mask = np.zeros(len(order), np.uint64)
    lanes = _runs(r["anchor"][order])
    long = np.add.reduceat(width[order] + 1, lanes) if len(lanes) else lanes
    sizes = np.diff(np.append(lanes, len(order)))
    by = np.argsort(long, kind="stable")  # texts of like length take like many steps
    order = order[np.repeat(lanes[by] - (np.cumsum(sizes[by]) - sizes[by]), sizes[by]) + np.arange(len(order))]
    lanes = np.cumsum(sizes[by]) - sizes[by]
    edges = np.append(lanes, len(order))
    cost = np.append(0, np.cumsum(long[by]))
    a = 0
    while a < len(lanes):
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + spec.batch_mb * (1 << 20), side="right")) - 1)
        some = order[edges[a] : edges[b]]
        w = width[some]
        base = np.cumsum(w + 1) - (w + 1)
        total = int(base[-1] + w[-1] + 1)
        chars = np.ones(total, np.int16)
        inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        to = np.repeat(base, w) + inside
        chars[to] = text[np.repeat(begin[some], w) + inside].astype(np.int16) + 2
        lane = base[lanes[a:b] - edges[a]]
        size = np.diff(np.append(lane, total))
        chars[lane + size - 1] = 0
        suffixes = suffix_arrays(chars, lane, size)
        owner = np.full(total, -1, np.int64)
        owner[to] = np.where(inside < np.repeat(r["count"][some], w), np.repeat(np.arange(len(some)), w), -1)
        suffixes = suffixes[owner[suffixes] >= 0]
        plain = np.zeros(total + 64, np.uint8)
        plain[:total] = np.where(chars > 1, chars - 2, 0)
        words, which = _words(plain), owner[suffixes]
        new = np.append(True, r["anchor"][some][which[1:]] != r["anchor"][some][which[:-1]])
        for k in [*range(0, spec.length - 8, 8), spec.length - 8]:
            at = words[suffixes + k]
            new[1:] |= at[1:] != at[:-1]
        start = np.flatnonzero(new)
        ids = r["id"][some][which]
        least = np.repeat(np.minimum.reduceat(ids, start), np.diff(np.append(start, len(ids))))
        dup = least < ids
        which, place = which[dup], suffixes[dup] - base[which[dup]]
        np.bitwise_or.at(mask, some[which], np.uint64(1) << place.astype(np.uint64))
        a = b
    return mask


def _sort(spec: Repeats, parts: int):
    def sort(key: tuple, table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        if kind == SETTLED:
            return table.select(["kind", "target", "packed"])
        packets = _packets(table)
        if kind == SINGLE:
            s = _unpack(SINGLE, packets)
            later, _ = _single(s)
            return pa.Table.from_batches([_batch(list(_dealt_back(s, later, s["low"][later], np.ones(len(later), np.uint64), parts)))])
        texts: list[np.ndarray] = []
        r = _unpack(STRETCH, packets, texts)
        mask = sorted_repeats(r, np.concatenate(texts), spec)
        some = np.flatnonzero(mask)
        return pa.Table.from_batches([_batch(list(_dealt_back(r, some, r["low"][some], mask[some], parts)))])

    return sort


def removed_bytes(size: int, low: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a document lie in its settled strings."""
    which, bit = np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
    begun = np.zeros(size + length, np.int32)
    begun[low[which].astype(np.int64) + bit + length] = 1
    np.cumsum(begun, out=begun)
    return begun[length:] > begun[:size]


RESULT = "id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string, copies long"


def _clean(spec: Repeats):
    def clean(key: tuple, docs: pa.Table, settled: pa.Table) -> pa.Table:
        s = _unpack(SETTLED, _packets(settled))
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256", "copies")}
        packets = _packets(docs)
        heads = _heads(packets)
        known, which = _known(heads, s)
        which, s = _sorted_by(which, {k: s[k] for k in ("low", "mask")})
        low, mask, done = s["low"], s["mask"], 0
        for packet, d in zip(packets, heads, strict=True):
            texts, mine = _data(packet), known[done : done + len(d["row"])]
            done += len(mine)
            first, last = (np.searchsorted(which, mine, side=side).tolist() for side in ("left", "right"))
            for a, b, start, size, own, copies in zip(first, last, *(d[x].tolist() for x in ("start", "size", "id", "copies")), strict=True):
                data = texts[start : start + size]
                gone = removed_bytes(size, low[a:b], mask[a:b], spec.length) if b > a else np.zeros(size, bool)
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                out["id"].append(None if own == LAST else own)
                out["n_bytes"].append(size)
                out["n_removed"].append(int(gone.sum()))
                out["starts"].append(np.flatnonzero(edge == 1).tolist())
                out["ends"].append(np.flatnonzero(edge == -1).tolist())
                out["n_spans"].append(len(out["starts"][-1]))
                out["kept_sha256"].append(hashlib.sha256((data[~gone] if b > a else data).tobytes()).hexdigest())
                out["copies"].append(copies)
        long, longs = pa.int64(), pa.list_(pa.int64())
        return pa.table(out, schema=pa.schema([("id", long), ("n_bytes", long), ("n_removed", long), ("n_spans", long), ("starts", longs), ("ends", longs), ("kept_sha256", pa.string()), ("copies", long)]))

    return clean


def repeated_text(docs: DataFrame, spec: Repeats | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, starts, ends, kept_sha256) of every document; removed are the bytes from starts to ends."""
    spec = spec or Repeats()
    if spec.length - spec.gram > 63:
        raise ValueError("a stretch has more strings than its mask has bits")
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    base = base.withColumn("row", F.xxhash64("text"))
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()
    parts, buckets = 1 + max(total // (spec.task_mb << 20), n // spec.task_rows), max(16, 1 + total // (spec.anchor_mb << 20))

    cut = base.mapInArrow(_cut(spec, buckets, parts), PACKET)
    met = written(cut.groupBy("kind", "target").applyInArrow(_meet(spec, parts), PACKET), "repeats-met")
    rows = base.mapInArrow(_packed(spec, parts), PACKET).groupBy("target")  # one shuffle, that both steps read
    asked = met.where(F.col("kind").isin(ASK, ASK_EACH))
    got = rows.cogroup(asked.groupBy("target")).applyInArrow(_fetch(spec, buckets, parts), PACKET)
    sorted_ = got.groupBy("kind", "target").applyInArrow(_sort(spec, parts), PACKET)
    settled = met.where(F.col("kind") == SETTLED).unionByName(sorted_)
    out = rows.cogroup(settled.groupBy("target")).applyInArrow(_clean(spec), RESULT)
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    return out.withColumnRenamed("id", key)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    out = repeated_text(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
