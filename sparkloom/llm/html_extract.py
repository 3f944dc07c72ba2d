"""Main text of web pages by a linear-chain conditional random field.

A page is parsed into its leaf blocks: runs of text between the boundaries of
block elements. Features of a block are the tags, classes, ids and roles of its
ancestors and properties of its text. A chain over the page's blocks, trained
on labelled pages by maximum likelihood, is decoded by Viterbi; blocks that it
labels as content make up the text.

Defined cases: null and empty html give an empty text; html without tags is one
block; unclosed and crossed tags end where HTML's implied ends put them, and a
tag that the page's end cuts off is dropped; text in scripts, styles and other
elements that are never shown is no block; a null page_id or url is passed on;
repeated rows are extracted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read_table, travels

travels(__name__)

#: Fixed values of HTML: elements that begin and end blocks, that have no content, whose content is raw text, and that aren't shown as text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes plaintext script style textarea title".split())
LITERAL = frozenset(("xmp",))  # shown as it stands
HIDDEN = frozenset("annotation annotation-xml button canvas datalist head noscript object optgroup option select svg template".split())
#: Fixed values of HTML: an element in the first place ends an open one of the second, unless one of the third is between.
IMPLIED = {
    "li": ("li", frozenset(("ul", "ol", "menu", "dir"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr", frozenset(("table",))),
    "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",))),
}
P_ENDS = BLOCK - frozenset("body caption dd dt html legend li summary tbody td tfoot th thead tr".split())
P_KEEPS = frozenset("article aside blockquote body button center dd div fieldset figure footer form header html li main nav object section table td th".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")


_KNOWN: dict[tuple[str, str], tuple[str, ...]] = {}


def _own_features(tag: str, attributes: str) -> tuple[str, ...]:
    known = _KNOWN.get((tag, attributes))
    if known is not None:
        return known
    out = [f"in:{tag}"]
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            out.append("is:hidden")
        out += [f"of:{p.lower()}" for p in PART.findall(a or b or c)]
    if len(_KNOWN) >= 4096:
        _KNOWN.clear()
    return _KNOWN.setdefault((tag, attributes), tuple(dict.fromkeys(out)))


class Block:
    __slots__ = ("text", "tag", "inherited", "linked", "bold")

    def __init__(self, text: str, tag: str, inherited: frozenset, linked: int, bold: int):
        self.text, self.tag, self.inherited, self.linked, self.bold = text, tag, inherited, linked, bold


class Open:
    """The elements that are open, innermost last, with the places of each tag's and each kind's, so that none is searched for."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset]] = [("html", frozenset())]
        self.places: dict[str, list[int]] = {}
        self.kinds = {kind: [] for kind in (BLOCK, P_KEEPS, HIDDEN)}
        self.kinds[BLOCK].append(0)
        self.kinds[P_KEEPS].append(0)

    def push(self, tag: str, inherited: frozenset) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        for kind, at in self.kinds.items():
            if tag in kind:
                at.append(len(self.stack))
        self.stack.append((tag, inherited))

    def cut(self, k: int) -> bool:
        """Close all from place k on; whether a block was among them."""
        block = self.kinds[BLOCK][-1] >= k
        for tag, _ in self.stack[k:]:
            self.places[tag].pop()
        for at in self.kinds.values():
            while at and at[-1] >= k:
                at.pop()
        del self.stack[k:]
        return block

    def last(self, tags) -> int:
        """The place of the innermost of these tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks that have text, in order."""
    now, out = Open(), []
    pieces: list[tuple[str, bool, bool]] = []
    hidden = now.kinds[HIDDEN]

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(p for p, _, _ in pieces).split())
        if text:
            linked, bold = (sum(len(p[0]) for p in pieces if p[k]) for k in (1, 2))
            tag, inherited = now.stack[now.kinds[BLOCK][-1]]
            out.append(Block(text, tag, inherited, linked, bold))
        pieces.clear()

    def close(k: int) -> None:
        if now.kinds[BLOCK][-1] >= k:
            flush()
        now.cut(k)

    def say(text: str, plain: bool = False) -> None:
        if text and not hidden:
            pieces.append((text if plain else html.unescape(text), bool(now.places.get("a")), bool(now.places.get("b") or now.places.get("strong"))))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if now.places.get(tag):
                close(now.places[tag][-1])
            continue
        if tag in RAW or tag in LITERAL:
            if tag != "plaintext":
                over = _raw_end(tag).search(page, at)
                if tag in LITERAL:
                    flush()
                    say(page[at : over.start() if over else end], plain=True)
                    flush()
                at = over.end() if over else end
            continue
        if tag == "br":
            if not hidden:
                pieces.append((" ", False, False))
            continue
        if tag in BLOCK:
            if hidden and now.places.get("head"):
                close(now.places["head"][-1])
            flush()
            if tag in P_ENDS and (k := now.last(("p",))) > now.kinds[P_KEEPS][-1]:
                close(k)
        if tag in IMPLIED:
            ended, between = IMPLIED[tag]
            if (k := now.last(ended.split())) > now.last(between):
                close(k)
        elif tag == "a" and (k := now.last(("a",))) > now.kinds[BLOCK][-1]:
            close(k)  # a link ends an open one
        if tag in VOID:
            continue
        inherited = now.stack[-1][1]
        if tag in BLOCK or tag in HIDDEN or m[3]:
            inherited = inherited.union(_own_features(tag, m[3]))
        now.push(tag, inherited)
    flush()
    return out


@lru_cache(16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


_WORD = re.compile(r"\w+")
_CUE = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved|cookie|subscribe|newsletter|sign (?:in|up)|log ?in|privacy|terms of|advert|sponsored|share|follow us|comments?\b|repl(?:y|ies)\b|related|read more", re.I)


def features(blocks: list[Block]) -> list[list[str]]:
    """Each block's features as strings. Contents matter only through lengths, links and marks."""
    out, before = [], None
    for i, b in enumerate(blocks):
        words, size = len(_WORD.findall(b.text)), max(1, len(b.text))
        f = ["bias", *b.inherited, f"tag:{b.tag}", f"words:{min(7, words.bit_length())}", f"linked:{min(4, int(4 * b.linked / size + 0.5))}"]
        f.append(f"end:{'stop' if b.text[-1] in '.!?…»”"' else 'open'}")
        f += [f"cue:{c.lower()}" for c in set(_CUE.findall(b.text))]
        if "in:header" in b.inherited and b.inherited.isdisjoint(("in:article", "in:main")):
            f.append("header of the page")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            f.append("bars")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        if before is not None and b.inherited == before.inherited:
            f.append("alike")
        out.append(f)
        before = b
    return out


@dataclass(frozen=True)
class Crf:
    """weights: feature -> what it adds to content against boilerplate. moves: 2 x 2, from and to a label. start: of a page."""

    weights: dict
    moves: tuple
    start: tuple

    def decode(self, found: list[list[str]]) -> list[int]:
        """Viterbi: the most likely labels (1: content) of a page's blocks."""
        get, (m, s) = self.weights.get, (self.moves, self.start)
        back, a, b = [], 0.0, 0.0
        for i, f in enumerate(found):
            own = sum(get(x, 0.0) for x in f)
            if i == 0:
                a, b = s[0], s[1] + own
                continue
            to0, to1 = (a + m[0][0], b + m[1][0]), (a + m[0][1], b + m[1][1])
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            a, b = max(to0), max(to1) + own
        if not found:
            return []
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam; sums over labels by the forward-backward algorithm, for all pages at once."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    names = {x: i for i, x in enumerate(sorted({x for f, _ in pages for b in f for x in b}))}
    n, size = len(pages), max(len(p[0]) for p in pages)
    lengths = np.array([len(p[0]) for p in pages])
    cell = np.concatenate([np.full(len(b), i * size + t) for i, (f, _) in enumerate(pages) for t, b in enumerate(f)])
    feat = np.concatenate([[names[x] for x in b] for f, _ in pages for b in f])
    gold = np.zeros((n, size), int)
    for i, (_, y) in enumerate(pages):
        gold[i, : len(y)] = y
    inside = np.arange(size)[None, :] < lengths[:, None]
    pair = inside[:, 1:]
    w = np.zeros(len(names) + 6)
    true = np.zeros_like(w)
    true[: len(names)] = np.bincount(feat, weights=gold.ravel()[cell], minlength=len(names))
    for a in (0, 1):
        true[len(names) + 4 + a] = (gold[:, 0] == a).sum()
        for b in (0, 1):
            true[len(names) + 2 * a + b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair).sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        moves, start = w[len(names) : len(names) + 4].reshape(2, 2), w[len(names) + 4 :]
        unary = np.zeros((n, size, 2))
        unary[:, :, 1] = np.bincount(cell, weights=w[feat], minlength=n * size).reshape(n, size)
        ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
        ahead[:, 0] = start + unary[:, 0]
        for t in range(1, size):
            ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + unary[:, t]
        for t in range(size - 2, -1, -1):
            after = unary[:, t + 1] + behind[:, t + 1]
            back = np.logaddexp(after[:, :1] + moves[None, :, 0], after[:, 1:] + moves[None, :, 1])
            behind[:, t] = np.where(inside[:, t + 1][:, None], back, 0)
        last = ahead[np.arange(n), lengths - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        p = np.where(inside[:, :, None], np.exp(np.minimum(0, ahead + behind - z[:, None, None])), 0)
        expected = np.zeros_like(w)
        expected[: len(names)] = np.bincount(feat, weights=p[:, :, 1].ravel()[cell], minlength=len(names))
        for a in (0, 1):
            expected[len(names) + 4 + a] = p[:, 0, a].sum()
            for b in (0, 1):
                q = ahead[:, :-1, a] + moves[a, b] + unary[:, 1:, b] + behind[:, 1:, b] - z[:, None]
                expected[len(names) + 2 * a + b] = np.exp(np.minimum(0, q))[pair].sum()
        g = (expected - true) / n + decay * w
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf({x: float(w[i]) for x, i in names.items()}, tuple(map(tuple, w[len(names) : len(names) + 4].reshape(2, 2).tolist())), tuple(w[len(names) + 4 :].tolist()))


def labelled(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of labelled pages; a block of pieces with different labels raises."""
    out = []
    for page, pieces in pages:
        blocks, labels, k = leaf_blocks(page), [], 0
        for b in blocks:
            own, rest = set(), b.text
            while rest:
                text, label = pieces[k]
                if not rest.startswith(text):
                    raise ValueError(f"block {b.text!r} doesn't begin with {text!r}")
                own.add(label)
                rest, k = rest[len(text) :].lstrip(), k + 1
            if len(own) > 1:
                raise ValueError(f"block {b.text!r} has several labels")
            labels.append(own.pop())
        if k != len(pieces):
            raise ValueError(f"no block has {pieces[k][0]!r}")
        out.append((features(blocks), labels))
    return out


@lru_cache(1)
def trained(count: int = 1500, seed: int = 1) -> Crf:
    """The model, trained on the package's labelled pages; the same in every process."""
    from sparkloom.llm.html_pages import labelled_pages

    return train(labelled(labelled_pages(count, seed)))


def main_text(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks)), strict=True) if y)


def with_main_text(pages: DataFrame, model: Crf | None = None, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""
    model = model or trained()

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p.as_py(), model) for p in batch], pa.string())

    extract.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.withColumn(out, F.arrow_udf(extract, "string")(F.col(column)))


def op2_html(spark, sf_dir: str) -> DataFrame:
    pages = with_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
