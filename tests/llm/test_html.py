"""HTML extraction: parsing, the chain against enumeration, held-out pages, odd rows."""

import itertools

import numpy as np
import pytest

from sparkloom.llm import html_extract as H
from sparkloom.llm.html_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return H.trained()


def texts(page):
    return [b.text for b in H.leaf_blocks(page)]


def test_leaf_blocks():
    assert texts("<p>a &amp; b<br>c<p>d<b>e\n f</b><ul><li>x<li>y</ul>z") == ["a & b c", "de f", "x", "y", "z"]
    assert texts("<script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes</p>") == ["yes"]
    assert texts("<head><title>t</title></head><body>a<select><option>n</select><td>b<td>c") == ["a", "b", "c"]
    assert texts("plain &lt;text&#33; &nbsp; x &am") == ["plain <text! x &am"]
    assert texts("<p>cut <a hre") == ["cut"] and texts("") == [] and texts("a < b") == ["a < b"]
    assert texts("<article><p>one</article>two</p><div>three") == ["one", "two", "three"]


def test_decoding_against_all_labellings():
    rng = np.random.default_rng(0)
    weights = {f"f{k}": float(rng.normal()) for k in range(6)}
    crf = H.Crf(weights, tuple(map(tuple, rng.normal(size=(2, 2)).tolist())), tuple(rng.normal(size=2).tolist()))
    for _ in range(30):
        page = [[f"f{k}" for k in rng.integers(0, 6, 3)] for _ in range(rng.integers(1, 8))]

        def score(y, page=page):
            own = sum(sum(weights[f] for f in b) * label for b, label in zip(page, y, strict=True))
            return own + crf.start[y[0]] + sum(crf.moves[a][b] for a, b in itertools.pairwise(y))

        assert crf.decode(page) == list(max(itertools.product((0, 1), repeat=len(page)), key=score))
    assert crf.decode([]) == []


def test_held_out_pages(model):
    right = total = 0
    for found, gold in H.labelled(labelled_pages(300, 77)):
        right += sum(a == b for a, b in zip(model.decode(found), gold, strict=True))
        total += len(gold)
    assert right / total >= 0.98


def test_a_page(model):
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/a>News</a></ul></nav></header>
    <div class="cookie-banner"><p>We use cookies. Accept them all please.</p></div><article><h1>A title &amp; more</h1><p>First paragraph of the text,
    with a <a href=x>link</a> in it.</p><div class="ad"><p>Buy this now, it is very cheap indeed.</p></div><p>Second paragraph; it ends here.</p></article>
    <aside class="sidebar"><p>Most popular stories of the week.</p></aside><section id="comments"><p>I did not like this text at all, said a reader.</p></section>
    <form><label>Your mail</label><input></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
    assert H.main_text(page, model) == "A title & more\nFirst paragraph of the text, with a link in it.\nSecond paragraph; it ends here."


def test_query_takes_articles(spark, small, model):
    import html
    import re

    got = {r["page_id"]: r for r in H.op2_html(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>" + "words of a long text. " * 50_000 + "</p>"), (3, "w", "<article><p>Same text here, in full.</p>"), (3, "w", "<article><p>Same text here, in full.</p>"), (4, "x", "<" * 3000 + ">" * 3000), (5, "y", "<div>" * 3000 + "deep text, it is." + "</div>" * 3000)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, row int, id int")
    got = {(r["page_id"], r["url"]): r["text"] for r in H.with_main_text(pages, model).collect()}
    assert got[(1, "u")] == "" and got[(2, None)] == "" and got[(3, "w")] == "Same text here, in full."
    assert len(got[(None, "v")]) == len("words of a long text. ") * 50_000 - 1
    assert H.with_main_text(pages.limit(0), model).count() == 0


#: Pages written by hand, with layouts and class names other than those of the training pages where that matters.
PAGES = [
    ("<article><p>word text here</p></article>", "word text here"),
    ("<main><p>yes indeed</p></main>", "yes indeed"),
    ("<p>just some words</p>", "just some words"),
    ("<article><ul><li><a>First source</a><li><a>Second source</a></ul></article>", "First source\nSecond source"),
    ("<article><h1>On energy</h1><p>Energy is <math>E=mc2</math> they say.</p><xmp><b>code</b> &amp;</xmp></article>", "On energy\nEnergy is E=mc2 they say.\n<b>code</b> &amp;"),
    ("<article><h1>Title of it</h1><p>Some longer text that goes on, with a stop.</p><h2>References</h2><ul><li><a href=x>Smith 2001</a><li><a href=y>Jones 2004</a></ul></article><footer>Copyright</footer>", "Title of it\nSome longer text that goes on, with a stop.\nReferences\nSmith 2001\nJones 2004"),
    ('<article><p>Some longer text that goes on, with a stop.</p></article><section id="talk"><p>I think that this is wrong.</p><p>No, it is right, you know.</p></section>', "Some longer text that goes on, with a stop."),
    ('<article><p>Some longer text that goes on, with a stop.</p></article><div class="feedback"><p>I think that this is wrong.</p></div><div class="rail"><p>See these other stories of ours.</p></div><div class="disclosure"><p>We may earn money by links.</p></div>', "Some longer text that goes on, with a stop."),
    ("<details><summary>More</summary><p>Text in it, long enough.</p></details>", "More\nText in it, long enough."),
    ("<article><p>Choose one: <button>Go</button><select><option>x</select>and then go on with it.</p><script>x()</script></article>", "Choose one: and then go on with it."),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages_written_by_hand(model, page, text):
    assert H.main_text(page, model) == text


def test_many_open_elements_take_linear_time():
    import time

    began = time.process_time()
    assert len(H.leaf_blocks("<b>" * 8000 + "<p>x</p>" * 8000)) == 8000
    assert len(H.leaf_blocks("<i>" * 8000 + "</u>" * 8000 + "x")) == 1
    assert time.process_time() - began < 3


def test_links_and_bold_text_at_any_depth():
    deep = "<a href=x><b>" + "<i>" * 20 + "all of it" + "</i>" * 20 + "</b></a> not this"
    block = H.leaf_blocks(f"<p>{deep}</p>")[0]
    assert block.linked == block.bold == len("all of it")


def test_ties_are_no_content():
    crf = H.Crf({}, ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0))
    assert crf.decode([["x"], ["y"]]) == [0, 0]
