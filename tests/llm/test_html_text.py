"""Extraction against a plain reading of the tables' pages, cuts against all labellings, odd markup."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from paddock.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.fit()


def plain(page):
    found = re.search(r"(?s)<article>(.*?)</article>", page)
    body = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", found[1]))
    assert "<" not in body
    return " ".join(html.unescape(body).split())


def test_pages_equal_plain_reading(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    sources = {r.page_id: r for r in pages.collect()}
    got = H.extract(pages, model).collect()
    assert len(got) == len(sources)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (sources[r.page_id].url, plain(sources[r.page_id].html), len(r.text))


def cost(labels, costs, edges):
    return sum(max(0, c) if not x else max(0, -c) for x, c in zip(labels, costs)) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_cut_is_a_minimum():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 9)
        costs = [rng.choice([-3, -1, -0.5, 0, 0.25, 0.5, 2]) for _ in range(n)]
        edges = [(*sorted(rng.sample(range(n), 2)), rng.choice([0.1, 0.5, 1.5])) for _ in range(rng.randint(0, 2 * n) if n > 1 else 0)]
        best = min(cost(x, costs, edges) for x in itertools.product([False, True], repeat=n))
        assert cost(H.minimum_cut(costs, edges), costs, edges) == pytest.approx(best)


def accuracy(model, layouts, n, seed=77):
    """Shares of right blocks and of wholly right pages, by the cut and by each block alone; and of blocks it changes."""
    got = np.zeros((0, 3))
    pages = []
    for page, labels in H.training_pages(n, seed=seed, layouts=layouts):
        found = H.blocks_of(page)
        assert len(found) == len(labels), page
        cut, own = np.array(model.labels(found)), np.array(model.labels(found, cut=False))
        got = np.vstack([got, np.column_stack([cut == labels, own == labels, cut != own])])
        pages.append([(cut == labels).all(), (own == labels).all()])
    return got.mean(axis=0), np.mean(pages, axis=0)


def test_the_cut_is_better_than_blocks_alone(model):
    """On pages the model hasn't seen, and most where nothing in the markup tells an article."""
    (cut, own, changed), (pages_cut, pages_own) = accuracy(model, ("divs", "table", "names", "breaks"), 400)
    assert changed > 0.002 and cut > own + 0.002 and pages_cut > pages_own + 0.02 and cut >= 0.99
    (cut, own, _), _ = accuracy(model, ("article", "hints", "sections"), 300)
    assert cut >= own - 0.001 and cut >= 0.985


def test_a_layout_left_out_of_training():
    for layout in ("divs", "table", "names", "sections"):
        model = H.fit(H.training_pages(900, layouts=tuple(x for x in H.LAYOUTS if x != layout)))
        (cut, own, changed), _ = accuracy(model, (layout,), 200)
        assert changed > 0.004 and cut > own + 0.004


PLAIN = [
    (f"<div>Home News About</div><div><p>A long title of the page</p><p>{'Long enough, this text. ' * 6}</p><p>Short.</p></div><div>Copyright 2024 Example Inc</div>", "A long title of the page " + "Long enough, this text. " * 6 + "Short."),
    (f"<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>Main body text. {'Long enough, this text. ' * 6}</td></tr></table>", "Main body text. " + "Long enough, this text. " * 6),
    (f"<table><tr><td><a href=/>Home</a> | <a href=/n>News</a></td></tr><tr><td><p>First.</p><p>{'Long enough, this text. ' * 6}</p></td></tr><tr><td>&copy; 2020 us</td></tr></table>", "First. " + "Long enough, this text. " * 6),
    (f"<article><h1>Title</h1><p>{'Long enough, this text. ' * 6}</p></article><section class='responses'><p>I think, as {'a reader would say. ' * 5}</p></section>", "Title " + "Long enough, this text. " * 6),
    (f"<div class=c1><h1>Title</h1><p>{'Long enough, this text. ' * 6}</p></div><div class=c2><h3>2 Comments</h3><p>I think, as {'a reader would say. ' * 5}</p></div>", "Title " + "Long enough, this text. " * 6),
]


@pytest.mark.parametrize(("page", "text"), PLAIN)
def test_pages_without_marked_articles(model, page, text):
    assert H.main_text(page, model) == text.strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><p>One &amp; two&nbsp;&#8212; three &eacute;</p>\n<p>four\n\t five</p></article>", "One & two — three é four five"),
        ("<article><p>a<script>var x = '<p>no</p>';</script>b</p><style>p{}</style><p>c", "ab c"),
        ("<nav><ul><li><a href='/'>Home</a><li><a href='/b'>News</a></ul></nav><article><h1>Title</h1><p>Body text, long enough.<p>More</article><footer>&copy; us</footer>", "Title Body text, long enough. More"),
        ("<article><p>Kept <a href='x'>link</a> text.</p><div class='comments'><p>First!</p></div><div class=\"ad\">Buy now. Really, buy it.</div><p>End.</p></article>", "Kept link text. End."),
        ("<article><!-- <p>hidden</p> --><p title=\"a > b\">x < y & z</p></article>", "x < y & z"),
        ("<article><p>unclosed <b>bold <i>text</p><p>next</p></article></div></span>", "unclosed bold text next"),
    ],
)
def test_markup(model, page, text):
    assert H.main_text(page, model) == text


def test_awkward_rows(spark, model):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>x</p></article>"), (2, "v", "<article>" + "<p>long enough to be text.</p>" * 20_000 + "</article>"), (3, "w", "<" * 50_000), (4, "w", '<p class="' * 5_000), (5, "z", "<div>" * 20_000 + "deep")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract(pages, model).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.n_chars for r in got}[2] == 20_000 * len("long enough to be text. ") - 1
    assert H.extract(pages.limit(0), model).count() == 0


LONG = "Body text, long enough to be kept."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>No</title><meta charset='utf-8'><script>var x;</script><body><article><p>{LONG}</p></article></body></html>", LONG),
        (f"<head><title>No</title><link rel='x' href='y'><article><p>{LONG}</p></article>", LONG),
        (f"<head><title>No</title></head><article><p>{LONG}</p></article>", LONG),
        *[(f"<body><{tag}><article><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG} {LONG}") for tag in ("noscript", "svg", "button", "select", "math", "template", "iframe", "textarea")],
        *[(f"<article><p>{LONG}</p><{tag}><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG} {LONG} {LONG}") for tag in ("noscript", "svg", "button", "select", "math")],
        (f"<article><p>Press <button>OK</button> to go. {LONG}</p></article>", f"Press OK to go. {LONG}"),
        (f"<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, it holds. {LONG}</p></article>", f"Where x=2, it holds. {LONG}"),
        (f"<article><p>{LONG} <noscript>And more, without scripts.</noscript></p></article>", f"{LONG} And more, without scripts."),
        (f"<article><p>{LONG}</p><svg><path d='M0'/><g/></svg><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><script>var x = 1;", LONG),
    ],
)
def test_elements_without_end_tags(model, page, text):
    assert H.main_text(page, model) == text


def test_buttons_and_options_are_told_apart(model):
    page = f"<form><select><option>{LONG}<option>Two</select></form><article><p>{LONG}</p><p>{LONG}</p></article><div><button>Share</button></div><div><button>Reply</button></div>"
    found = H.blocks_of(page)
    assert [b.text for b in found] == [LONG, "Two", LONG, LONG, "Share", "Reply"]
    assert [b.controls / len(b.text) for b in found] == [1, 1, 0, 0, 1, 1]
    assert H.main_text(page, model) == f"{LONG} {LONG}"


MALFORMED = {
    "tags without an end": "<a " * 330_000,
    "end tags of nothing": "<div>" * 150_000 + "</p>" * 60_000,
    "quotes that don't come out even": '<a "><a" ' * 110_000 + '"',
    "blocks in deep markup": "<b>" * 150_000 + "<div></div>" * 50_000,
    "end tags without an end": "<textarea>" + "</textarea" * 100_000,
    "end tags out of a section": "<p><nav>" + "<i>" * 150_000 + "</p>" * 100_000,
    "items in deep markup": "<ul>" + "<b>" * 100_000 + "<li>x" * 100_000,
    "comments without an end": "<!--" * 250_000,
    "names of names": "<a<b" * 250_000 + ">",
    "signs": "<" * 500_000 + "&" * 500_000,
    "paragraphs": "<p>some words here</p>" * 45_000,
}


@pytest.mark.parametrize("kind", sorted(MALFORMED))
def test_a_megabyte_of_malformed_markup(model, kind):
    began = time.process_time()
    H.main_text(MALFORMED[kind], model)
    assert time.process_time() - began < 6  # a second or two; it was minutes to hours


def test_many_uncertain_blocks_are_cut_in_time():
    rng = random.Random(1)
    costs = [rng.uniform(-1, 1) for _ in range(20_000)]
    edges = [(i, i + 1, 0.9) for i in range(19_999)] + [(i, i + 3, 0.4) for i in range(19_997)]
    began = time.process_time()
    H.minimum_cut(costs, edges)
    assert time.process_time() - began < 20
