"""Removed words against a dictionary of all windows; small windows, frequent prefixes, awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import suffix_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), ws in zip(rows, words):
        if i is not None:
            for k in range(len(ws) - window + 1):
                x = tuple(ws[k : k + window])
                least[x] = min(least.get(x, i), i)
    out = []
    for (i, _), ws in zip(rows, words):
        gone = set()
        if i is not None:
            for k in range(len(ws) - window + 1):
                if least[tuple(ws[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((-1 if i is None else i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 50)
    assert any(n for _, _, n, _ in want)
    assert result(S.without_repeats(docs)) == want


@pytest.mark.parametrize(("window", "prefix", "group_rows"), [(12, 4, 4000), (12, 4, 5), (8, 8, 4000), (10, 3, 40)])
def test_passages_and_awkward_rows(spark, window, prefix, group_rows):
    rng = random.Random(window + group_rows)
    say = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(n)]
    passages = [say(rng.randint(5, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        ws = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            ws += p[a : len(p) - rng.randint(0, 4)] + say(rng.randint(0, 9))
        rows.append((i, " ".join(ws)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "x " * 400), (204, "x\t" * 300), (205, "x " * 400), (None, rows[3][1]), (5, rows[5][1]), (206, rows[5][1].replace(" ", "\n")), (207, "é日 " * 40), (208, "é日 " * 39 + "q")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string")
    assert result(S.without_repeats(docs, window, prefix, group_rows=group_rows)) == brute(rows, window)


def test_one_id_with_several_texts(spark):
    """Texts of one id are one document, and each loses its own words."""
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    a, b = say(60), say(70)
    rows = [(1, a), (2, b), (5, say(30) + a + say(10)), (5, say(5) + b + say(70)), (6, say(3) + a), (6, b), (6, b), (7, say(80))]
    rows = [(i, " ".join(ws)) for i, ws in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for group_rows in (None, 1):
        assert result(S.without_repeats(docs, group_rows=group_rows)) == brute(rows, 50)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=20, unique=True), st.integers(1, 5))
def test_runs_cover_what_their_places_cover(places, window):
    places = sorted(places)
    begins, ends = S.runs(places, window)
    cover = lambda p, q: set(range(p, q + window))
    assert set().union(*(cover(b, e) for b, e in zip(begins, ends))) == set().union(*(cover(p, p) for p in places))
    assert all(e + window < b for e, b in zip(ends, begins[1:]))


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d y"), (3, "a b c d e"), (4, "z")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in S.without_repeats(docs, 4, 2, keep_text=True).collect()}
    assert got == {1: None, 2: "x y", 3: "", 4: None}
    assert S.without_repeats(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(2, 9), st.integers(1, 9))
def test_every_window_has_its_least_places_as_anchors(words, window, prefix):
    prefix = min(prefix, window)
    hashes = np.array(words, np.uint64)
    places, _, lo, hi = S.anchors(hashes, window, prefix)
    g = S.grams(hashes, prefix)
    want = set()
    for k in range(len(words) - window + 1):
        inside = g[k : k + window - prefix + 1]
        want.update((k + np.flatnonzero(inside == inside.min())).tolist())
    assert places.tolist() == sorted(want)
    of = {p: [] for p in places.tolist()}  # the windows that each anchor has
    for k in range(len(words) - window + 1):
        inside = g[k : k + window - prefix + 1]
        for p in (k + np.flatnonzero(inside == inside.min())).tolist():
            of[p].append(p - k)
    assert [(min(x), max(x), len(x)) for x in of.values()] == [(a, b, b - a + 1) for a, b in zip(lo.tolist(), hi.tolist())]
