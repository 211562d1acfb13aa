"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] and len(a) == len(b)


def plainly(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= times * counts[w]}
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


def drawn(seed, n, letters="abé", least=1, most=6):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(n)}
    return {w: int(10 ** rng.uniform(0, 4)) for w in words}


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=7), st.integers(1, 5), max_size=40))
def test_a_tree_finds_every_pair_once(counts):
    words = sorted(counts)
    found = spelling.merged(words, [counts[w] for w in words])
    want = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if near:
            want[w] = (len(near), min(near, key=lambda v: (-counts[v], v)))
    assert {words[i]: (n, words[b]) for i, (n, b) in found.items()} == want


def variants(spark, counts, **more):
    rows = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(rows, **more).collect()}


def test_levels_joined_by_spark_find_the_same(spark):
    for seed, tree_words in ((1, 3), (2, 25), (3, 10_000)):
        counts = drawn(seed, 400)
        assert variants(spark, counts, tree_words=tree_words) == plainly(counts)


def test_a_long_common_prefix_and_chains_of_forms(spark):
    stem = "z" * 200
    counts = {stem + w: n for w, n in drawn(5, 60, "xy", 1, 5).items()} | {"colour": 5000, "colours": 300, "colurs": 20, "colurrs": 2, "qcolurrs": 1, stem: 7}
    got = variants(spark, counts, tree_words=4)
    assert got == plainly(counts)
    assert got["colurrs"][:2] == ("colurs", "colour") and got["qcolurrs"][0] is None


def test_words_of_texts(spark):
    texts = [(1, "Straße strasse ÀÉÎÕÜßÿ ab1cdefghij Abcdefg×hijklmn don't"), (2, None), (3, ""), (None, "withoutid WITHOUTID"), (4, "repeated repeated"), (4, "repeated repeated"), (5, "l" * 100_000), *((i, "evenlonger Evenlonger wörterbuch") for i in range(10, 200))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n int")
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    words = spelling.vocabulary(docs, thin=31)
    assert {r.word: r.n for r in words.collect()} == want
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words).collect()} == plainly(want)
    assert any(f for f, *_ in plainly(want).values())
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).collect() == []
