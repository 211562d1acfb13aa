"""Components against all pairs by brute force, in one piece and dealt into chunks; awkward rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import components, hashing, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        s = shingles(t, size)
        if s and i is not None:
            sets.setdefault(s, []).append(i)
    classes = [(min(ids), s) for s, ids in sets.items()]
    parent = list(range(len(classes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for k, (_, s) in enumerate(classes):
        for x in s:
            index.setdefault(x, []).append(k)
    for k, (_, s) in enumerate(classes):
        shared = {}
        for x in s:
            for other in index[x]:
                if other < k:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if 100 * n >= percent * (len(s) + len(classes[other][1]) - n):
                parent[root(k)] = root(other)
    least = {}
    for k, (i, _) in enumerate(classes):
        least[root(k)] = min(least.get(root(k), i), i)
    of = {s: least[root(k)] for k, (_, s) in enumerate(classes)}
    out = []
    for i, t in rows:
        s = shingles(t, size)
        c = None if i is None else of[s] if s else i
        out.append((-1 if i is None else i, len(s), -1 if c is None else c, i is None or c == i))
    return sorted(out)


def result(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in frame.collect())


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 3, 85)
    assert any(not kept for *_, kept in want)
    assert result(minhash.near_duplicates(docs, 3, 85)) == want


@pytest.mark.parametrize("group_docs", [None, 7])
def test_families_and_awkward_rows(spark, group_docs):
    rng = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(4000)]
    for family in range(4):
        base = rng.sample(words, 120)
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One"), (1004, "one"), (1005, "one two"), (1006, "ONE  TWO"), (None, "one"), (3, rows[3][1]), (3, "other text under the same id"), (1007, "x " * 60_000), (1008, "x X x x")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    assert result(minhash.near_duplicates(docs, 3, 85, group_docs=group_docs)) == brute(rows, 3, 85)


def test_defaults_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0


def test_circulant_coordinates_shift_one_permutation():
    turn = minhash.circle(192)
    assert sorted(turn[:, 0].tolist()) == list(range(minhash.CIRCLE))
    assert (turn[5:105, 0] == turn[:100, 5]).all() and (turn[minhash.CIRCLE - 1, 1:4] == turn[0, :3]).all()


def test_bands_follow_the_threshold():
    """A pair just at the threshold shares no band with a probability of MISS at most, whatever the threshold."""
    assert minhash.banding(85) == (31, 6) and minhash.banding(80) == (48, 6)
    for percent in range(1, 101):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS * 1.001 and (bands <= minhash.MOST_BANDS or rows == 1)
        least = minhash.signature(np.arange(50, dtype=np.uint64), bands * rows)
        assert len(minhash.band_keys(least, bands)) == bands


def test_one_hub_with_most_links(spark, monkeypatch):
    """A star, joined by broadcast and by salted keys."""
    from paddock.llm import common

    for limit in (100_000, 0):
        monkeypatch.setattr(common.join_small, "__defaults__", (limit, "inner"))
        monkeypatch.setattr(components, "FEW_LINKS", limit)
        links = [(0, i) for i in range(1, 3000)] + [(5000, 5001), (2999, 4000)]
        got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {**{i: 0 for i in range(3000)}, 4000: 0, 5000: 5000, 5001: 5000}


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = {x: root(x) for x in parent}
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB c\n\té\x1c ", max_size=40), max_size=8), st.sampled_from([3, 1000]))
def test_word_hashes_follow_words(texts, block):
    hashes, counts = hashing.word_hashes(texts, lower=True, block=block)
    words = [WORD.findall(t.translate(LOWER)) for t in texts]
    assert counts.tolist() == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_few_links_are_few_tasks_whatever_the_partitions(spark):
    """A round over few links doesn't start a task and write a file for each of the session's shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = [(i, i + 1) for i in range(0, 3000, 3)] + [(i + 1, i + 2) for i in range(0, 3000, 3)]
        found = components.connected(spark.createDataFrame(links, "a long, b long"))
        assert len(found.inputFiles()) <= 2 * components.FEW_TASKS
        assert {r.id: r.component for r in found.collect()} == {i: i - i % 3 for i in range(3000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
