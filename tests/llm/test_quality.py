"""Measurements against brute force, policies and ablations over stored bits."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


EDGES = [None, "", "   ", "\n\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d\na b c d\n\n#$%", " 　é é é é", "\ta\x0bb\x0cc\rd", "word " * 30_000, " ".join(map(str, range(20_000)))]


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(EDGES)] + [(1, EDGES[1], "clash", 7), (None, "a b c", None, None)]
    got = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string, failed string, n_words int")).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, *brute(t)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *[r[m] for m in quality.MEASURES]) for r in got) == want


def test_random_texts(spark):
    found = []

    @settings(max_examples=60, deadline=None)
    @given(st.text(alphabet="ab \n\t#é", max_size=80))
    def gather(t):
        found.append(t)

    gather()
    rows = quality.ledger(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r[m] for m in quality.MEASURES) for r in rows} == {i: brute(t) for i, t in enumerate(found)}


def test_policies_and_ablations(spark):
    entries = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4), (5, 8)], "doc_id long, failed long")
    kept = {r.doc_id for r in entries.where(quality.kept(entries.failed, "v1")).collect()}
    assert kept == {1, 5}
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(entries, "v1").collect()}
    assert got == {"few_words": (2, 1, 3), "repeated_words": (1, 0, 2), "symbols": (1, 1, 3)}


def test_empty_table(spark):
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
