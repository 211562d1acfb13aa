"""Budgets against a plain recursion, prefixes against whole orders, and awkward rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from paddock.llm import mixing


def share(given, rooms, weights):
    """Water filling of one node's children by the definition: fill the tightest child first."""
    out, left = {}, given
    order = sorted(rooms, key=lambda n: (rooms[n] / weights[n] if weights[n] else 0, n))
    for i, n in enumerate(order):
        total = sum(weights[m] for m in order[i:])
        if rooms[n] * total <= left * weights[n]:
            out[n] = rooms[n]
            left = max(0, left - rooms[n])
        else:
            for m in order[i:]:
                out[m] = min(rooms[m], left * weights[m] // total)
            break
    return out


def plain_budgets(leaves, weights, given, epochs, depth=0):
    if depth == len(weights):
        return {(): given}
    names = {path[depth] for path in leaves}
    under = {n: {p: t for p, t in leaves.items() if p[depth] == n} for n in names}
    w = {n: weights[depth].get(n, 1) for n in names}
    closed = lambda p: any(ws.get(x, 1) == 0 for ws, x in zip(weights, p))
    rooms = {n: sum(0 if closed(p) else t * epochs for p, t in under[n].items()) for n in names}
    out = {}
    for n, got in share(given, rooms, w).items():
        for rest, b in plain_budgets(under[n], weights, got, epochs, depth + 1).items():
            out[(n, *rest)] = b
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_recursion(spark, seed):
    rng = random.Random(seed)
    leaves = {(d, l, s): rng.choice([0, 5, 100, 10_000, 10**12]) for d in "ab" for l in "xyz" for s in "pqr" if rng.random() < 0.8}
    weights = [{"a": rng.randint(1, 5)}, {"x": 3, "z": rng.choice([0, 2])}, {"q": 7}]
    budget = rng.choice([0, 17, 5_000, 10**11, 10**15])
    frame = spark.createDataFrame([(*k, t, 1) for k, t in leaves.items()], "d string, l string, s string, tokens long, rows long")
    got = {(r.d, r.l, r.s): r.budget for r in mixing.budgets(frame, ["d", "l", "s"], weights, budget, 2).collect()}
    assert got == plain_budgets(leaves, weights, budget, 2)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "small", 10, 1), ("a", "large", 1000, 1), ("b", "only", 1000, 1)], "top string, low string, tokens long, rows long")
    got = {r.low: r.budget for r in mixing.budgets(leaves, ["top", "low"], [{}, {}], 400, 1).collect()}
    assert got == {"small": 10, "large": 190, "only": 200}


def levels():
    return {"domain": F.col("lang"), "origin": F.col("source")}


def brute(rows, weights, budget, epochs, seed):
    words = lambda t: len((t or "").replace("\x1c", "x").split()) if t else 0
    leaf = lambda r: (r[2] or mixing.NONE, r[3] or mixing.NONE)
    tokens = {}
    for r in rows:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + words(r[1])
    given, out = plain_budgets(tokens, weights, budget, epochs), []
    for k, have in tokens.items():
        whole, rest = divmod(given[k], have) if have else (0, 0)
        place = lambda r: (hashlib.md5(f"{seed}:{whole}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), words(r[1]))  # noqa: B023, E731
        own = [r for r in rows if leaf(r) == k]
        for r in own:
            begin = sum(words(o[1]) for o in own if place(o) < place(r))
            out.append((r[0] if r[0] is not None else -1, *k, words(r[1]), (whole + (begin < rest)) if words(r[1]) else 0))
    return sorted(out)


@pytest.mark.parametrize("bin_rows", [3, 10_000])
def test_copies_equal_brute_force(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None])) for i in range(300)]
    rows += [(None, "a b c", "en", "s1"), (7, None, "en", "s1"), (8, "", None, None), rows[10], rows[10], (9, "long " * 50_000, "en", "s3")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_tokens int")
    for budget in (0, 1, 900, 4_000, 10**7):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.domain, r.origin, r.n_tokens, r.copies) for r in mixing.mix(docs, levels(), [{"en": 2}, {"s2": 3}], budget=budget, max_epochs=3, seed=5).collect())
        assert got == brute(rows, [{"en": 2}, {"s2": 3}], budget, 3, 5)


def test_without_broadcast_and_empty(spark, monkeypatch):
    import paddock.llm.common as common

    docs = spark.createDataFrame([(i, "a b", "en", f"s{i % 3}") for i in range(50)], "doc_id long, text string, lang string, source string")
    want = sorted(map(tuple, mixing.mix(docs, levels(), [{}, {}], share=(1, 2)).collect()))
    monkeypatch.setattr(common.join_small, "__defaults__", (0, "inner"))
    assert sorted(map(tuple, mixing.mix(docs, levels(), [{}, {}], share=(1, 2)).collect())) == want
    assert mixing.mix(docs.limit(0), levels(), [{}, {}], share=(1, 2)).count() == 0


def test_columns_of_any_name_stay(spark):
    names = "rest epochs bins full_bin last _at _bin _id _row copies".split()
    docs = spark.createDataFrame([(i, "a b", "en", f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(20)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    leaves = mixing.shares(docs.select("doc_id", "text", "lang", "source"), levels(), [{}, {}], share=(1, 2))
    got = mixing.taken(docs, leaves, levels())
    assert got.columns == ["doc_id", "text", "lang", "source", *names[:-1], "domain", "origin", "n_tokens", "copies"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names[:-1]) and {r.copies for r in got.collect()} == {0, 1}
    assert sorted((r.doc_id, r.copies) for r in got.collect()) == sorted((r.doc_id, r.copies) for r in mixing.mix(docs, levels(), [{}, {}], share=(1, 2)).collect())
