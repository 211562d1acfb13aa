"""The chain's order and out-of-fold inputs, held-out accuracy, and awkward rows."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from paddock.llm import queries as Q
from paddock.llm import toxicity


def held_out(spark, **more):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality", "toxic")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    chain = toxicity.fit(docs, labels.where(~held), more.pop("categories", None) or Q.toxic_categories(), **more)
    return chain, toxicity.score(docs, chain, keep=["text"]).join(labels.where(held), "doc_id").toPandas()


def test_held_out_accuracy(spark):
    chain, got = held_out(spark)
    assert chain.categories == ["poor", "toxic_1", "toxic_2", "toxic"]
    n = len(chain.vocabulary)
    assert [len(w) for w in chain.weights] == [n + 1, n + 2, n + 3, n + 4]
    assert np.abs(chain.weights[-1][n : n + 3]).max() > 0.2  # the last model listens to the earlier ones
    said = got.p_toxic >= Q.TOXIC_FROM
    assert (said & (got.toxic == 1)).sum() >= 0.8 * (got.toxic == 1).sum()  # some labelled rows carry no sign of toxicity
    assert (said & (got.toxic == 0)).sum() <= 0.01 * (got.toxic == 0).sum()
    _, alone = held_out(spark, categories={"toxic": F.col("toxic") == 1}, kinds=0)
    loss = lambda t: -np.log(np.where(t.toxic == 1, t.p_toxic, 1 - t.p_toxic).clip(1e-6)).mean()
    figures = {name: (((t.p_toxic >= 0.5) & (t.toxic == 1)).sum(), ((t.p_toxic >= 0.5) & (t.toxic == 0)).sum(), round(float(loss(t)), 4)) for name, t in (("chain", got), ("alone", alone))}
    print(figures, len(got), (got.toxic == 1).sum())
    assert loss(got) <= loss(alone) - 0.005  # the chain adds to what its last model knows by itself
    assert figures["chain"][0] >= figures["alone"][0] + 3


def brute(text, chain):
    """Probabilities of one text, feature by feature and category by category."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not words:
        return [0.0] * len(chain.categories)
    found = words | {w[:n] + "-" for w in words for n in (4, 5, 6) if len(w) >= n}
    out, n = [], len(chain.vocabulary)
    for w in chain.weights:
        odds = w[-1] + sum(w[chain.vocabulary[f]] for f in found if f in chain.vocabulary) + sum(p * w[n + k] for k, p in enumerate(out))
        out.append(1 / (1 + math.exp(-min(8, max(-8, odds)))))
    return out


def test_query_equals_brute_force(spark):
    """op4 over a whole table, against each text scored by itself with the same chain."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = Q.toxicity_chain(spark, sf_dir, docs)
    got = {r.doc_id: r for r in Q.op4_toxicity_chain(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = brute(text, chain)
        assert np.allclose([got[i][f"p_{c}"] for c in chain.categories], want, atol=1e-9)
        assert got[i].toxic == (want[-1] >= Q.TOXIC_FROM)


def test_kinds_split_what_differs():
    x = np.zeros((40, 6))
    x[:20, :3] = 1
    x[20:, 3:] = 1
    x[0] = 0
    own = toxicity.kinds_of(x, 2)
    assert own[0] == -1 and len(set(own[1:20])) == 1 and len(set(own[20:])) == 1 and own[1] != own[20]
    assert (toxicity.kinds_of(x[:5], 2) == -1).all() and len(toxicity.kinds_of(x[:0], 2)) == 0


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 5)) < 0.3).astype(float)
    first = x[:, 0] > 0
    labels = np.column_stack([first, first]).astype(float)
    weights = toxicity.fit_chain(x, labels, np.arange(600) % 3)
    assert weights[1][5] > 0.5  # the second category leans on the first one's out-of-fold probability


def test_awkward_rows(spark):
    random.seed(2)
    rows = [(i, "you idiot" if i % 3 == 0 else "kind words", "x") for i in range(90)]
    docs = spark.createDataFrame([*rows, (None, "idiot", "x"), (900, None, "x"), (901, "", None), (902, "idiot " * 200_000, ""), (0, "you idiot", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)] + [(3, 1), (None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs.drop("toxic"), labels, {"toxic": F.col("toxic") == 1})
    got = toxicity.score(docs, chain, keep=["toxic"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.p_toxic > 0.5) == (r.doc_id is None or r.doc_id == 902 or (r.doc_id < 90 and r.doc_id % 3 == 0))


def test_no_labels_and_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    chain = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"), {"toxic": F.col("toxic") == 1})
    assert toxicity.score(empty, chain).count() == 0
    one = toxicity.score(spark.createDataFrame([(1, "idiot")], "doc_id long, text string"), chain).first()
    assert one.p_toxic < 0.01
