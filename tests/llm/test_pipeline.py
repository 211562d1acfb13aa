"""Every stage on its own input against brute force or the operator's own rows, and the whole run."""

import collections

import pytest

import corpus_pipeline as P
from paddock.llm import queries as Q
from paddock.llm import toxicity
from tests.llm import test_minhash as near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [(d.columns, d.collect()) for d in out]


def test_columns_and_order(steps):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "secrets", "mixture", "encoding"]
    for columns, _ in steps[:-1]:
        assert sorted(columns) == sorted(P.COLUMNS)


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    before, after = steps[0][1], steps[1][1]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = Q.toxicity_chain(spark, SF, docs)
    p = {r.doc_id: chain.probabilities([chain.active(r.text)])[0, -1] for r in before}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if p[r.doc_id] < Q.TOXIC_FROM}
    clear = {"idiot", "moron", "scum", "worthless"}
    assert not [r.doc_id for r in after if len(clear & toxicity.features(r.text)) >= 2]


def test_near_copies_equal_brute_force(steps):
    rows = [(r.doc_id, r.text) for r in steps[1][1]]
    assert {r.doc_id for r in steps[2][1]} == {i for i, *_, kept in near.brute(rows, 5, 80) if kept}


def test_secrets_are_masked_and_all_documents_stay(steps):
    before, after = {r.doc_id: r for r in steps[2][1]}, {r.doc_id: r for r in steps[3][1]}
    assert before.keys() == after.keys()
    assert all(r.n_chars == len(r.text) for r in after.values())
    changed = [i for i in after if after[i].text != before[i].text]
    assert all("<secret>" in after[i].text for i in changed)


def test_mixture_takes_whole_documents(spark, steps):
    before, after = steps[3][1], collections.Counter(r.doc_id for r in steps[4][1])
    copies = {r.doc_id: r.copies for r in Q.mixture(spark.createDataFrame(before)).collect()}
    assert after == collections.Counter({i: n for i, n in copies.items() if n})
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in steps[4][1])


def test_run_equals_stages(spark, steps):
    got = collections.Counter(tuple(r) for r in P.run(spark, SF).collect())
    assert got == collections.Counter(tuple(r) for r in steps[5][1])
    assert sum(got.values()) == len(steps[4][1]) > 0


def test_awkward_documents(spark, tmp_path):
    rows = [(None, "a b", "en", "src1", 3), (1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (3, "word " * 50_000, "en", "src1", 250_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.limit(0).count() == 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
