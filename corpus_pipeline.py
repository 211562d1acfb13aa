"""A training corpus from ``documents``: toxic ones out, near-duplicates out, secrets masked, sources mixed, text encoded.

STAGES run in order; each takes (spark, docs, sf_dir) and returns what the next one reads as ``docs``.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import bpe, minhash, mixing, queries, secrets, toxicity
from paddock.llm.common import without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    chain = queries.toxicity_chain(spark, sf_dir, docs)
    scored = toxicity.score(docs, chain, keep=COLUMNS[1:])
    return scored.where(F.col("p_toxic") < queries.TOXIC_FROM).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; five-word shingles, 0.8."""
    groups = minhash.near_duplicates(docs, size=5, percent=80)
    return without(docs, groups.where(~F.col("kept")).select("doc_id").distinct()).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, every secret replaced by a mark; n_chars follows the text."""
    clean = secrets.redacted(docs, queries.secret_forest(spark))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once, or once for each epoch."""
    levels = queries.mix_levels()
    leaves = mixing.shares(docs, levels, queries.MIX_WEIGHTS, share=queries.MIX_SHARE, max_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED)
    taken = mixing.taken(docs, leaves, levels, queries.MIX_SEED).where("copies > 0")
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded bytes."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # classifiers, confirmed near-duplicates and tokenising are beyond SQL; tests/llm/test_pipeline.py holds the stages

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
