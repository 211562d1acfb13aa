"""How well plates and glyphs were read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.text import digits_only
from paddock.operators.lookup import small


def labelled(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``label``: a file's base name without its extension and a trailing number."""
    name = F.regexp_extract(path_col, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return files.withColumn("label", F.regexp_replace(name, r"_\d+$", ""))


def label_parts(label: str = "label"):
    """(lead, glyph, tail) of a label that begins with a plate; null parts otherwise."""
    shape = r"^(\d{2,3})([가-힣])(\d{4})"
    parts = [F.when(F.col(label).rlike(shape), F.regexp_extract(label, shape, k)).alias(n) for k, n in ((1, "lead"), (2, "glyph"), (3, "tail"))]
    return F.struct(*parts)


def scored(cases: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Adds ``exact_match`` and ``digit_match``; a missing reading matches nothing."""
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return cases.withColumn("exact_match", same(F.col(expected), F.col(actual))).withColumn("digit_match", same(digits_only(expected), digits_only(actual)))


def by_config(cases: DataFrame) -> DataFrame:
    """(config, n, exact, digits, mean_ms, p50_ms, p95_ms): shares, and latencies by nearest rank (the value at half, and
    at 95 %, of the sorted ones).  Ranks come from counts of equal latencies, so no configuration is sorted as one."""
    counts = cases.groupBy("config", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("config").orderBy("latency_ms")
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("config")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("latency_ms")))
    ranks = ranked.groupBy("config").agg(at(F.expr("all div 2")).alias("p50_ms"), at(F.least(F.expr("all * 95 div 100"), F.col("all") - 1)).alias("p95_ms"))
    share = lambda c: F.avg(F.col(c).cast("int"))
    totals = cases.groupBy("config").agg(F.count(F.lit(1)).alias("n"), share("exact_match").alias("exact"), share("digit_match").alias("digits"), F.avg("latency_ms").alias("mean_ms"))
    return totals.join(ranks, "config")


def recall(cases: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return cases.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.coalesce(F.col(predicted), F.lit(""))).cast("int")).alias("recall"))


def confusions(cases: DataFrame, label: str = "label", predicted: str = "predicted", top: int = 3) -> DataFrame:
    """The commonest wrong answers per label, ties by answer."""
    wrong = cases.where(~F.col(label).eqNullSafe(F.col(predicted))).groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), predicted))
    return wrong.withColumn("rank", rank).where(F.col("rank") <= top)


def agreement(cases: DataFrame, a: str, b: str) -> DataFrame:
    """How often two answers agree, and how often what they agree on is right."""
    same = F.col(a).eqNullSafe(F.col(b))
    return cases.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agree"), F.count_if(same & F.col(a).eqNullSafe(F.col("label"))).alias("agree_right"))


def repairs(cases: DataFrame, before: str = "before", after: str = "after", label: str = "label") -> DataFrame:
    """(checked, repaired, broken): answers that a step mended, and right ones that it spoilt."""
    right = lambda c: F.col(c).eqNullSafe(F.col(label))
    return cases.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~right(before) & right(after)).alias("repaired"), F.count_if(right(before) & ~right(after)).alias("broken"))


def middle_accuracy(cases: DataFrame, excluded: DataFrame, key: str = "file") -> DataFrame:
    """Accuracy over all cases, and over those that are neither excluded nor without a box."""
    marked = cases.join(small(excluded.select(key).distinct().withColumn("_out", F.lit(True))), key, "left")
    counts = F.coalesce(F.col("_out"), F.lit(False)) | ~F.col("has_box")
    right = F.col("label").eqNullSafe(F.col("predicted"))
    return marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.count_if(~counts).alias("n_scored"), F.count_if(right & ~counts).alias("right_scored"))
