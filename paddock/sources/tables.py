"""The registry and the visits as Parquet tables: schemas and their versions, and rewrites by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.operators.lookup import backfilled

PLATES = "id long, plateNumber string, note string, createdAt long, digitsKey string"
VISITS = "id long, plateNumber string, canonicalPlate string, isRegistered boolean, entryAt long, exitAt long"


def read_plates(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows of any version: files written before keys existed get them on the way; notes are never null."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    for column, missing in (("note", F.lit("")), ("digitsKey", F.lit(""))):
        rows = rows.withColumn(column, F.coalesce(column, missing) if column in rows.columns else missing)
    return backfilled(rows).select("id", "plateNumber", "note", "createdAt", "digitsKey")


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """Visits; none where the table doesn't exist yet, as before its version."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(VISITS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VISITS)


def replaced(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with ``rows`` in place of those with their keys, and new ones added."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def removed(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def with_value(table: DataFrame, keys, column: str, value: Column, key: str = "id") -> DataFrame:
    """``table`` with one column set where the key is among ``keys`` (a short list)."""
    return table.withColumn(column, F.when(F.col(key).isin(list(keys)), value).otherwise(F.col(column)))


def rewrite(rows: DataFrame, path: str) -> str:
    """Writes a new version of a table below ``path`` and returns its place; versions are folders, so that readers of
    the old one, the rewrite itself among them, are not disturbed."""
    version = f"{path}/version={uuid.uuid4().hex}"
    rows.write.parquet(version)
    return version


def write_preferences(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    spark.createDataFrame(list(values.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def read_preferences(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """A small table of settings over defaults; a missing table gives the defaults."""
    from pyspark.errors import AnalysisException

    try:
        return defaults | {r.key: r.value for r in spark.read.schema("key string, value string").parquet(path).collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return dict(defaults)
