"""Deterministic views over the driver's tables that carry the operators: registry, sightings and visits.

The tables hold no plates, so plates are derived from keys, in Spark and in SQL alike: ``customer`` gives the
registry, ``events`` the sightings with reading errors by event number, ``orders`` and ``lineitem`` the visits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.text import GLYPHS, digits_only

START_MS = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Milliseconds of a zoneless timestamp taken as UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', {column})")


def glyph(n: Column) -> Column:
    return F.substring(F.lit(GLYPHS), (F.pmod(n, F.lit(40)) + 1).cast("int"), F.lit(1))


def plate(n: Column, lead: Column | None = None, middle: Column | None = None) -> Column:
    lead = n if lead is None else lead
    middle = glyph(n) if middle is None else middle
    return F.concat((F.pmod(lead, F.lit(900)) + 100).cast("string"), middle, (F.pmod(n, F.lit(9000)) + 1000).cast("string"))


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, plateNumber, note, createdAt, digitsKey) before duplicates are dropped."""
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        i.alias("id"),
        plate(i).alias("plateNumber"),
        F.concat((F.expr("c_custkey div 20") + 101).cast("string"), F.lit("호")).alias("note"),
        (F.lit(START_MS) + i * 1000).alias("createdAt"),
        digits_only(plate(i)).alias("digitsKey"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per plate, that with the smallest id."""
    rows = registry_rows(spark, sf_dir)
    return rows.groupBy("plateNumber").agg(F.min_by(F.struct("id", "note", "createdAt", "digitsKey"), "id").alias("r")).select("r.id", "plateNumber", "r.note", "r.createdAt", "r.digitsKey")


REGISTRY_SQL = f"""
registry_rows AS (
  SELECT c_custkey AS id, (100 + c_custkey % 900)::VARCHAR || substr('{GLYPHS}', (c_custkey % 40)::INT + 1, 1) || (1000 + c_custkey % 9000)::VARCHAR AS plateNumber,
    (c_custkey // 20 + 101)::VARCHAR || '호' AS note, {START_MS} + c_custkey * 1000 AS createdAt,
    (100 + c_custkey % 900)::VARCHAR || (1000 + c_custkey % 9000)::VARCHAR AS digitsKey FROM customer),
registry AS (SELECT * FROM registry_rows QUALIFY row_number() OVER (PARTITION BY plateNumber ORDER BY id) = 1)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, raw_plate): every fourth user is unregistered; readings err by event number."""
    u, noise = F.col("user_id"), F.pmod("event_id", F.lit(10))
    lead = F.when(F.pmod(u, F.lit(4)) == 3, u + 1).otherwise(u)
    middle = F.when(noise == 5, "").when(noise == 6, "4").when(noise == 7, glyph(u + 7)).when(noise == 8, "L").otherwise(glyph(u))
    events = table(spark, sf_dir, "events")
    return events.select("event_id", millis("ts").alias("ts"), "user_id", plate(u, lead, middle).alias("raw_plate"))


SIGHTINGS_SQL = f"""
sightings AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id, (100 + (CASE WHEN user_id % 4 = 3 THEN user_id + 1 ELSE user_id END) % 900)::VARCHAR
    || CASE event_id % 10 WHEN 5 THEN '' WHEN 6 THEN '4' WHEN 7 THEN substr('{GLYPHS}', ((user_id + 7) % 40)::INT + 1, 1) WHEN 8 THEN 'L' ELSE substr('{GLYPHS}', (user_id % 40)::INT + 1, 1) END
    || (1000 + user_id % 9000)::VARCHAR AS raw_plate FROM events)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, plateNumber, canonicalPlate, isRegistered, entryAt, exitAt): finished for status F, open for O, without
    a known entry for P.  Some exits precede their entry, as the tables have it."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    own = plate(F.col("o_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        own.alias("plateNumber"),
        own.alias("canonicalPlate"),
        (F.pmod("o_custkey", F.lit(4)) != 3).alias("isRegistered"),
        F.when(F.col("o_orderstatus") != "P", millis("o_orderdate")).alias("entryAt"),
        F.when(F.col("o_orderstatus") != "O", millis("last")).alias("exitAt"),
    )


VISITS_SQL = f"""
visits AS (
  SELECT o_orderkey AS id, (100 + o_custkey % 900)::VARCHAR || substr('{GLYPHS}', (o_custkey % 40)::INT + 1, 1) || (1000 + o_custkey % 9000)::VARCHAR AS plateNumber,
    (100 + o_custkey % 900)::VARCHAR || substr('{GLYPHS}', (o_custkey % 40)::INT + 1, 1) || (1000 + o_custkey % 9000)::VARCHAR AS canonicalPlate,
    o_custkey % 4 <> 3 AS isRegistered, CASE WHEN o_orderstatus <> 'P' THEN epoch_us(o_orderdate) // 1000 END AS entryAt, CASE WHEN o_orderstatus <> 'O' THEN epoch_us(last) // 1000 END AS exitAt
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
