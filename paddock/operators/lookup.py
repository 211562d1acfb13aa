"""The registry: imports, digit keys, and the two-stage lookup of sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.text import clean, digit_keys, digits_only, is_plate, middle_of, middles_agree, stripped, syllables
from paddock.scratch import written

LEAST_DIGITS = 6
#: Most registry rows that are broadcast; about 200 bytes each.
BROADCAST_ROWS = 500_000


def small(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if a count (which stops beyond ``limit``) shows that it is small enough."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


#: A key with more than this part of the rows is frequent; so there are at most a thousand.
FREQUENT = 1 / 1000
SALTS = 64


def met(rows: DataFrame, known: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``known`` by ``key`` (columns of both but one ``key``; null keys meet nothing).

    A small ``known`` is broadcast.  Beyond that the rows are shuffled, but for those of frequent keys, whose known rows
    are few and are broadcast (or, if a key has that many, repeated for each salt), and for those without a key, which a
    shuffle would send to one task.
    """
    told = known.where(F.col(key).isNotNull())
    if told.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(told), key, how)
    rows = written(rows, "met")
    counts = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    frequent = F.broadcast(counts.where((F.col("_n") > total * FREQUENT) & F.col(key).isNotNull()).select(key, F.lit(True).alias("_frequent")))
    marked = rows.join(frequent, key, "left")
    usual = marked.where(F.col("_frequent").isNull() & F.col(key).isNotNull()).drop("_frequent").join(told, key, how)
    few = told.join(frequent, key, "left_semi")
    often = marked.where(F.col("_frequent").isNotNull() | F.col(key).isNull()).drop("_frequent")
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return usual.unionByName(often.join(F.broadcast(few), key, how))
    salted = often.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return usual.unionByName(salted.join(repeated, [key, "_salt"], how).drop("_salt"))


def exact_matches(scans: DataFrame, registry: DataFrame, scan_col: str = "raw_plate") -> DataFrame:
    """``scans`` with ``matched``: the registered plate that equals the trimmed scan, or null.

    A plate registered twice counts once, as its smallest id.
    """
    plates = registry.groupBy("plateNumber").agg(F.min("id").alias("matched_id")).withColumnRenamed("plateNumber", "matched")
    told = met(scans.withColumn("_text", syllables(stripped(scan_col))), plates.withColumn("_text", F.col("matched")), "_text")
    return told.select(*scans.columns, "matched", "matched_id")


def digit_matches(scans: DataFrame, registry: DataFrame, key: str = "event_id", scan_col: str = "raw_plate") -> DataFrame:
    """(key, matched, matched_id): scans with exactly one registry row under one of their digit keys whose glyph
    doesn't contradict the scan's; scans with fewer than six digits have none.

    Registry rows that share digits and glyph, and equal scans, are one for the join: 5,400,000 rows with 600 to each
    key are as many rows of a join as there are keys and glyphs."""
    text = syllables(stripped(scan_col))
    scan = scans.select(text.alias("scan")).distinct().withColumn("keys", digit_keys("scan"))
    scan = scan.where(F.length(F.col("keys")[0]) >= LEAST_DIGITS)
    each = scan.select("scan", clean("scan").alias("cleaned"), F.explode(F.array_distinct("keys")).alias("digitsKey"))
    # a scan meets a row for each glyph of its digits, however many registry rows have them
    rows = registry.where("digitsKey <> ''").withColumn("glyph", middle_of(clean("plateNumber")))
    told = rows.groupBy("digitsKey", "glyph").agg(F.count(F.lit(1)).alias("n"), F.min_by("plateNumber", "id").alias("matched"), F.min("id").alias("matched_id"))
    told = written(told, "told")
    fitting = met(each, told.drop("glyph"), "digitsKey", "inner").where(middles_agree("cleaned", clean("matched")))
    only = fitting.groupBy("scan").agg(F.sum("n").alias("n"), F.min("matched").alias("matched"), F.min("matched_id").alias("matched_id")).where("n = 1").drop("n")
    found = scans.select(key, text.alias("_scan"))
    return met(found, written(only, "only").withColumnRenamed("scan", "_scan"), "_scan", "inner").select(key, "matched", "matched_id")


def resolve(scans: DataFrame, registry: DataFrame, key: str = "event_id", scan_col: str = "raw_plate") -> DataFrame:
    """``scans`` with ``matched``, ``canonical`` (the matched plate, else the trimmed scan) and ``is_registered``:
    exact matches first, digit matches for the rest.  ``key`` must identify a scan."""
    exact = written(exact_matches(scans, registry, scan_col), "exact")  # read by both branches, so scans meet the registry once
    hit = exact.where("matched is not null").select(*scans.columns, "matched")
    rest = exact.where("matched is null").select(*scans.columns)
    found = rest.join(digit_matches(rest, registry, key, scan_col).select(key, "matched"), key, "left").select(*scans.columns, "matched")
    return hit.unionByName(found).select("*", F.coalesce("matched", stripped(scan_col)).alias("canonical"), F.col("matched").isNotNull().alias("is_registered"))


def backfilled(registry: DataFrame) -> DataFrame:
    """Digit keys for rows that have none yet (null or empty), as after reading an older schema."""
    key = F.col("digitsKey") if "digitsKey" in registry.columns else F.lit("")
    missing = F.coalesce(key, F.lit("")) == ""
    return registry.withColumn("digitsKey", F.when(missing, digits_only("plateNumber")).otherwise(key))


def missing_keys(registry: DataFrame) -> DataFrame:
    return registry.where(F.coalesce("digitsKey", F.lit("")) == "").agg(F.count(F.lit(1)).alias("missing"))


def added(plate: str, note: str):
    """Columns of a plate entered by hand: trimmed, with its key."""
    return [stripped(plate).alias("plateNumber"), stripped(note).alias("note"), digits_only(stripped(plate)).alias("digitsKey")]


def entry_error(plate: str):
    """What is wrong with a plate entered by hand: 'empty', 'invalid', or null."""
    p = stripped(plate)
    return F.when(p == "", "empty").when(~is_plate(clean(p)), "invalid")


def import_candidates(rows: DataFrame) -> DataFrame:
    """(file, line_no, plate, note, state) of rows (file, line_no, cells): state is 'kept' for the first line of each valid
    plate of a file, 'repeated' for later ones, 'skipped' for what isn't a plate; rows without a plate are dropped."""
    cell = lambda k: F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit(""))
    named = rows.select("file", "line_no", F.replace(stripped(cell(1)), F.lit(" "), F.lit("")).alias("plate"), stripped(cell(2)).alias("note")).where("plate <> ''")
    valid = named.withColumn("valid", is_plate(clean("plate")))
    first = F.row_number().over(Window.partitionBy("file", "plate").orderBy("line_no")) == 1
    return valid.withColumn("state", F.when(~F.col("valid"), "skipped").when(first, "kept").otherwise("repeated")).drop("valid")


def import_plates(kept: DataFrame, registry: DataFrame) -> DataFrame:
    """(plate, note, state): 'added', or 'present' where the registry has the plate (its row and note stay)."""
    known = registry.select(F.col("plateNumber").alias("plate")).distinct().withColumn("known", F.lit(True))
    return met(kept, known, "plate").select("plate", "note", F.when(F.col("known"), "present").otherwise("added").alias("state"))


def import_outcome(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """(file, added, already_present, skipped) of :func:`import_candidates`: each file's plates that are new, those that the
    registry has, and its lines that hold no plate."""
    known = registry.select(F.col("plateNumber").alias("plate")).distinct().withColumn("known", F.lit(True))
    kept, has = F.col("state") == "kept", F.coalesce(F.col("known"), F.lit(False))
    counts = [F.count_if(kept & ~has).alias("added"), F.count_if(kept & has).alias("already_present"), F.count_if(F.col("state") == "skipped").alias("skipped")]
    return met(candidates, known, "plate").groupBy("file").agg(*counts)


def with_cache(detections: DataFrame, cache: DataFrame, text_col: str = "raw_plate") -> DataFrame:
    """Detections as they are shown: ``shown`` (the known plate, else the text) and ``is_registered``, which is null, that
    is pending, for a text that the cache (one row a text: text, canonical, is_registered) doesn't have yet."""
    told = cache.select(F.col("text").alias(text_col), "canonical", "is_registered")
    return met(detections, told, text_col).withColumn("shown", F.coalesce("canonical", text_col)).drop("canonical")


def import_message(added_col: str = "added", present_col: str = "already_present", skipped_col: str = "skipped"):
    """A sentence about an import; parts that are zero are left out."""
    n = lambda c: F.col(c).cast("string")
    part = lambda c, text: F.when(F.col(c) > 0, F.concat(n(c), F.lit(text)))
    # The words of the sentence.
    return F.concat_ws(", ", F.concat(n(added_col), F.lit("대 추가")), part(present_col, "대 이미 등록됨"), part(skipped_col, "줄 건너뜀"))


def with_ids(rows: DataFrame, registry: DataFrame, created_ms: int) -> DataFrame:
    """New registry rows (plate, note) with ids above the registry's: numbered per partition, then shifted by the
    sizes of the partitions before, so that no task orders all rows."""
    spark = rows.sparkSession
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    parted = rows.select("plate", "note", F.spark_partition_id().alias("_part"))
    numbered = written(parted.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("plate", "note"))), "numbered")  # partitions may differ when rows are made again
    sizes = numbered.groupBy("_part").agg(F.max("_n").alias("_size")).collect()  # one row per partition
    shift, at = [], top
    for r in sorted(sizes, key=lambda r: r["_part"]):
        shift.append((r["_part"], at))
        at += r["_size"]
    offsets = spark.createDataFrame(shift, "_part int, _shift long")
    new = numbered.join(F.broadcast(offsets), "_part")
    return new.select((F.col("_shift") + F.col("_n")).alias("id"), F.col("plate").alias("plateNumber"), "note", F.lit(created_ms).cast("long").alias("createdAt"), digits_only("plate").alias("digitsKey"))
