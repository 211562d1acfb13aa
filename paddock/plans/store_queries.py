"""Queries of files and tables that are written and read back: exports, captures, the registry's rewrites, settings; and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions import text
from paddock.operators import report, samples
from paddock.plans.carrier import REGISTRY_SQL, SIGHTINGS_SQL, START_MS, VISITS_SQL, plate, registry_rows, sightings, table, visits
from paddock.plans.visit_queries import ORACLES as VISIT_ORACLES
from paddock.scratch import scratch_path, written
from paddock.sources import exports, spreadsheets, tables


def visits_by_first_instant(spark, sf_dir):
    return report.by_first_instant(visits(spark, sf_dir))


def _read_lines(spark, path):
    """A file for spreadsheets, read back as one."""
    return spreadsheets.read_delimited(spark, f"{path}/part-*").select("line_no", F.array_join("cells", "|").alias("cells"))


def visits_export_file(spark, sf_dir):
    """All visits exported to a file, header and byte-order mark first, and the file read back."""
    path = scratch_path(spark, "export")
    exports.write_visits(visits(spark, sf_dir), path)
    return _read_lines(spark, path)


def _captures(spark, sf_dir):
    """A capture for each supplier, (id, stamp, read, file, epochMs, content): names that meet and need repair, some files empty."""
    i = F.col("s_suppkey")
    read = F.when(i % 4 == 0, F.concat(F.lit(" 12/가 "), (i % 9).cast("string"), F.lit('?"'))).when(i % 4 == 1, F.lit(" :* ")).when(i % 4 == 2, plate(i))
    rows = table(spark, sf_dir, "supplier").select(i.cast("long").alias("id"), (F.lit(START_MS) + i % 37).alias("stamp"), read.alias("read"), F.when(i % 5 == 0, F.lit("")).otherwise(F.col("s_name")).cast("binary").alias("content"))
    return rows.withColumn("file", exports.capture_names(rows))


def _store(spark, sf_dir):
    """A folder of captures, and its manifest, appended to by two batches."""
    folder, manifest, rows = scratch_path(spark, "captures"), scratch_path(spark, "manifest"), _captures(spark, sf_dir)
    spreadsheets.write_files(rows, folder)
    for batch in (0, 1):
        exports.append_manifest(rows.where(F.col("id") % 2 == batch).select("file", F.col("read").alias("appRead"), F.col("stamp").alias("epochMs")), manifest)
    return folder, exports.read_manifest(spark, manifest)


def captures_stored(spark, sf_dir):
    """The captures of a manifest with their sizes in the folder, where they have any."""
    folder, manifest = _store(spark, sf_dir)
    return exports.stored(manifest, folder)


def captures_purged(spark, sf_dir):
    """How many captures a folder holds before and after the empty ones are deleted, and how many of those it holds."""
    folder, _ = _store(spark, sf_dir)
    count = lambda when: written(exports.capture_count(exports.captures(spark, folder)).select(F.lit(when).alias("when"), "captures", "empty"), "counted")
    before = count("before")
    exports.purge(spark, folder)
    return before.unionByName(count("after"))


def capture_manifest_file(spark, sf_dir):
    """The manifest as a file for spreadsheets, read back."""
    path, (_, manifest) = scratch_path(spark, "manifest-file"), _store(spark, sf_dir)
    exports.write_manifest(manifest, path)
    return _read_lines(spark, path)


def registry_rewritten(spark, sf_dir):
    """The registry as a table of files: plates of suppliers added in place of rows with their ids, others removed, notes changed."""
    rows = registry_rows(spark, sf_dir)
    place = tables.rewrite(rows, scratch_path(spark, "registry"))
    i = F.col("s_suppkey") * 7
    new = table(spark, sf_dir, "supplier").select(i.alias("id"), plate(i + 1).alias("plateNumber"), F.col("s_name").alias("note"), (F.lit(START_MS) - i).alias("createdAt"), text.digits_only(plate(i + 1)).alias("digitsKey"))
    gone = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).where("id % 3 = 0")
    changed = tables.with_value(tables.removed(tables.replaced(tables.read_plates(spark, place), new), gone), [1, 2, 5, 7], "note", F.concat("note", F.lit(" *")))
    return tables.read_plates(spark, tables.rewrite(changed, scratch_path(spark, "registry")))


def user_settings(spark, sf_dir):
    """What each user's scans mean, from what they saved: each sighting saves a mode, or now and then what is none, or another setting."""
    e = F.col("event_id")
    value = F.when(e % 7 == 0, "park").otherwise(F.when(e % 2 == 0, "PARKING").otherwise("CHECK"))
    saves = sightings(spark, sf_dir).select(F.col("user_id").alias("owner"), F.when(e % 3 == 0, "sound").otherwise("mode").alias("key"), F.when(e % 3 == 0, F.when(e % 2 == 0, "on").otherwise("off")).otherwise(value).alias("value"), F.col("ts").alias("at"), e.alias("id"))
    return samples.last_settings(saves, {"mode": samples.MODES, "sound": ("on", "off")})


def keyboard_glyphs(spark, sf_dir):
    """Glyphs from the keys of their letters, for each customer."""
    i = F.col("c_custkey").cast("int")
    keys = F.concat(F.substring(F.lit("rsefaqtdwgz"), i % 11 + 1, F.lit(1)), F.substring(F.lit("kjhnox"), F.expr("cast(c_custkey div 11 as int)") % 6 + 1, F.lit(1)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey"), keys.alias("keys")).select("c_custkey", "keys", text.from_keys("keys").alias("glyph"))


def sample_plates(spark, sf_dir):
    """Fifty plates for each supplier."""
    return samples.sample_plates(table(spark, sf_dir, "supplier"), "s_suppkey")


QUERIES = {f.__name__: f for f in (visits_by_first_instant, visits_export_file, captures_stored, captures_purged, capture_manifest_file, registry_rewritten, user_settings, keyboard_glyphs, sample_plates)}

CAPTURES_SQL = f"""
r AS (SELECT s_suppkey AS id, {START_MS} + s_suppkey % 37 AS stamp, s_suppkey % 5 = 0 AS empty, length(s_name) AS n,
  CASE s_suppkey % 4 WHEN 0 THEN ' 12/가 ' || s_suppkey % 9 || '?"' WHEN 1 THEN ' :* ' WHEN 2 THEN (100 + s_suppkey % 900)::VARCHAR || substr('{text.GLYPHS}', (s_suppkey % 40)::INT + 1, 1) || (1000 + s_suppkey % 9000)::VARCHAR END AS read FROM supplier),
b AS (SELECT *, 'cap_' || stamp || '_' || coalesce(nullif(regexp_replace(read, '[/:*?"\\s]', '', 'g'), ''), 'none') AS base FROM r),
captures AS (SELECT *, base || CASE WHEN row_number() OVER w > 1 THEN '_' || (row_number() OVER w - 1) ELSE '' END || '.png' AS file FROM b WINDOW w AS (PARTITION BY base ORDER BY id))"""

ORACLES = {
    "visits_by_first_instant": f"WITH {VISITS_SQL} SELECT * FROM visits",
    "visits_export_file": f"""SELECT row_number() OVER (ORDER BY position NULLS FIRST, id) AS line_no, replace(line, ',', '|') AS cells FROM ({VISIT_ORACLES['visits_export_rows']})
UNION ALL SELECT 0, '{exports.HEADER.replace(',', '|')}'""",
    "captures_stored": f"WITH {CAPTURES_SQL} SELECT file, read AS appRead, stamp AS epochMs, CASE WHEN NOT empty THEN n END AS length FROM captures",
    "captures_purged": """SELECT 'before' AS "when", count(*) AS captures, count(*) FILTER (s_suppkey % 5 = 0) AS empty FROM supplier UNION ALL SELECT 'after', count(*) FILTER (s_suppkey % 5 <> 0), 0 FROM supplier""",
    "capture_manifest_file": f"""WITH {CAPTURES_SQL} SELECT row_number() OVER (ORDER BY stamp, file) AS line_no, file || '|' || CASE WHEN contains(read, '"') THEN replace(read, '"', '') || ',' ELSE coalesce(read, '') || '|' END || stamp AS cells FROM captures
UNION ALL SELECT 0, '{exports.MANIFEST_HEADER.replace(',', '|')}'""",
    "registry_rewritten": f"""WITH {REGISTRY_SQL},
a AS (SELECT * FROM registry_rows WHERE id NOT IN (SELECT s_suppkey * 7 FROM supplier)
  UNION ALL SELECT s_suppkey * 7, (100 + (s_suppkey * 7 + 1) % 900)::VARCHAR || substr('{text.GLYPHS}', ((s_suppkey * 7 + 1) % 40)::INT + 1, 1) || (1000 + (s_suppkey * 7 + 1) % 9000)::VARCHAR, s_name, {START_MS} - s_suppkey * 7,
    (100 + (s_suppkey * 7 + 1) % 900)::VARCHAR || (1000 + (s_suppkey * 7 + 1) % 9000)::VARCHAR FROM supplier)
SELECT id, plateNumber, note || CASE WHEN id IN (1, 2, 5, 7) THEN ' *' ELSE '' END AS note, createdAt, digitsKey FROM a WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)""",
    "user_settings": f"""WITH {SIGHTINGS_SQL}, s AS (SELECT user_id AS owner, event_id, ts, event_id % 3 = 0 AS sound, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END
  WHEN event_id % 7 = 0 THEN 'CHECK' WHEN event_id % 2 = 0 THEN 'PARKING' ELSE 'CHECK' END AS value FROM sightings)
SELECT owner, coalesce(arg_max(value, (ts, event_id)) FILTER (NOT sound), 'CHECK') AS mode, coalesce(arg_max(value, (ts, event_id)) FILTER (sound), 'on') AS sound FROM s GROUP BY owner""",
    "keyboard_glyphs": """WITH k AS (SELECT c_custkey, c_custkey % 11 AS c, c_custkey // 11 % 6 AS v FROM customer)
SELECT c_custkey, substr('rsefaqtdwgz', c::INT + 1, 1) || substr('kjhnox', v::INT + 1, 1) AS keys, CASE WHEN c < 10 AND v < 5 THEN chr((44032 + ([0, 2, 3, 5, 6, 7, 9, 11, 12, 18][c + 1] * 21 + [0, 4, 8, 13, 1][v + 1]) * 28)::INT) END AS glyph FROM k""",
    "sample_plates": f"""WITH e AS (SELECT s_suppkey AS seed, i::INT AS position, md5(s_suppkey || ':' || i) AS h, i - 39 AS beyond FROM supplier, (SELECT unnest(range(50)) AS i)),
n AS (SELECT *, ('0x' || substr(h, 1, 7))::BIGINT AS a, ('0x' || substr(h, 8, 7))::BIGINT AS b, ('0x' || substr(h, 15, 7))::BIGINT AS c FROM e)
SELECT seed, position, CASE WHEN CASE WHEN beyond < 0 THEN position % 2 = 0 ELSE beyond % 2 = 1 END THEN 100 + a % 400 ELSE 10 + b % 90 END::VARCHAR
  || CASE WHEN beyond < 0 THEN substr('{samples.USED_ONCE}', position + 1, 1) ELSE substr('{samples.TRICKY}', (beyond % 15)::INT + 1, 1) END || (1000 + c % 9000) AS plate FROM n""",
}
