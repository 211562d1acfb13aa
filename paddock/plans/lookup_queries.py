"""Queries of plate text, the registry and lookups."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions import text
from paddock.operators import frames, lookup
from paddock.plans import plate_sql as P
from paddock.plans.carrier import REGISTRY_SQL, SIGHTINGS_SQL, plate, registry, registry_rows, sightings, table
from paddock.scratch import scratch_path
from paddock.sources import spreadsheets

# Texts as readers see them, with what they should give in tests/test_text.py.
READINGS = [
    "123가4567", "12가나1234", "04E 3456", "부산 80\nOf 7890", "56ㄴ19876", "12가3456", "56년9876", "56L9876", "154ㄹㅓ7070", "154ㄹㅏ7070", "154ㄹ17070", "154럭7070", "154려7070",
    "1547070", "15447070", "L67-5736", "TEL 627-9336", "123456789", "1가2345", "154리7070", "12시3456", "12지3456", "12니3456", "12이3456", "12X3456가7890", "서울1234", " 12 가　3456 ", "", *(unicodedata.normalize("NFD", t) for t in ("154러7070", "12가나1234", "부산 80\nOf 7890", "154럭7070")),
]


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(READINGS)], "id long, text string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    seen = sightings(spark, sf_dir).select((F.col("event_id") + 1_000_000_000).alias("id"), F.col("raw_plate").alias("text"))
    return given.unionByName(docs).unionByName(seen)


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


READINGS_SQL = f"""
readings AS (
  SELECT * FROM (VALUES {', '.join(f'({-1 - i}, {_quoted(t)})' for i, t in enumerate(READINGS))}) AS v(id, text)
  UNION ALL SELECT doc_id, text FROM documents UNION ALL SELECT event_id + 1000000000, raw_plate FROM sightings)"""


def registry_scan_newest(spark, sf_dir):
    return registry(spark, sf_dir).orderBy(F.desc("createdAt"), "id")


def registry_numbers(spark, sf_dir):
    return registry(spark, sf_dir).select("plateNumber")


def registry_digit_backfill(spark, sf_dir):
    old = registry_rows(spark, sf_dir).withColumn("digitsKey", F.when(F.pmod("id", F.lit(3)) == 0, "").when(F.pmod("id", F.lit(3)) == 1, F.col("digitsKey")))
    return lookup.backfilled(old).select("id", "plateNumber", "digitsKey")


def registry_missing_keys(spark, sf_dir):
    return lookup.missing_keys(registry_rows(spark, sf_dir).withColumn("digitsKey", F.when(F.pmod("id", F.lit(3)) == 0, "").otherwise(F.col("digitsKey"))))


def _import_rows(spark, sf_dir):
    """Lines of two files: a header, plates with spaces, repeats, short and broken rows."""
    i = F.col("c_custkey")
    cell = F.when(i % 11 == 0, F.lit("차량번호")).when(i % 13 == 0, F.lit("  ")).when(i % 7 == 0, F.concat(F.lit(" "), F.substring(F.lit("가나다라"), 1, 1), F.lit("12"))).otherwise(
        F.concat(F.lit(" "), ((i % 900) + 100).cast("string"), F.lit(" "), F.substring(F.lit(text.GLYPHS), (i % 40 + 1).cast("int"), F.lit(1)), F.lit(" "), ((i % 300) + 1000).cast("string"))
    )
    cells = F.when(i % 5 == 0, F.array(cell)).otherwise(F.array(cell, F.concat(F.lit(" 메모 "), i.cast("string"), F.lit("\t"))))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), (i % 2).cast("string")).alias("file"), i.alias("line_no"), cells.alias("cells"))


IMPORT_SQL = f"""
import_rows AS (
  SELECT 'f' || c_custkey % 2 AS file, c_custkey AS line_no,
    regexp_replace(CASE WHEN c_custkey % 11 = 0 THEN '차량번호' WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '가12'
      ELSE (c_custkey % 900 + 100)::VARCHAR || substr('{text.GLYPHS}', (c_custkey % 40)::INT + 1, 1) || (c_custkey % 300 + 1000)::VARCHAR END, ' ', '', 'g') AS plate,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '메모 ' || c_custkey END AS note FROM customer),
candidates AS (
  SELECT file, line_no, plate, note, CASE WHEN NOT {P.is_plate('plate')} THEN 'skipped' WHEN row_number() OVER (PARTITION BY file, plate ORDER BY line_no) = 1 THEN 'kept' ELSE 'repeated' END AS state
  FROM import_rows WHERE plate <> '')"""


def import_normalize(spark, sf_dir):
    return lookup.import_candidates(_import_rows(spark, sf_dir))


def import_counts(spark, sf_dir):
    return lookup.import_candidates(_import_rows(spark, sf_dir)).groupBy("file", "state").agg(F.count(F.lit(1)).alias("n"))


def import_anti_join(spark, sf_dir):
    """A list with a plate for every part, some of them registered, against the whole registry."""
    n = F.col("p_partkey") * 3
    new = table(spark, sf_dir, "part").select(plate(n).alias("plate")).distinct().withColumn("note", F.lit("다른 메모"))
    return lookup.import_plates(new, registry(spark, sf_dir))


def import_outcome(spark, sf_dir):
    """The two files of :func:`import_normalize` read into the registry."""
    return lookup.import_outcome(lookup.import_candidates(_import_rows(spark, sf_dir)), registry(spark, sf_dir)).select("*", lookup.import_message().alias("message"))


def manual_entries(spark, sf_dir):
    """Plates entered by hand: as a form trims them, and what is wrong with them."""
    i = F.col("s_suppkey")
    typed = F.when(i % 5 == 0, F.lit(" \t")).when(i % 5 == 1, F.concat(F.lit("x"), i.cast("string"))).otherwise(F.concat(F.lit(" "), plate(i), F.lit("\n")))
    rows = table(spark, sf_dir, "supplier").select(i.alias("id"), typed.alias("plate"), F.concat(F.col("s_name"), F.lit(" ")).alias("note"))
    return rows.select("id", *lookup.added("plate", "note"), lookup.entry_error("plate").alias("error"))


def detections_pending(spark, sf_dir):
    """Detections with what a cache of two thirds of the readings tells; the others are pending."""
    seen = sightings(spark, sf_dir)
    cache = lookup.resolve(seen.where("user_id % 3 <> 0"), registry(spark, sf_dir)).groupBy(F.col("raw_plate").alias("text")).agg(F.min("canonical").alias("canonical"), F.max("is_registered").alias("is_registered"))
    shown = lookup.with_cache(seen.select("event_id", "raw_plate"), cache)
    return shown.select("event_id", "shown", frames.state_label("is_registered").alias("state"))


def sheet_rows_delimited(spark, sf_dir):
    """Suppliers written as text with commas and quotes, and nations with tabs, read back as sheets."""
    base, i = scratch_path(spark, "sheets"), F.col("s_suppkey").cast("string")
    quoted = F.concat(F.lit('"'), F.replace(F.col("s_name"), F.lit("#"), F.lit(',""')), F.lit('"'))
    commas = F.concat_ws(",", i, F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(quoted), F.lit(""), F.lit(" x"))
    table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit(" \n"), commas)).otherwise(commas)).write.option("lineSep", "\r\n").text(f"{base}/commas")
    table(spark, sf_dir, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.lit("a,b"))).write.option("lineSep", "\r").text(f"{base}/tabs")
    read = lambda name: spreadsheets.read_delimited(spark, f"{base}/{name}/*.txt").select(F.lit(name).alias("sheet"), F.array_join("cells", "|").alias("cells"), F.size("cells").alias("n"))
    return read("commas").unionByName(read("tabs"))


def _books(spark, sf_dir):
    """(file, content): a workbook for each region with its nations: shared strings, cells left out, a bad index; and a file that is none."""
    cell = lambda ref, value, kind="": F.concat(F.lit(f'<c r="{ref}"{kind}><v>'), value, F.lit("</v></c>"))
    key = F.col("n_nationkey").cast("string")
    row = F.concat(F.lit("<row>"), cell("A1", F.lit("0"), ' t="s"'), F.when(F.col("n_nationkey") % 2 == 0, cell("B1", key)).otherwise(""), cell("D1", F.when(F.col("n_nationkey") % 3 == 0, "9").otherwise("1"), ' t="s"'), F.lit("</row>"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("x")))), lambda r: r["x"]), "").alias("rows"), F.min("n_name").alias("first"))  # a few nations a region
    sheet = F.concat(F.lit("<worksheet><sheetData>"), "rows", F.lit("</sheetData></worksheet>"))
    shared = F.concat(F.lit("<sst><si><t>"), "first", F.lit("</t></si><si><r><t>to</t></r><r><t>gether</t></r></si></sst>"))
    files = rows.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".xlsx")).alias("file"), spreadsheets.packed(F.create_map(F.lit("xl/worksheets/sheet1.xml"), sheet, F.lit("xl/sharedStrings.xml"), shared)).alias("content"))
    return files.unionByName(spark.range(1).select(F.lit("none.xlsx").alias("file"), F.lit(b"no archive").alias("content")))


def _told(rows):
    return rows.select("file", "line_no", F.array_join("cells", "|").alias("cells"), F.col("error").isNotNull().alias("failed"))


def sheet_rows_workbook(spark, sf_dir):
    return _told(spreadsheets.book_rows(_books(spark, sf_dir)))


def _sheet_files(spark, sf_dir):
    """A folder of the workbooks and, for each size of parts, a list of them as delimited text."""
    i, folder = F.col("p_partkey"), scratch_path(spark, "sheet-files")
    line = F.concat(F.when(i % 6 == 0, F.lit("\r\n")).otherwise(""), i.cast("string"), F.lit("\t"), F.when(i % 4 == 0, F.concat(F.lit('"'), "p_brand", F.lit('\t"'))).otherwise(F.col("p_brand")), F.lit("\t,"))
    lists = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("x")))), lambda r: r["x"]), "\n").alias("lines"))  # parts of a size: a list for people
    texts = lists.select(F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit(".txt")).alias("file"), F.concat(F.lit("\ufeff"), "lines").cast("binary").alias("content"))
    spreadsheets.write_files(_books(spark, sf_dir).unionByName(texts), folder)
    return folder


def sheet_rows_source(spark, sf_dir):
    """Spreadsheets of both kinds by their data source."""
    spark.dataSource.register(spreadsheets.Sheets)
    return _told(spark.read.format("plate_sheets").load(_sheet_files(spark, sf_dir)))


def sheet_rows_by_name(spark, sf_dir):
    """The same folder by Spark's own readers: workbooks whole, texts in parts."""
    return _told(spreadsheets.read_sheets(spark, _sheet_files(spark, sf_dir)))


def column_references(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("a")).otherwise(""), F.substring("p_brand", -1, 1), F.substring(F.upper(F.substring("p_name", 1, 1)), 1, 1), F.col("p_size").cast("string")).alias("reference"))
    return rows.select("p_partkey", "reference", spreadsheets.column_index(F.col("reference")).alias("place"))


def plate_extract(spark, sf_dir):
    cleaned = _readings(spark, sf_dir).select("id", text.clean("text").alias("cleaned"))
    return cleaned.select("id", text.strict_plate("cleaned").alias("strict"), text.lenient_plate("cleaned").alias("lenient"))


def plate_repair_table(spark, sf_dir):
    tokens = spark.range(11172).select(F.substring(F.decode(F.unhex(F.lpad(F.hex(F.col("id") + 0xAC00), 4, "0")), "UTF-16BE"), 1, 1).alias("token"))
    letters = spark.createDataFrame([(c,) for c in [*text.LONE, *text.LATIN, "Z", "ㅎ", "ㅏ"]], "token string")
    pairs = spark.createDataFrame([(a + b,) for a in text.INITIALS for b in text.VOWELS] + [(t,) for t in ("of", "OF", "Of", "oF", "ol", "oL", "Ol", "OL", "ab", "ㄱㄱ", "가나")], "token string")
    return tokens.unionByName(letters).unionByName(pairs).select("token", text.repaired_middle("token").alias("glyph")).where("glyph is not null")


def plate_digit_keys(spark, sf_dir):
    return sightings(spark, sf_dir).select("event_id", text.digits_only("raw_plate").alias("digits"), text.digit_keys("raw_plate").alias("keys")).select("event_id", "digits", F.array_join("keys", ",").alias("keys"))


def plate_middle_guard(spark, sf_dir):
    seen = sightings(spark, sf_dir)
    other = F.concat(F.lit("12"), F.substring(F.lit(text.GLYPHS), (F.col("user_id") % 40 + 1).cast("int"), F.lit(1)), F.lit("3456"))
    return seen.select("event_id", text.middle_of("raw_plate").alias("middle"), text.middles_agree("raw_plate", other).alias("agrees"), text.is_plate("raw_plate").alias("valid"))


def plate_nfc_clean(spark, sf_dir):
    rows = sightings(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit("154러 7070")).otherwise(F.concat(F.lit(" "), F.col("raw_plate"), F.lit("　"))).alias("text"))
    return text.composed(rows, "text").select("event_id", text.clean("text").alias("cleaned"))


def plate_reassembly(spark, sf_dir):
    seen = sightings(spark, sf_dir)
    return seen.select("event_id", text.reassembled("raw_plate", F.lit("가")).alias("reassembled"), text.with_glyph("raw_plate", F.lit("나")).alias("replaced"), text.stripped(F.concat(F.lit("　 "), F.col("raw_plate"), F.lit("\n"))).alias("trimmed"), text.enough_digits("raw_plate").alias("enough"))


def lookup_exact(spark, sf_dir):
    return lookup.exact_matches(sightings(spark, sf_dir), registry(spark, sf_dir)).select("event_id", "raw_plate", "matched")


def lookup_fallback(spark, sf_dir):
    return lookup.digit_matches(sightings(spark, sf_dir), registry(spark, sf_dir))


def lookup_with_duplicates(spark, sf_dir):
    """The registry as entered, where a plate registered twice makes its digits ambiguous."""
    return lookup.digit_matches(sightings(spark, sf_dir), registry_rows(spark, sf_dir))


def resolve_sightings(spark, sf_dir):
    return lookup.resolve(sightings(spark, sf_dir), registry(spark, sf_dir)).select("event_id", "ts", "raw_plate", "canonical", "is_registered")


def _digit_sql(name: str) -> str:
    return f"""
scans AS (SELECT event_id, raw_plate AS scan, {P.keys('raw_plate')} AS keys FROM sightings),
each AS (SELECT DISTINCT event_id, scan, unnest(keys) AS digitsKey FROM scans WHERE length(keys[1]) >= 6),
fitting AS (SELECT event_id, id, plateNumber FROM each JOIN {name} USING (digitsKey) WHERE {P.agree('scan', 'plateNumber')}),
fallback AS (SELECT event_id, min(plateNumber) AS matched, min(id) AS matched_id FROM fitting GROUP BY event_id HAVING count(*) = 1)"""


BASE = f"WITH {REGISTRY_SQL},{SIGHTINGS_SQL}"
RESOLVED_SQL = f"""{_digit_sql('registry')},
resolved AS (
  SELECT s.event_id, s.ts, s.user_id, s.raw_plate, coalesce(r.plateNumber, f.matched, s.raw_plate) AS canonical, coalesce(r.plateNumber, f.matched) IS NOT NULL AS is_registered
  FROM sightings s LEFT JOIN registry r ON r.plateNumber = s.raw_plate LEFT JOIN fallback f ON f.event_id = s.event_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        registry_scan_newest, registry_numbers, registry_digit_backfill, registry_missing_keys, import_normalize, import_counts, import_anti_join, import_outcome, plate_extract, plate_repair_table,
        plate_digit_keys, plate_middle_guard, plate_nfc_clean, plate_reassembly, lookup_exact, lookup_fallback, lookup_with_duplicates, resolve_sightings,
        manual_entries, detections_pending, sheet_rows_delimited, sheet_rows_workbook, column_references, sheet_rows_source, sheet_rows_by_name,
    )
}
IMPORTED = f"""SELECT DISTINCT plate, '다른 메모' AS note, CASE WHEN plate IN (SELECT plateNumber FROM registry) THEN 'present' ELSE 'added' END AS state
FROM (SELECT (100 + p_partkey * 3 % 900)::VARCHAR || substr('{text.GLYPHS}', (p_partkey * 3 % 40)::INT + 1, 1) || (1000 + p_partkey * 3 % 9000)::VARCHAR AS plate FROM part)"""
ORACLES = {
    "registry_scan_newest": f"WITH {REGISTRY_SQL} SELECT * FROM registry",
    "registry_numbers": f"WITH {REGISTRY_SQL} SELECT plateNumber FROM registry",
    "registry_digit_backfill": f"WITH {REGISTRY_SQL} SELECT id, plateNumber, digitsKey FROM registry_rows",
    "registry_missing_keys": "SELECT count(*) AS missing FROM customer WHERE c_custkey % 3 = 0",
    "import_normalize": f"WITH {IMPORT_SQL} SELECT * FROM candidates",
    "import_counts": f"WITH {IMPORT_SQL} SELECT file, state, count(*) AS n FROM candidates GROUP BY ALL",
    "import_anti_join": f"WITH {REGISTRY_SQL} {IMPORTED}",
    "import_outcome": f"""WITH {REGISTRY_SQL},{IMPORT_SQL}, c AS (
  SELECT file, count(*) FILTER (state = 'kept' AND plate NOT IN (SELECT plateNumber FROM registry)) AS added, count(*) FILTER (state = 'kept' AND plate IN (SELECT plateNumber FROM registry)) AS already_present,
    count(*) FILTER (state = 'skipped') AS skipped FROM candidates GROUP BY file)
SELECT *, concat_ws(', ', added || '대 추가', CASE WHEN already_present > 0 THEN already_present || '대 이미 등록됨' END, CASE WHEN skipped > 0 THEN skipped || '줄 건너뜀' END) AS message FROM c""",
    "manual_entries": f"""WITH t AS (SELECT s_suppkey AS id, s_name AS note, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' || s_suppkey
    ELSE (100 + s_suppkey % 900)::VARCHAR || substr('{text.GLYPHS}', (s_suppkey % 40)::INT + 1, 1) || (1000 + s_suppkey % 9000)::VARCHAR END AS plateNumber FROM supplier)
SELECT id, plateNumber, trim(note) AS note, {P.digits('plateNumber')} AS digitsKey, CASE WHEN plateNumber = '' THEN 'empty' WHEN id % 5 = 1 THEN 'invalid' END AS error FROM t""",
    "detections_pending": f"""{BASE},{RESOLVED_SQL}, cache AS (SELECT raw_plate, min(canonical) AS canonical, bool_or(is_registered) AS reg FROM resolved WHERE user_id % 3 <> 0 GROUP BY 1)
SELECT event_id, coalesce(canonical, raw_plate) AS shown, CASE WHEN reg IS NULL THEN 'pending' WHEN reg THEN 'registered' ELSE 'unregistered' END AS state FROM sightings LEFT JOIN cache USING (raw_plate)""",
    "sheet_rows_delimited": """SELECT 'commas' AS sheet, s_suppkey || '|' || CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE replace(s_name, '#', ',"') END || '|| x' AS cells, 4 AS n FROM supplier
UNION ALL SELECT 'tabs', n_nationkey || '|' || n_name || '|a,b', 3 FROM nation""",
    "sheet_rows_workbook": """WITH n AS (SELECT 'r' || n_regionkey || '.xlsx' AS file, n_nationkey, min(n_name) OVER (PARTITION BY n_regionkey) AS first, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line_no FROM nation)
SELECT file, line_no, first || '|' || CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE '' END || '||' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'together' END AS cells, false AS failed FROM n
UNION ALL SELECT 'none.xlsx', -1, NULL, true""",
    "column_references": """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END || right(p_brand, 1) || upper(left(p_name, 1)) || p_size AS reference FROM part),
l AS (SELECT *, upper(regexp_extract(reference, '^[A-Za-z]*')) AS letters FROM r)
SELECT p_partkey, reference, greatest(0, CASE length(letters) WHEN 0 THEN 0 WHEN 1 THEN ascii(letters) - 64 WHEN 2 THEN (ascii(letters) - 64) * 26 + ascii(right(letters, 1)) - 64
  ELSE ((ascii(letters) - 64) * 26 + ascii(substr(letters, 2, 1)) - 64) * 26 + ascii(right(letters, 1)) - 64 END - 1)::INT AS place FROM l""",
    "plate_extract": f"WITH {SIGHTINGS_SQL},{READINGS_SQL},{P.REPAIR},{P.lenient('readings', 'id', 'text')} SELECT * FROM read",
    "plate_repair_table": f"WITH {P.REPAIR} SELECT token, glyph FROM repair",
    "plate_digit_keys": f"WITH {SIGHTINGS_SQL} SELECT event_id, {P.digits('raw_plate')} AS digits, array_to_string({P.keys('raw_plate')}, ',') AS keys FROM sightings",
    "plate_middle_guard": f"WITH {SIGHTINGS_SQL}, s AS (SELECT *, '12' || substr('{text.GLYPHS}', (user_id % 40)::INT + 1, 1) || '3456' AS other FROM sightings) SELECT event_id, {P.middle('raw_plate')} AS middle, {P.agree('raw_plate', 'other')} AS agrees, {P.is_plate('raw_plate')} AS valid FROM s",
    "plate_nfc_clean": f"WITH {SIGHTINGS_SQL} SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '154러7070' ELSE raw_plate END AS cleaned FROM sightings",
    "plate_reassembly": f"""WITH {SIGHTINGS_SQL}, d AS (SELECT *, {P.digits('raw_plate')} AS d FROM sightings)
SELECT event_id, CASE WHEN length(d) BETWEEN 6 AND 8 THEN substr(d, 1, (length(d) - 4 - (length(d) = 8)::INT)::INT) || '가' || right(d, 4) END AS reassembled,
  regexp_replace(raw_plate, '[가-힣]', '나') AS replaced, raw_plate AS trimmed, length(d) >= 4 AS enough FROM d""",
    "lookup_exact": f"{BASE} SELECT event_id, raw_plate, plateNumber AS matched FROM sightings LEFT JOIN registry ON plateNumber = raw_plate",
    "lookup_fallback": f"{BASE},{_digit_sql('registry')} SELECT * FROM fallback",
    "lookup_with_duplicates": f"{BASE},{_digit_sql('registry_rows')} SELECT * FROM fallback",
    "resolve_sightings": f"{BASE},{RESOLVED_SQL} SELECT event_id, ts, raw_plate, canonical, is_registered FROM resolved",
}
ORACLES["sheet_rows_by_name"] = ORACLES["sheet_rows_source"] = f"""SELECT * FROM ({ORACLES['sheet_rows_workbook']}) UNION ALL
SELECT 's' || p_size || '.txt', row_number() OVER w - 1 + count(*) FILTER (p_partkey % 6 = 0) OVER w, p_partkey || '|' || CASE WHEN p_partkey % 4 = 0 THEN p_brand || chr(9) ELSE p_brand END || '|,', false
FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)"""
