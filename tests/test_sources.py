"""Readers and writers: quirks of cells, workbooks, versions of tables, exports."""

import os
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paddock.operators import lookup
from paddock.sources import exports, spreadsheets, tables


def rows_of(frame):
    return sorted((r.file, r.line_no, tuple(r.cells)) for r in frame.collect())


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿번호판,메모\r\n12가3456, x \r\n\r\n34나5678,\"a,b\"\"c\"\n5\"6,7\"8,9\n".encode())
    (tmp_path / "b.txt").write_text("1\t2,3\t\n4\t5\n")
    (tmp_path / "c.csv").write_text("")
    got = rows_of(spreadsheets.read_delimited(spark, str(tmp_path)))
    assert [(f, c) for f, _, c in got] == [("a.csv", ("번호판", "메모")), ("a.csv", ("12가3456", " x ")), ("a.csv", ("34나5678", 'a,b"c')), ("a.csv", ("56,78", "9")), ("b.txt", ("1", "2,3", "")), ("b.txt", ("4", "5"))]


def test_a_file_is_read_in_many_parts(spark, tmp_path):
    """Line numbers, the delimiter and the byte-order mark hold wherever a file is split."""
    ends = ["\n", "\r\n"]
    lines = ["", "번호판\t메모", *(f'{i}\t{"x" * (i % 40)}{"," if i % 3 else ""}' + ('"q,\t"' if i % 7 == 0 else "") if i % 5 else " " for i in range(700))]
    for name, mark in (("a", "\ufeff"), ("b", "")):
        (tmp_path / f"{name}.txt").write_bytes((mark + "".join(x + ends[k % 2] for k, x in enumerate(lines))).encode())
    (tmp_path / "c.txt").write_text("no tab, here")
    want = {(f"{name}.txt", n, tuple(spreadsheets.split_cells(x, "\t"))) for name in "ab" for n, x in enumerate(lines) if x.strip()} | {("c.txt", 0, ("no tab", " here"))}
    for size in ("150b", "1000b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (20 if size == "150b" else 0)
            got = [(r.file, r.line_no, tuple(r.cells)) for r in spreadsheets.read_delimited(spark, str(tmp_path)).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == len(want) and set(got) == want
    assert {(r.file, r.line_no, tuple(r.cells)) for r in _source(spark, tmp_path).collect()} == want


def _source(spark, path):
    spark.dataSource.register(spreadsheets.Sheets)
    return spark.read.format("plate_sheets").load(str(path))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\t ', max_size=8), min_size=1, max_size=5))
def test_quoted_cells_round_trip(cells):
    line = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    assert spreadsheets.split_cells(line, ",") == cells


def book(path, sheet, shared=None):
    with zipfile.ZipFile(path, "w") as z:
        if shared is not None:
            z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet/>")


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_xlsx(spark, tmp_path):
    shared = f"<sst {NS}><si><t>번호판</t></si><si><r><t>12가</t></r><r><t>3456</t></r></si></sst>"
    sheet = f"""<worksheet {NS}><sheetData>
      <row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>메모</v></c></row>
      <row r="2"><c r="A2" t="s"><v> 1 </v></c><c r="B2" t="s"><v>9</v></c><c r="D2" t="inlineStr"><is><t>x</t></is></c></row><row r="3"/></sheetData></worksheet>"""
    book(tmp_path / "a.xlsx", sheet, shared)
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "b.csv").write_text("1,2\n")
    (tmp_path / "c.XLSX").write_bytes((tmp_path / "a.xlsx").read_bytes())
    got = spreadsheets.read_sheets(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.line_no, r.cells) for r in _source(spark, tmp_path).drop("error").collect()) == sorted((r.file, r.line_no, r.cells) for r in got)
    assert [(r.line_no, r.cells) for r in _source(spark, tmp_path / "b.csv").collect()] == [(0, ["1", "2"])]
    assert sorted((r.line_no, tuple(r.cells)) for r in got if r.file == "a.xlsx") == [(0, ("번호판", "", "메모")), (1, ("12가3456", "", "", "x")), (2, ())]
    assert [(r.line_no, r.cells) for r in got if r.file == "broken.xlsx"] == [(-1, None)] and [r.error for r in got if r.file == "broken.xlsx"][0]
    assert [tuple(r.cells) for r in got if r.file == "b.csv"] == [("1", "2")]
    kept = lookup.import_candidates(spreadsheets.read_xlsx(spark, str(tmp_path / "a.xlsx")).drop("error"))
    assert sorted((r.plate, r.state) for r in kept.collect()) == [("12가3456", "kept"), ("번호판", "skipped")]


def test_column_references(spark):
    refs = spark.createDataFrame([("A1",), ("B7",), ("Z2",), ("AA10",), ("bc3",), ("7",), ("",), (None,)], "r string")
    assert [r[0] for r in refs.select(spreadsheets.column_index(F.col("r"))).collect()] == [0, 1, 25, 26, 54, 0, 0, 0]


def test_registry_versions(spark, tmp_path):
    path = str(tmp_path / "plates")
    spark.createDataFrame([(1, "154러7070", "301호", 1_700_000_000_000), (2, "12가3456", "", 1_700_000_001_000)], "id long, plateNumber string, note string, createdAt long").write.parquet(path)
    spark.createDataFrame([(3, "56너9876", "n", 5, "569876"), (4, "1가", None, 6, "")], tables.PLATES).write.mode("append").parquet(path)
    got = {r.id: tuple(r) for r in tables.read_plates(spark, path).collect()}
    assert got[1] == (1, "154러7070", "301호", 1_700_000_000_000, "1547070") and got[2][4] == "123456" and got[3][4] == "569876" and got[4] == (4, "1가", "", 6, "1")
    assert tables.read_visits(spark, str(tmp_path / "none")).count() == 0


def test_rewrites(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}", "", i, "") for i in range(5)], tables.PLATES)
    new = tables.replaced(rows, spark.createDataFrame([(1, "q", "", 1, ""), (9, "r", "", 9, "")], tables.PLATES))
    assert {r.id: r.plateNumber for r in new.collect()} == {0: "p0", 1: "q", 2: "p2", 3: "p3", 4: "p4", 9: "r"}
    place = tables.rewrite(tables.with_value(tables.removed(new, rows.where("id = 0")), [2], "digitsKey", F.lit("22")), str(tmp_path / "t"))
    assert {r.id: r.digitsKey for r in spark.read.parquet(place).collect()} == {1: "", 2: "22", 3: "", 4: "", 9: ""}
    tables.write_preferences(spark, str(tmp_path / "p"), {"mode": "PARKING"})
    assert tables.read_preferences(spark, str(tmp_path / "p"), {"mode": "CHECK", "x": "1"}) == {"mode": "PARKING", "x": "1"}
    assert tables.read_preferences(spark, str(tmp_path / "q"), {"mode": "CHECK"}) == {"mode": "CHECK"}


def test_new_ids_follow_the_registry(spark):
    registry = spark.createDataFrame([(7, "a", "", 1, "")], tables.PLATES)
    new = lookup.with_ids(spark.createDataFrame([(f"{i:03}가1234", "n") for i in range(50)], "plate string, note string").repartition(4), registry, 99).collect()
    assert sorted(r.id for r in new) == list(range(8, 58)) and all(r.digitsKey == r.plateNumber.replace("가", "") for r in new)


def test_exports(spark, tmp_path):
    visits = spark.createDataFrame([(1, "12가3456", "12가3456", True, 1_700_000_000_000, 1_700_000_190_000), (2, "b", "b", False, None, 1_600_000_000_000), (3, "c", "c", False, 1_800_000_000_000, None)], tables.VISITS)
    exports.write_visits(visits, str(tmp_path / "out"))
    (part,) = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert (tmp_path / "out" / part).read_bytes().decode() == "﻿번호판,등록여부,입차,출차,사용시간(분)\r\nb,미등록,,2020-09-13 12:26,\r\n12가3456,등록,2023-11-14 22:13,2023-11-14 22:16,3\r\nc,미등록,2027-01-15 08:00,,\r\n"


def test_captures(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "12가 34:56"), (2, 5, "12가3456"), (3, 5, None), (4, 5, " ")], "id long, stamp long, read string")
    names = [r[0] for r in rows.select("id", exports.capture_names(rows).alias("n")).orderBy("id").select("n").collect()]
    assert names == ["cap_5_12가3456.png", "cap_5_12가3456_1.png", "cap_5_none.png", "cap_5_none_1.png"]
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.png").write_bytes(b"")
    found = exports.captures(spark, str(tmp_path))
    assert tuple(exports.capture_count(found).first()) == (2, 1) and [r.file for r in exports.without_empty(found).collect()] == ["a.png"]
    assert exports.purge(spark, str(tmp_path)) == 1 and exports.captures(spark, str(tmp_path)).count() == 1
    assert exports.purge(spark, str(tmp_path), only_empty=False) == 1 and exports.captures(spark, str(tmp_path)).count() == 0
    manifest = spark.createDataFrame([("a.png", "12가3456", 7)], "file string, appRead string, epochMs long")
    for _ in range(2):
        exports.append_manifest(manifest, str(tmp_path / "m"))
    assert exports.read_manifest(spark, str(tmp_path / "m")).count() == 2


def test_a_manifest_tells_what_the_folder_holds(spark, tmp_path):
    """Names that a path has to escape, captures that are gone or empty, readings with white space; no image is read."""
    names = ["cap_1_12가3456.png", "cap_1_a+b %.png", "cap_2_none.png", "cap_3_gone.png"]
    for name, data in zip(names, (b"xyz", b"12", b"")):
        (tmp_path / "store").mkdir(exist_ok=True)
        (tmp_path / "store" / name).write_bytes(data)
    (tmp_path / "store" / "labels.csv").write_bytes(b"no image")
    rows = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(zip(names, (" 12가 3456 ", 'a,"b', None, "")))], "file string, appRead string, epochMs long")
    exports.append_manifest(rows, str(tmp_path / "m"))
    manifest = exports.read_manifest(spark, str(tmp_path / "m"))
    assert {r.file: r.appRead for r in manifest.collect()} == {names[0]: " 12가 3456 ", names[1]: 'a,"b', names[2]: None, names[3]: None}
    found = exports.stored(manifest, str(tmp_path / "store"))
    assert {r.file: r.length for r in found.collect()} == {names[0]: 3, names[1]: 2, names[2]: None, names[3]: None}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    exports.write_manifest(manifest.where("epochMs <> 1"), str(tmp_path / "out"))
    (part,) = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert (tmp_path / "out" / part).read_bytes().decode() == f"﻿파일,앱인식,시각\r\n{names[0]}, 12가 3456 ,0\r\n{names[2]},,2\r\n{names[3]},,3\r\n"
