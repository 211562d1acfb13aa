"""Spreadsheets of plates as rows (file, line_no, cells): delimited text and XLSX, in folders of many files."""

from __future__ import annotations

import io
import re
import uuid
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BinaryType, StringType

from paddock.operators.lookup import small
from paddock.scratch import written

ROWS = "file string, line_no long, cells array<string>"
READ = f"{ROWS}, error string"


def split_cells(line: str, delimiter: str) -> list[str]:
    """Cells of a line.  A quote switches quoting on or off wherever it stands; doubled inside quotes it is one."""
    cells, held, quoted, at = [], [], False, 0
    while at < len(line):
        c = line[at]
        if c == '"':
            if quoted and line[at + 1 : at + 2] == '"':
                held.append(c)
                at += 1
            else:
                quoted = not quoted
        elif c == delimiter and not quoted:
            cells.append("".join(held))
            held = []
        else:
            held.append(c)
        at += 1
    return [*cells, "".join(held)]


@F.pandas_udf(ArrayType(StringType()))
def cells_of(lines: pd.Series, delimiters: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else split_cells(x, d) for x, d in zip(lines, delimiters)])


#: White space, with what Unicode adds to it: lines of nothing else are blank.
BLANK = r"[\p{Z}\x09-\x0D\x1C-\x1F]"


def read_delimited(spark: SparkSession, path, only: Column | None = None) -> DataFrame:
    """Rows (file, line_no, cells) of UTF-8 text files: a leading byte-order mark and blank lines are dropped; cells are parted
    by tabs in a file whose first line that isn't blank has more tabs than commas, else by commas.  A line is a row,
    quoted or not, and keeps the number that it has in its file.  ``only`` may choose files by their ``_metadata``.

    Spark splits files into parts and these into lines, so a large file is many tasks' work: lines are numbered within their
    part, and the counts of the parts before, a row each, give the numbers in the file.  Lines without a quote are
    split natively; the others go through Python.
    """
    read = spark.read.text(path)
    read = read if only is None else read.where(only)
    lines = read.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    lines = written(lines, "lines")  # the numbers within parts must not change between their uses
    parts = lines.groupBy("_path", "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("_path", "_part", (before - F.col("_first")).alias("_shift")), "parts")
    numbered = lines.join(small(parts), ["_path", "_part"]).withColumn("n", F.col("_at") + F.col("_shift"))
    numbered = numbered.withColumn("line", F.when(F.col("n") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))).where(F.regexp_replace("line", BLANK, "") != "")
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    first = numbered.groupBy("_path").agg(F.min_by(F.when(count("\t") > count(","), F.lit("\t")).otherwise(F.lit(",")), "n").alias("delimiter"))
    marked = numbered.join(small(written(first, "delimiters")), "_path")
    plain, quoted = marked.where(~F.col("line").contains('"')), marked.where(F.col("line").contains('"'))
    by_tab = F.when(F.col("delimiter") == "\t", F.split("line", "\t")).otherwise(F.split("line", ","))
    shape = ["file", F.col("n").cast("long").alias("line_no")]
    return plain.select(*shape, by_tab.alias("cells")).unionByName(quoted.select(*shape, cells_of("line", "delimiter").alias("cells")))


def text_rows(data: bytes) -> list[tuple[int, list[str]]]:
    """(line_no, cells) of one small text, by the rules of :func:`read_delimited`."""
    lines = [x for x in enumerate(re.split("\r\n|\r|\n", data.decode("utf-8", "replace").removeprefix("\ufeff"))) if not re.fullmatch(r"[\s\x1c-\x1f]*", x[1])]
    tabs = bool(lines) and lines[0][1].count("\t") > lines[0][1].count(",")
    return [(n, split_cells(line, "\t" if tabs else ",")) for n, line in lines]


def column_index(reference: Column) -> Column:
    """The column (from 0) of a reference like B7; 0 without letters."""
    letters = F.filter(F.split(F.upper(F.regexp_extract(F.coalesce(reference, F.lit("")), "^([A-Za-z]*)", 1)), ""), lambda c: c != "")
    return F.greatest(F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1, F.lit(0))


def _column(reference: str | None) -> int:
    n = 0
    for c in reference or "":
        if not ("A" <= c.upper() <= "Z"):
            break
        n = n * 26 + ord(c.upper()) - 64
    return max(n - 1, 0)


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def sheet_rows(data: bytes) -> list[list[str]]:
    """Rows of a workbook's first worksheet (in the order of the archive).  Shared strings are the whole text of their
    items; a bad index is an empty cell; cells that are left out are empty up to the next one's column."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        sheet = next((n for n in names if n.startswith("xl/worksheets/sheet") and n.endswith(".xml")), None)
        if sheet is None:
            return []
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(item.itertext()) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter() if _local(item) == "si"]
        rows = []
        for row in (e for e in ElementTree.fromstring(book.read(sheet)).iter() if _local(e) == "row"):
            cells: list[str] = []
            for cell in (e for e in row if _local(e) == "c"):
                text = "".join(e.text or "" for e in cell.iter() if _local(e) in ("v", "t"))
                if cell.get("t") == "s":
                    at = text.strip()
                    text = shared[int(at)] if at.isascii() and at.isdigit() and int(at) < len(shared) else ""
                cells += [""] * (_column(cell.get("r")) - len(cells)) + [text]
            rows.append(cells)
        return rows


def _read_books(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for name, data in zip(part["file"], part["content"]):
            try:
                rows = sheet_rows(bytes(data))
                yield pd.DataFrame({"file": name, "line_no": range(len(rows)), "cells": rows, "error": None})
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as error:
                yield pd.DataFrame({"file": [name], "line_no": [-1], "cells": [None], "error": [str(error)]})


def book_rows(files: DataFrame) -> DataFrame:
    """Rows of workbooks (file, content), with ``error`` for a file that can't be read (it has one row then, number -1)."""
    return files.select("file", "content").mapInPandas(_read_books, READ)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    return book_rows(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content"))


@F.pandas_udf(BinaryType())
def packed(parts: pd.Series) -> pd.Series:
    """An archive of named texts, as a workbook is one."""

    def archive(texts) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            for name, text in dict(texts).items():
                book.writestr(name, text)
        return out.getvalue()

    return parts.map(archive)


IS_BOOK = "lower(_metadata.file_name) like '%.xlsx'"


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all spreadsheets of a folder, by the ends of their names: .xlsx workbooks, all else delimited text.  Files are
    chosen by their names as Spark lists them; no list of names passes through here."""
    books = spark.read.format("binaryFile").load(folder).where(IS_BOOK).select(F.col("_metadata.file_name").alias("file"), "content")
    texts = read_delimited(spark, folder, only=F.expr(f"not ({IS_BOOK})"))
    return book_rows(books).unionByName(texts.withColumn("error", F.lit(None).cast("string")))


class Sheets(DataSource):
    """``spark.read.format("plate_sheets").load(path)``: rows (file, line_no, cells, error) of the spreadsheets of a folder, or of
    one file; a file is a partition.  Register it once: ``spark.dataSource.register(Sheets)``.

    Files are listed and opened by Arrow's file systems (local, HDFS, S3, GCS).  Names that begin with a dot or a line are
    left out.  A file that can't be read has one row, number -1, with what is wrong.
    """

    @classmethod
    def name(cls) -> str:
        return "plate_sheets"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _SheetReader(self.options["path"])


class _SheetReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._opened()
        if system.get_file_info(path).type == fs.FileType.File:
            return [InputPartition(path)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [InputPartition(f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        name = partition.value.rpartition("/")[2]
        with self._opened()[0].open_input_stream(partition.value) as file:
            data = file.read()
        try:
            rows = enumerate(sheet_rows(data)) if name.lower().endswith(".xlsx") else text_rows(data)
            yield from [(name, n, cells, None) for n, cells in rows]
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as error:
            yield name, -1, None, str(error)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (file, content) as files of a folder, each under its name once it is whole, and returns (file, bytes): a task
    that runs again writes the same files.  For a row's content as a file of its own, which Spark's writers don't make."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        for part in batches:
            for name, content in zip(part["file"], part["content"]):
                own = f"{path}/_{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(bytes(content))
                system.move(own, f"{path}/{name}")
            yield pd.DataFrame({"file": part["file"], "bytes": part["content"].map(len)})

    return written(files.select("file", "content").mapInPandas(run, "file string, bytes long"), "files")
