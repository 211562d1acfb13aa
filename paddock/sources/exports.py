"""Visit exports and the manifest of captured frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.operators.report import export_lines

MARK = "﻿"
HEADER = "번호판,등록여부,입차,출차,사용시간(분)"
MANIFEST_HEADER = "파일,앱인식,시각"


def _text_file(lines: DataFrame, header: str, path: str) -> None:
    """Lines (position, id, line) as one text file of CRLF lines, byte-order mark and header first, in order of position and id.

    A file for people is one file: its lines meet in one task, which sorts them outside of memory where they don't fit; what
    makes the lines stays as many tasks as it was.
    """
    head = lines.sparkSession.createDataFrame([(0, None, None, MARK + header)], "part int, position long, id long, line string")
    whole = head.unionByName(lines.select(F.lit(1).alias("part"), "position", "id", "line"))
    whole.repartition(1).sortWithinPartitions("part", "position", "id").select("line").write.option("lineSep", "\r\n").text(path)


def write_visits(visits: DataFrame, path: str) -> None:
    """The visits as one text file in order of the first known instant."""
    _text_file(export_lines(visits), HEADER, path)


def capture_names(captures: DataFrame, stamp: str = "stamp", read: str = "read") -> Column:
    """``cap_<stamp>_<read>[_n].png``: characters that file names can't have and white space are dropped from the
    reading, an empty one is ``none``, and repeated names are numbered from 1 on."""
    safe = F.regexp_replace(F.coalesce(F.col(read), F.lit("")), r'[\\/:*?"<>|\p{Z}\x09-\x0D\x1C-\x1F]', "")
    base = F.concat(F.lit("cap_"), F.col(stamp).cast("string"), F.lit("_"), F.when(safe == "", "none").otherwise(safe))
    n = F.row_number().over(Window.partitionBy(base).orderBy("id")) - 1
    return F.concat(base, F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".png"))


def append_manifest(rows: DataFrame, path: str) -> None:
    """Adds (file, appRead, epochMs) lines to a manifest of CSV files; every file has a header.  Readings keep their white space; an
    empty one is none, as names have it."""
    rows.select("file", "appRead", "epochMs").write.mode("append").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("file string, appRead string, epochMs long").csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as one text file for spreadsheets, by time and then name.  Nothing is quoted, so a reading's own quotes and
    commas are taken for the file's."""
    n = F.row_number().over(Window.partitionBy("epochMs").orderBy("file"))  # captures of one millisecond
    lines = manifest.select(F.col("epochMs").alias("position"), n.cast("long").alias("id"), F.concat_ws(",", "file", F.coalesce("appRead", F.lit("")), F.col("epochMs").cast("string")).alias("line"))
    _text_file(lines, MANIFEST_HEADER, path)


def stored(manifest: DataFrame, path: str) -> DataFrame:
    """``manifest`` with ``length``, the size of each capture in a folder: null where the folder has none or an empty one.

    Spark lists the folder, and reads no image; the sizes meet the manifest by a join on names, nothing by the driver.
    """
    spark = manifest.sparkSession
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return manifest.join(sizes, "file", "left")


def _listing(spark: SparkSession, path: str):
    """The file system of a folder and the states of its files (Spark's readers don't show empty ones)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [f for f in system.listStatus(folder) if f.isFile() and f.getPath().getName().endswith(".png")]


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, length, modified) of captured images in a folder, empty ones too."""
    _, files = _listing(spark, path)
    rows = [(f.getPath().getName(), f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return spark.createDataFrame(rows, "file string, path string, length long, modified long")


def purge(spark: SparkSession, path: str, only_empty: bool = True) -> int:
    """Deletes captured images, by default those that hold nothing; returns how many."""
    system, files = _listing(spark, path)
    gone = [f for f in files if f.getLen() == 0 or not only_empty]
    return sum(bool(system.delete(f.getPath(), False)) for f in gone)


def capture_count(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("captures"), F.count_if(F.col("length") == 0).alias("empty"))


def without_empty(found: DataFrame) -> DataFrame:
    return found.where("length > 0")
