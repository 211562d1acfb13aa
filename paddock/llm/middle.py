"""Fill-in-middle: texts cut in three and put in another order, by DuckDB over Arrow batches.

Each batch is registered with an in-memory DuckDB of one thread and read by one SQL statement, so no row passes through
Python: ``regexp_extract_all`` cuts a text into code points, ``sha256`` of seed and id deals its cuts and its form,
``list_slice`` and ``array_to_string`` put prefix, suffix and middle together.  Restoring reverses that from the
output and the form alone.

The result depends on seed, id and text only: a task that runs again, or another partitioning, gives the same rows.  A
task holds a slice of texts (or one text, where it is longer) and about ten times its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SENTINELS = ("<P>", "<S>", "<M>")  #: before prefix, suffix and middle
PLAIN_PERCENT, SPM_PERCENT = 10, 20  #: texts left as they are, and of the others those with the suffix first
SLICE_BYTES = 2_000_000
RUN = 64  #: code points that one match takes
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

#: The four numbers are the first 8-digit groups of a digest: two cuts, whether to transform, and in which order.  Code
#: points are matched left to right in runs of RUN, so that a text makes few list elements; a cut takes whole runs and a
#: part of the one it falls into.
TRANSFORM = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s).{{1,{run}}}') AS units,
        sha256({seed} || ':' || coalesce(doc_id::VARCHAR, 'null')) AS digest
    FROM batch),
numbers AS (
    SELECT doc_id, text, units, {run} * greatest(len(units) - 1, 0) + length(coalesce(units[-1], '')) AS n,
        [('0x' || substr(digest, 1 + 8 * k, 8))::BIGINT for k in [0, 1, 2, 3]] AS h
    FROM texts),
cuts AS (
    SELECT doc_id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h[3] % 100 >= 100 - {plain} THEN 'plain'
             WHEN h[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
places AS (
    SELECT *, a // {run} AS i, b // {run} AS j, a % {run} AS x, b % {run} AS y, coalesce(units[a // {run} + 1], '') AS at_a, coalesce(units[b // {run} + 1], '') AS at_b FROM cuts),
parts AS (
    SELECT doc_id, text, n, form, a, b,
        array_to_string(list_slice(units, 1, i), '') || substr(at_a, 1, x) AS prefix,
        CASE WHEN i = j THEN substr(at_a, x + 1, y - x) ELSE substr(at_a, x + 1) || array_to_string(list_slice(units, i + 2, j), '') || substr(at_b, 1, y) END AS middle,
        substr(at_b, y + 1) || array_to_string(list_slice(units, j + 2, len(units)), '') AS suffix
    FROM places WHERE form <> 'plain'
    UNION ALL SELECT doc_id, text, n, form, a, b, NULL, NULL, NULL FROM places WHERE form = 'plain')
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
    CASE form WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
              WHEN 'spm' THEN {s} || suffix || {p} || prefix || {m} || middle ELSE text END AS output
FROM parts
"""
RESTORE = """
WITH pieces AS (SELECT *, CASE WHEN form <> 'plain' THEN regexp_split_to_array(output, {any}) END AS x FROM batch)
SELECT {columns}, CASE form WHEN 'psm' THEN array_to_string([x[2], x[4], x[3]], '') WHEN 'spm' THEN array_to_string([x[3], x[4], x[2]], '') ELSE output END AS text
FROM pieces
"""


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where each ``limit`` bytes of a text column are full; a slice holds less than that and one text."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            full = np.concatenate([[0], ends[:-1]]) // limit
            bounds = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), batch.num_rows]
            for first, last in zip(bounds, bounds[1:]):
                yield batch.slice(first, last - first)


def by_sql(sql: str, column: int, schema: pa.Schema):
    """A function for mapInArrow: runs ``sql`` over each slice of the batches, registered as ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for part in slices(batches, column):
                con.register("batch", pa.Table.from_batches([part]))
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("batch")

    return run


def _quoted(sentinels: tuple[str, str, str]) -> dict[str, str]:
    if len(set(sentinels)) < 3 or not all(re.fullmatch(r"<[^<>]+>", x) for x in sentinels):
        raise ValueError("sentinels must be three different names in angle brackets, so that none can begin inside another")
    return {k: "'" + x.replace("'", "''") + "'" for k, x in zip("psm", sentinels)}


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    ``form`` is psm (prefix, suffix, middle), spm (suffix first) or plain: the text as it is, which texts that are
    empty or hold a sentinel always stay.  Counts are of code points; null ones belong to plain texts.  A null text is
    an empty one; rows with a null id share one deal; repeated rows come back repeated; other columns are not read.
    """
    sql = TRANSFORM.format(run=RUN, seed=int(seed), plain=int(plain_percent), spm=int(spm_percent), **_quoted(sentinels))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_sql(sql, 1, schema), MADE)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, form, ..., text) from (doc_id, form, output): the text before :func:`transform`, with the columns named in
    ``keep``.  A null output is a null text; other columns are not read."""
    _quoted(sentinels)
    rows = made.select(F.col("doc_id").cast("long").alias("doc_id"), "form", *keep, "output")
    columns = rows.columns[:-1]
    sql = RESTORE.format(any="'" + "|".join(re.escape(x).replace("'", "''") for x in sentinels) + "'", columns=", ".join(f'"{c}"' for c in columns))
    told = T.StructType([*(rows.schema[c] for c in columns), T.StructField("text", T.StringType())])
    return rows.mapInArrow(by_sql(sql, len(columns), to_arrow_schema(told)), told)
