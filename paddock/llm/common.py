"""Helpers that several corpus operators share: patterns of words, slices of Arrow batches, joins with small tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from paddock.scratch import scratch_path, written

__all__ = ["BROADCAST_ROWS", "SPACE", "WORD", "join_small", "scratch_path", "text_slices", "without", "word_count", "written"]

#: The words of every text operator: runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about ``limit`` bytes of the text column, one row at least:
    the memory of what follows depends on the longest text, not on the batch."""
    for batch in batches:
        first, rows = 0, batch.num_rows
        if not rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        size = 0
        for i, n in enumerate(lengths):
            if i > first and size + n > limit:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n
        yield batch.slice(first, rows - first)


def word_count(text) -> F.Column:
    """Number of words of a text column; a null text has none."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


#: Most rows of a table that is joined by broadcast; a row of the tables in question has well under 1 kB.
BROADCAST_ROWS = 100_000
SALTS = 16


def join_small(big: DataFrame, small: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """Join (inner or left) with a table (already written) of few rows per key.  Its rows are counted: up to ``limit`` it is
    broadcast; beyond, both sides are shuffled by key and salt, so that a frequent key is shared by ``SALTS`` tasks."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the salt of a row follows from the row: one that is read again after a loss goes where it went before
    own = [F.col(f"`{c}`") for c in big.columns if not isinstance(big.schema[c].dataType, MapType)]
    return big.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def without(rows: DataFrame, ids: DataFrame, limit: int = 10 * BROADCAST_ROWS) -> DataFrame:
    """``rows`` whose key isn't in ``ids`` (one column of distinct numbers): broadcast up to ``limit`` ids, which is
    16 MB, and shuffled beyond."""
    ids = written(ids, "ids")
    few = ids.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(ids) if few else ids, ids.columns[0], "left_anti")
