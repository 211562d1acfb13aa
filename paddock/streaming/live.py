"""Live queries: results of a stream that are kept up to date in a table, and joins with answers that arrive later.

A sink for each batch appends the rows that have changed, under the batch's number; a batch that runs again replaces its own
rows.  Reading takes each key's newest row, and compacting writes these alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def keep_current(changed: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Starts keeping a streaming result in a table at ``path``, with everything that is there by now: each batch writes
    the rows that it has changed."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    return changed.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The rows as the last batches left them: the newest for each key (without keys, the newest row).  Null keys are equal."""
    rows = spark.read.schema(f"{schema}, {BATCH} long").parquet(path)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row"))
    return newest.select(*keys, "_row.*")


def newest_plates(changes: DataFrame) -> DataFrame:
    """(plateNumber, id, note, createdAt, removed) of a stream of registry changes (those columns, ``changed_at``): each
    plate as its last change leaves it (update mode)."""
    last = F.max_by(F.struct("id", "note", "createdAt", "removed"), F.struct("changed_at", "id"))
    return changes.groupBy("plateNumber").agg(last.alias("r")).select("plateNumber", "r.*")


def newest_first(plates: DataFrame) -> DataFrame:
    """The registry as a list: plates that aren't removed, the newest first."""
    return plates.where(~F.col("removed")).drop("removed").orderBy(F.desc("createdAt"), "id")


def answered(detections: DataFrame, answers: DataFrame, keep_ms: int, wait_ms: int, text_col: str = "raw_plate", delay: str = "0 seconds") -> DataFrame:
    """A stream of detections (event_id, ts, text) with what a stream of answers (text, answered_at, canonical,
    is_registered) says of their text: ``shown`` (the known plate, else the text) and ``is_registered``, null where none has come.

    An answer serves detections up to ``keep_ms`` after it and, those that wait for it, up to ``wait_ms`` before it; a
    text must have one answer in such a time.  A detection is shown when its answer comes, or as pending for good once
    the watermark has passed its wait; both sides' state goes with the watermark.
    """
    seen = detections.withColumn("_seen", F.timestamp_millis("ts")).withWatermark("_seen", delay)
    told = answers.select(F.col(text_col).alias("_text"), F.timestamp_millis("answered_at").alias("_told"), "canonical", "is_registered").withWatermark("_told", delay)
    near = F.expr(f"{text_col} = _text and _told >= _seen - interval {keep_ms} milliseconds and _told <= _seen + interval {wait_ms} milliseconds")
    joined = seen.join(told, near, "left")
    return joined.select("event_id", "ts", F.coalesce("canonical", text_col).alias("shown"), "is_registered")
