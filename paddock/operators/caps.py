"""Limits by user: how often something may be shown, how often frames are looked at, what was seen last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.folds import let_through
from paddock.operators.visits import _around
from paddock.scratch import written

DAY_MS = 86_400_000


def daily_counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events by key and UTC day."""
    return events.groupBy(key, F.expr(f"ts div {DAY_MS}").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def allowed(events: DataFrame, key: str = "user_id", gap_ms: int = 240_000, per_day: int = 6, grace: int = 5) -> DataFrame:
    """``events`` (key, ts, event_id, kind open or ask) with ``shown``: whether an ask is granted.

    Granted are asks after more than ``grace`` opens, at least ``gap_ms`` after the last grant, while fewer than
    ``per_day`` were granted on the same UTC day.  A key's events are taken in order of (ts, event_id); only the
    asks beyond the grace enter the fold.
    """
    day = F.floor(F.col("ts") / DAY_MS)
    # opens before an ask are counted by day, a user's earlier days in one row each; structs make null keys equal
    rows = written(events.select(F.struct(key).alias("_key"), "ts", "event_id", "kind", day.alias("_part")), "asked")
    opens = F.sum(F.when(F.col("kind") == "open", 1).otherwise(0))
    counted = _around(rows, "_key", {"_earlier": (opens, "sum")})
    counted = counted.withColumn("_opens", F.col("_earlier") + opens.over(Window.partitionBy("_key", "_part").orderBy("ts", "event_id")))
    asks = counted.where(F.col("kind").eqNullSafe("ask") & (F.col("_opens") > grace)).select(F.col("_key")[key].alias(key), "ts", "event_id")
    days = list(range(1, per_day + 1))
    ids = let_through(asks, key, "ts", "event_id", day, [*[gap_ms] * per_day, None], ([*days, per_day], [*days, per_day]), start=0, afresh=True)
    granted = ids.withColumn("_granted", F.lit(True))
    return events.join(granted, "event_id", "left").withColumn("shown", F.coalesce("_granted", F.lit(False))).drop("_granted")


def throttled(frames: DataFrame, key: str = "user_id", active_ms: int = 300, idle_ms: int = 1000, idle_after: int = 10) -> DataFrame:
    """Frames (key, ts, event_id, hit) that are looked at: at least ``active_ms`` after the last one, or ``idle_ms`` once
    ``idle_after`` looks in a row were misses."""
    waits = [active_ms] * idle_after + [idle_ms]
    misses = [min(k + 1, idle_after) for k in range(idle_after + 1)]
    looked = let_through(frames, key, "ts", "event_id", F.floor(F.col("ts") / DAY_MS), waits, (misses, [0] * len(waits)), hit=F.col("hit"))
    return frames.join(looked, "event_id", "left_semi")


def latest(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    """The ``n`` values seen last, each at its latest (ts); ties by value."""
    return rows.groupBy(value).agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), value).limit(n)


def within(rows: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """Rows whose time to live hasn't run out."""
    return rows.where(F.lit(now_ms) - F.col("ts") < keep_ms)
