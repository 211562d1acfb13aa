"""Limits over streams, with state that goes when it makes no difference any more.

Each is the stream of a batch operator in :mod:`paddock.operators.caps`: the same rows, whatever the micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.caps import DAY_MS
from paddock.streaming.ordered import Fold, folded


class _Spaced(Fold):
    """Rows at least ``gap`` after the last one let through."""

    row, entry, out = "ts long, event_id long", "last long", "event_id long, ts long"

    def __init__(self, gap: int):
        self.gap = gap

    def step(self, key, state: dict, row: tuple) -> Iterator[tuple]:
        ts, event_id = row
        if 0 not in state or ts - state[0][0] >= self.gap:
            state[0] = (ts,)
            yield event_id, ts

    def until(self, name: int, entry: tuple) -> int:
        return entry[0] + self.gap


class _Granted(Fold):
    """Asks of a user: the grace of the first opens, the gap, and the number in a day."""

    row, entry, out = "ts long, event_id long, kind string", "a long, b long, c long", "event_id long, ts long, shown boolean"
    OPENS, GRANTS = 0, 1

    def __init__(self, gap: int, per_day: int, grace: int):
        self.gap, self.per_day, self.grace = gap, per_day, grace

    def step(self, key, state: dict, row: tuple) -> Iterator[tuple]:
        ts, event_id, kind = row
        opens = state.get(self.OPENS, (0, 0, 0))[0]
        if kind == "open" and opens <= self.grace:
            state[self.OPENS] = (opens + 1, 0, 0)
        shown = False
        if kind == "ask":
            last, day, n = state.get(self.GRANTS, (0, -1, 0))
            today = n if day == ts // DAY_MS else 0
            shown = opens > self.grace and ts - last >= self.gap and today < self.per_day
            if shown:
                state[self.GRANTS] = (ts, ts // DAY_MS, today + 1)
        yield event_id, ts, shown

    def until(self, name: int, entry: tuple) -> int | None:
        """Grants count until their day is over and the gap has passed; opens count for good, up to the grace."""
        return max(entry[0] + self.gap, (entry[1] + 1) * DAY_MS) if name == self.GRANTS else None


class _Looked(Fold):
    """Frames looked at: soon after the last one, or later once many looks in a row were misses."""

    row, entry, out = "ts long, event_id long, hit boolean", "last long, misses long", "event_id long, ts long"

    def __init__(self, active: int, idle: int, idle_after: int):
        self.active, self.idle, self.idle_after = active, idle, idle_after

    def step(self, key, state: dict, row: tuple) -> Iterator[tuple]:
        ts, event_id, hit = row
        last, misses = state.get(0, (None, 0))
        if last is None or ts - last >= (self.idle if misses >= self.idle_after else self.active):
            state[0] = (ts, 0 if hit else min(misses + 1, self.idle_after))
            yield event_id, ts

    def until(self, name: int, entry: tuple) -> int | None:
        """After a hit a frame is as good as the first one once the wait is over; misses go on counting."""
        return entry[0] + self.active if entry[1] == 0 else None


def spaced(rows: DataFrame, gap_ms: int, key: str = "user_id", delay: str = "0 seconds") -> DataFrame:
    """(event_id, ts) of a stream's rows that come at least ``gap_ms`` after the last one let through, by key."""
    return folded(rows.withColumn(key, F.col(key).cast("string")), key, _Spaced(gap_ms), delay)


def granted(asks: DataFrame, key: str = "user_id", gap_ms: int = 240_000, per_day: int = 6, grace: int = 5, delay: str = "0 seconds") -> DataFrame:
    """(event_id, ts, shown) of a stream (key, ts, event_id, kind open or ask), as :func:`paddock.operators.caps.allowed`."""
    return folded(asks.withColumn(key, F.col(key).cast("string")), key, _Granted(gap_ms, per_day, grace), delay)


def looked(frames: DataFrame, key: str = "user_id", active_ms: int = 300, idle_ms: int = 1000, idle_after: int = 10, delay: str = "0 seconds") -> DataFrame:
    """(event_id, ts) of a stream's frames that are looked at, as :func:`paddock.operators.caps.throttled`."""
    rows = frames.withColumn(key, F.col(key).cast("string")).withColumn("hit", F.coalesce("hit", F.lit(False)))
    return folded(rows, key, _Looked(active_ms, idle_ms, idle_after), delay)


def shown_spells(rows: DataFrame, keep_ms: int, key: str = "user_id", delay: str = "0 seconds") -> DataFrame:
    """(key, begins, ends, n) of a stream (key, ts): spells during which a result is shown, each result for ``keep_ms``
    unless a newer one takes its place.  A spell comes out, and its state goes, when the watermark has passed its end.

    Spark joins sessions that touch, but a result is gone at its end: sessions are a microsecond shorter than results.
    """
    timed = rows.withColumn("_at", F.timestamp_millis("ts")).withWatermark("_at", delay)
    spells = timed.groupBy(key, F.session_window("_at", f"{keep_ms * 1000 - 1} microseconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return spells.select(key, F.unix_millis("w.start").alias("begins"), (F.unix_millis("w.end") + 1).alias("ends"), "n")
