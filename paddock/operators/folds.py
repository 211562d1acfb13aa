"""Folds over the rows of a key in order of time that hold no more than the last row let through.

A row is let through if the last one is long enough back; how long depends on a mode, a small number that changes with
each row let through.  A key's time is cut into parts, and a fold takes three steps: one task for each key and part notes
where a fold that enters the part leaves it, for ranges of what it may enter with; a pass over these ranges, in order
within a key, tells with what each part is entered; and with that each part is folded on its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.scratch import written

NONE = -(2**62)  #: the last time of a fold that has let nothing through
LEAST = -(2**63)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _numbers(column: pa.Array, empty: int | bool = 0) -> np.ndarray:
    return column.fill_null(empty).to_numpy(zero_copy_only=False)


class Tracks:
    """All folds that may enter a part, together: folds that have met go on as one.

    A fold that enters with (mode, last) is named by the range of ``last`` that begins at the same row.
    """

    def __init__(self, waits: list[int | None], after: tuple[list[int], list[int]], entries: int, first: int):
        self.waits, self.after, self.first = waits, after, first
        self.queues: list[deque] = [deque() for _ in waits]  # by mode: (last, ranges), in order of last
        self.upto = [LEAST] * entries

    def see(self, t: int, hit: bool) -> None:
        moved: dict[int, list] = {}
        for mode, wait in enumerate(self.waits):
            if wait is None:
                continue
            edge, to, queue = t - wait, self.after[hit][mode], self.queues[mode]
            while queue and queue[0][0] <= edge:
                a, b = moved.get(to, []), queue.popleft()[1]
                if len(a) < len(b):
                    a, b = b, a
                a.extend(b)
                moved[to] = a
            if mode < len(self.upto) and self.upto[mode] < min(edge, self.first):
                moved.setdefault(to, []).append((mode, self.upto[mode], edge))
                self.upto[mode] = edge
        for to, ranges in moved.items():
            self.queues[to].append((t, ranges))

    def due(self) -> int | None:
        """The least time at which a row changes anything; none will if None."""
        times = [queue[0][0] + wait for queue, wait in zip(self.queues, self.waits) if queue and wait is not None]
        times += [upto + wait + 1 for upto, wait in zip(self.upto, self.waits) if upto < self.first and wait is not None]
        return min(times, default=None)

    def see_all(self, times: list[int], hits: list[bool], i: int, end: int) -> None:
        """Rows i to end, in order of time; those that change nothing are stepped over."""
        while i < end:
            due = self.due()
            if due is None:
                return
            if times[i] < due:
                i = bisect_left(times, due, i, end)
                if i == end:
                    return
            self.see(times[i], hits[i])
            i += 1

    def ranges(self) -> list[tuple]:
        """(mode, above, upto, last, mode left with); neighbours with one result are one range."""
        out: list[tuple] = []
        for x in sorted((*r, last, to) for to, queue in enumerate(self.queues) for last, ranges in queue for r in ranges):
            if out and out[-1][0] == x[0] and out[-1][2] == x[1] and out[-1][3:] == x[3:]:
                out[-1] = (*out[-1][:2], *x[2:])
            else:
                out.append(x)
        return out


def let_through(rows: DataFrame, key: str, ts: str, order: str, part: Column, waits: list[int | None], after: tuple[list[int], list[int]], hit: Column | None = None, start: int = NONE, afresh: bool = False) -> DataFrame:
    """(order): the rows that a fold in order of (ts, order) within each key lets through; none without a time.

    ``waits`` is the least time since the last one by mode (None: never), ``after`` the next mode by mode, for rows
    that aren't a hit and for hits.  A fold starts in mode 0 as if one had passed at ``start``; with ``afresh`` it
    goes back to mode 0 in each part.  ``part`` must not fall as ``ts`` grows.
    """
    narrow = rows.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("k"), part.cast("long").alias("p"), F.col(ts).cast("long").alias("t"), F.col(order).cast("long").alias("o"), F.coalesce(hit if hit is not None else F.lit(False), F.lit(False)).alias("h"))
    narrow = written(narrow, "folded")  # read twice
    text, number = pa.string(), pa.int64()
    range_schema = pa.schema([("k", text), *[(c, number) for c in ("p", "mode", "above", "upto", "last", "next")]])
    entry_schema = pa.schema([("k", text), ("p", number), ("last", number), ("mode", number)])
    entries = 1 if afresh else len(waits)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run():
            at, tracks = None, None
            for batch in batches:
                keys, parts, times, hits = batch.columns
                codes, parts, times, hits = _numbers(keys.dictionary_encode().indices, -1), _numbers(parts), _numbers(times).tolist(), _numbers(hits, False).tolist()
                cuts = (np.flatnonzero((codes[1:] != codes[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist()
                for i, end in zip([0, *cuts], [*cuts, len(times)]):
                    if i == end:
                        continue
                    here = (keys[i].as_py(), int(parts[i]))
                    if here != at:
                        if tracks:
                            yield from ((*at, *r) for r in tracks.ranges())
                        at, tracks = here, Tracks(waits, after, entries, times[i])
                    tracks.see_all(times, hits, i, end)
            if tracks:
                yield from ((*at, *r) for r in tracks.ranges())

        return batches_of(run(), range_schema)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run():
            at = state = left = None
            for k, p, mode, above, upto, last, to in rows_of(batches):
                if at != (k, p):
                    state = left if at and at[0] == k else (start, 0)
                    if afresh:
                        state = (state[0], 0)
                    at, left = (k, p), state
                    yield k, p, *state
                if state[1] == mode and above < state[0] <= upto:
                    left = (last, to)

        return batches_of(run(), entry_schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mode = start, 0
        for batch in batches:
            is_row, times, ids, hits, ats, modes = batch.columns
            told = np.flatnonzero(_numbers(is_row) == 0).tolist()
            times, hits, through = _numbers(times).tolist(), _numbers(hits, False).tolist(), []
            for cut, end in zip([-1, *told], [*told, len(times)]):
                if cut >= 0:
                    last, mode = ats[cut].as_py(), modes[cut].as_py()
                i = cut + 1
                while i < end and waits[mode] is not None:
                    due = last + waits[mode]
                    if times[i] < due:
                        i = bisect_left(times, due, i, end)
                        if i == end:
                            break
                    through.append(i)
                    last, mode = times[i], after[hits[i]][mode]
                    i += 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(through, pa.int64()))], names=[order])

    ranges = narrow.select("k", "p", "t", "h", "o").repartition("k", "p").sortWithinPartitions("k", "p", "t", "o").select("k", "p", "t", "h").mapInArrow(leave, "k string, p long, mode long, above long, upto long, last long, next long")
    entered = ranges.repartition("k").sortWithinPartitions("k", "p", "mode", "above").mapInArrow(enter, "k string, p long, last long, mode long")
    null = F.lit(None)
    told = entered.select("k", "p", F.lit(0).alias("r"), null.cast("long").alias("t"), null.cast("long").alias("o"), null.cast("boolean").alias("h"), "last", "mode")
    each = narrow.select("k", "p", F.lit(1).alias("r"), "t", "o", "h", null.cast("long").alias("last"), null.cast("long").alias("mode"))
    both = told.unionByName(each).repartition("k", "p").sortWithinPartitions("k", "p", "r", "t", "o")
    return both.select("r", "t", "o", "h", "last", "mode").mapInArrow(fold, f"{order} long")
