"""Keyed folds over a stream in order of event time.

Rows wait in their key's state until the watermark has passed them and are then taken in order, so results don't depend on
how a stream falls into micro-batches, or on rows that overtake each other by less than the watermark's delay.
A timer at the first waiting row's time wakes the key; others wake it when parts of its state can go.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: Timers and state of several kinds need this store; its files are in the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What a stream does with a key's rows.  ``state`` is a dict from names to tuples (of the schema ``entry``); a fold
    changes it in place."""

    #: schemas of a row's values (the time first), of what the state holds under a name, and of what comes out
    row: str
    entry: str
    out: str

    def order(self, row: tuple) -> tuple:
        """The order of rows of a key; the time must lead."""
        return row

    def step(self, key: Any, state: dict[int, tuple], row: tuple) -> Iterator[tuple]:
        """Takes one row; yields what comes out."""
        raise NotImplementedError

    def until(self, name: int, entry: tuple) -> int | None:
        """The time from which on an entry makes no difference any more; None: it stays."""
        return None


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, names: list[str]):
        self.fold, self.names = fold, names
        self.kinds = [{"long": int, "boolean": bool}.get(c.split()[1], str) for c in fold.row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fold.row)
        self.held = handle.getMapState("held", "name long", self.fold.entry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # numbers of a column with nulls come as floats, and the state takes nothing but what its schema says
        new = [tuple(None if pd.isna(x) else kind(x) for x, kind in zip(r, self.kinds)) for part in rows for r in part[self.names].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(int(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in rows if r[0] <= now), key=self.fold.order)
        if due:
            rest = [tuple(r) for r in rows if r[0] > now]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(int(min(r[0] for r in rest)))
            else:
                self.waiting.clear()
        state = {int(k[0]): tuple(v) for k, v in self.held.iterator()} if self.held.exists() else {}
        before, told = dict(state), []
        for row in due:
            told.extend(self.fold.step(key[0], state, row))
        ends = {name: self.fold.until(name, entry) for name, entry in state.items()}
        for name, end in ends.items():
            if end is not None and end <= now:
                del state[name]
            elif end is not None and before.get(name) != state[name]:
                self.handle.registerTimer(int(end))
        for name in before.keys() - state.keys():
            self.held.removeKey((name,))
        for name, entry in state.items():
            if before.get(name) != entry:
                self.held.updateValue((name,), entry)
        if told:
            columns = [c.split() for c in self.fold.out.split(", ")]
            yield pd.DataFrame({name: pd.Series([t[i] for t in told], dtype={"long": "Int64", "boolean": "boolean"}.get(kind, "object")) for i, (name, kind) in enumerate(columns)})

    def close(self) -> None:
        pass


def folded(rows: DataFrame, key: str, fold: Fold, delay: str = "0 seconds") -> DataFrame:
    """What ``fold`` gives for a stream of ``rows`` with ``key`` (a string) and the fold's columns.

    Rows whose time or key is null are dropped, and so are those that come more than ``delay`` later than others.
    What comes out waits until the watermark has passed it.  Sets the session's state store to RocksDB.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    names = [c.split()[0] for c in fold.row.split(", ")]
    known = rows.where(F.col(key).isNotNull() & F.col(names[0]).isNotNull()).select(key, *names).withColumn("_at", F.timestamp_millis(names[0])).withWatermark("_at", delay)
    # Spark also makes the processor in a Python of the driver's own, which files that were sent to the executors don't reach:
    # it takes the code along, and not by name
    library = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(library)
    try:
        return known.groupBy(key).transformWithStateInPandas(_Processor(fold, names), fold.out, "Append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(library)
