"""The visit machine over a stream of sightings, and live reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paddock.functions.text import stripped
from paddock.operators.visits import COOLDOWN_MS, KEY, Machine
from paddock.streaming.ordered import Fold, folded

RECORDS = "canonical string, kind string, visit_id long, ts long, plate string, registered boolean, duration_ms long"
STATE = "last long, visit_id long, plate string, registered boolean, entry long"


def visit_records(sightings: DataFrame, cooldown: int = COOLDOWN_MS) -> DataFrame:
    """ENTRY and EXIT records of a stream (event_id, ts, raw_plate, canonical, is_registered).

    A plate's state is its cooldown and its open visit.  Sightings of a micro-batch are taken in order of
    (ts, event_id); one older than the plate's last record falls within the cooldown and is dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, visit, plate, registered, entry = state.get if state.exists else [None] * 5
        machine = Machine(cooldown, last, {} if visit is None else {visit: [plate, registered, entry, None]})
        rows, out = pd.concat(list(parts)).sort_values(["ts", "event_id"]), []
        for r in rows.itertuples(index=False):
            told = machine.seen(int(r.event_id), int(r.ts), r.raw_plate, bool(r.is_registered))
            if told:
                kind, visit = told
                plate, registered, entry, exit_ = machine.visits[visit]
                out.append((key[0], kind, visit, int(r.ts), plate, registered, max(0, exit_ - entry) if kind == "EXIT" else None))
                if kind == "EXIT":
                    del machine.visits[visit]
        visit, v = next(iter(machine.visits.items()), (None, [None] * 4))
        state.update((machine.last, visit, v[0], v[1], v[2]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
        yield frame.astype({"visit_id": "int64", "ts": "int64", "duration_ms": "Int64"})

    known = sightings.where(F.coalesce(F.col(KEY), F.lit("")) != "").select("event_id", "ts", stripped("raw_plate").alias("raw_plate"), KEY, "is_registered")
    return known.groupBy(KEY).applyInPandasWithState(run, RECORDS, STATE, "append", "NoTimeout")


def write_records(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing records as Parquet, everything that is there by now."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_parked(records: DataFrame, *by: str) -> DataFrame:
    """The number of parked vehicles (by registration or the like), kept up to date (complete or update mode)."""
    change = F.when(F.col("kind") == "ENTRY", 1).otherwise(-1)
    return records.groupBy(*by).agg(F.sum(change).alias("parked"))


KEEP_MS = 7 * 86_400_000  #: how long after its end a visit can still be corrected
CHANGES = "canonical string, visit_id long, gone boolean, plate string, registered boolean, entered long, gone_at long, ms long, turn long, event_id long"


class _Corrected(Fold):
    """The visit machine over sightings and corrections.  Its state holds each visit that may still change under its id, and
    under -1 the time from which the cooldown counts."""

    row = "ms long, turn long, event_id long, plate string, registered boolean, action string, visit_id long"
    entry = "plate string, registered boolean, entered long, gone_at long"
    out = CHANGES
    COOLDOWN = -1

    def __init__(self, cooldown: int, keep: int):
        self.cooldown, self.keep = cooldown, keep

    def order(self, row: tuple) -> tuple:
        return row[:3]

    def step(self, key: str, state: dict[int, tuple], row: tuple) -> Iterator[tuple]:
        ms, turn, event_id, plate, registered, action, named = row
        machine = Machine(self.cooldown, state[self.COOLDOWN][2] if self.COOLDOWN in state else None, {i: list(v) for i, v in state.items() if i != self.COOLDOWN})
        if turn:
            machine.correct(action, named, ms)
            changed = named if named in state else None
        else:
            told = machine.seen(event_id, ms, plate, bool(registered))
            changed = told[1] if told else None
        state.pop(self.COOLDOWN, None)
        if machine.last is not None:
            state[self.COOLDOWN] = (None, None, machine.last, None)
        if changed is not None:
            v = machine.visits.get(changed)
            if v is None:
                del state[changed]
            else:
                state[changed] = tuple(v)
            yield (key, changed, v is None, *(v or (None,) * 4), ms, turn, event_id)

    def until(self, name: int, entry: tuple) -> int | None:
        """A cooldown ends; a visit that has ended can be corrected for a while."""
        if name == self.COOLDOWN:
            return entry[2] + self.cooldown
        return None if entry[3] is None else entry[3] + self.keep


def turns(sightings: DataFrame, corrections: DataFrame) -> DataFrame:
    """Sightings (event_id, ts, raw_plate, canonical, is_registered) and corrections (event_id, ts, action, visit_id, canonical)
    as one stream; at the same time a correction comes after a sighting."""
    null = lambda kind: F.lit(None).cast(kind)
    seen = sightings.select(KEY, F.col("ts").alias("ms"), F.lit(0).cast("long").alias("turn"), F.col("event_id").cast("long").alias("event_id"), stripped("raw_plate").alias("plate"), F.col("is_registered").alias("registered"), null("string").alias("action"), null("long").alias("visit_id"))
    told = corrections.select(KEY, F.col("ts").alias("ms"), F.lit(1).cast("long").alias("turn"), F.col("event_id").cast("long").alias("event_id"), null("string").alias("plate"), null("boolean").alias("registered"), "action", F.col("visit_id").cast("long").alias("visit_id"))
    return seen.unionByName(told)


def visit_changes(events: DataFrame, cooldown: int = COOLDOWN_MS, keep_ms: int = KEEP_MS, delay: str = "0 seconds") -> DataFrame:
    """Every change of a visit by a stream of :func:`turns`: what the visit is from then on, or that it is ``gone``.

    Events are taken in order of time, a plate's state holds its cooldown while it lasts, its open visits, and those that
    ended less than ``keep_ms`` ago; a vehicle that left long ago holds none.  Later corrections of a visit are ignored.
    """
    return folded(events.where(F.col(KEY) != ""), KEY, _Corrected(cooldown, keep_ms), delay)


def visits_of(changes: DataFrame) -> DataFrame:
    """Visits (as in :func:`paddock.operators.visits.visits`) as their last changes leave them."""
    last = changes.groupBy("canonical", "visit_id").agg(F.max_by(F.struct("gone", "plate", "registered", "entered", "gone_at"), F.struct("ms", "turn", "event_id")).alias("v")).where(~F.col("v.gone"))
    return last.select(F.col("visit_id").alias("id"), F.col("v.plate").alias("plateNumber"), F.col("canonical").alias("canonicalPlate"), F.col("v.registered").alias("isRegistered"), F.col("v.entered").alias("entryAt"), F.col("v.gone_at").alias("exitAt"))
