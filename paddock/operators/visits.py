"""From sightings to visits: cooldown, entry and exit in turn, and corrections by hand.

The cooldown is a fold over a plate's sightings: one passes if the last one that passed is at least ``cooldown``
back (:mod:`paddock.operators.folds`).  What must be in order per plate is ordered by plate and day; a few rows per
plate and day then carry over what a day needs from the days around it, so that one plate with a large part of all
sightings is spread over as many tasks as it has days.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.text import stripped
from paddock.operators.folds import batches_of, let_through, rows_of
from paddock.scratch import written

COOLDOWN_MS = 90_000
KEY = "canonical"


def parking_only(sightings: DataFrame, mode_col: str = "mode") -> DataFrame:
    """Sightings made in parking mode; other modes record nothing."""
    return sightings.where(F.col(mode_col) == "PARKING").drop(mode_col)


PART_MS = 86_400_000  #: sightings are ordered within such stretches of time


def _days(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.withColumn("_part", F.expr(f"{ts} div {PART_MS}"))


def _around(rows: DataFrame, key: str, carried: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds columns that carry an aggregate of each (key, _part) over to other parts of the key: ``before`` gives the
    nearest earlier part's value that isn't null, ``after`` the nearest later one's, ``sum`` the sum of all earlier ones."""
    parts = rows.groupBy(key, "_part").agg(*[agg.alias(f"_{n}") for n, (agg, _) in carried.items()])
    by = Window.partitionBy(key).orderBy("_part")
    earlier, later = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    made = {
        "before": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "after": lambda c: F.first(c, ignorenulls=True).over(later),
        "sum": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
    }
    return rows.join(parts.select(key, "_part", *[made[how](f"_{n}").alias(n) for n, (_, how) in carried.items()]), [key, "_part"])


def passed(sightings: DataFrame, cooldown: int = COOLDOWN_MS, key: str = KEY, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The sightings that the cooldown lets through, by (ts, order) within a key; empty and null keys have none.
    ``order`` identifies a sighting."""
    known = sightings.where(F.coalesce(F.col(key), F.lit("")) != "")
    ids = let_through(known, key, ts, order, F.expr(f"{ts} div {PART_MS}"), [cooldown], ([0], [0]))
    return known.join(ids, order, "left_semi")


def records(sightings: DataFrame, cooldown: int = COOLDOWN_MS, key: str = KEY) -> DataFrame:
    """Passed sightings with ``kind``: ENTRY and EXIT in turn for each plate."""
    rows = _around(written(_days(passed(sightings, cooldown, key), key, "ts"), "passed"), key, {"_earlier": (F.count(F.lit(1)), "sum")})
    n = F.col("_earlier") + F.row_number().over(Window.partitionBy(key, "_part").orderBy("ts", "event_id"))
    return rows.withColumn("kind", F.when(n % 2 == 1, "ENTRY").otherwise("EXIT")).drop("_part", "_earlier")


def visits(sightings: DataFrame, cooldown: int = COOLDOWN_MS) -> DataFrame:
    """(id, plateNumber, canonicalPlate, isRegistered, entryAt, exitAt): registration as it was at the entry; id is
    the entry's event_id; exitAt is null while the vehicle is parked."""
    told = _around(_days(records(sightings, cooldown), KEY, "ts"), KEY, {"_next": (F.min("ts"), "after")})
    after = F.coalesce(F.lead("ts").over(Window.partitionBy(KEY, "_part").orderBy("ts", "event_id")), "_next")
    told = told.withColumn("exitAt", after).where("kind = 'ENTRY'")
    return told.select(F.col("event_id").alias("id"), stripped("raw_plate").alias("plateNumber"), F.col(KEY).alias("canonicalPlate"), F.col("is_registered").alias("isRegistered"), F.col("ts").alias("entryAt"), "exitAt")


def duration(entry: str = "entryAt", exit_: str = "exitAt") -> Column:
    """Milliseconds of a stay, at least 0; null unless both ends are known."""
    return F.when(F.col(entry).isNotNull() & F.col(exit_).isNotNull(), F.greatest(F.lit(0), F.col(exit_) - F.col(entry)))


def _with_before(rows: DataFrame, key: str, value: str, order: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Rows with ``_key``, their day (``_part``, by the first of ``order``, a time), and the value of the row before of the key,
    by day: a key with a large part of all rows is spread over as many tasks as it has days.  Structs make nulls equal."""
    first = F.col(order[0])
    is_ms = rows.schema[order[0]].dataType.simpleString() == "bigint"
    day = F.coalesce(F.expr(f"{order[0]} div {PART_MS}"), F.lit(-(2**62))) if is_ms else F.coalesce(first.cast("date"), F.lit("0001-01-01").cast("date"))
    told = written(rows.withColumn("_key", F.struct(key)).withColumn("_part", day), "told")
    by = Window.partitionBy("_key", "_part").orderBy(*order)
    parts = told.groupBy("_key", "_part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    parts = parts.select("_key", "_part", F.lag("_end").over(Window.partitionBy("_key").orderBy("_part"))[value].alias("_entered"))
    within = told.withColumn("_nth", F.row_number().over(by)).withColumn("_lag", F.lag(value).over(by))
    joined = within.join(parts, ["_key", "_part"])
    return joined, F.when(F.col("_nth") == 1, F.col("_entered")).otherwise(F.col("_lag"))


def consecutive(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Drops rows whose value equals that of the row before, per key."""
    told, before = _with_before(rows, key, value, order)
    return told.where(before.isNull() | (before != F.col(value))).select(rows.columns)


def confirmed(rows: DataFrame, key: str, value: str, *order: str, times: int = 1) -> DataFrame:
    """Rows at which a value has been seen ``times`` times in a row, per key (gaps and islands)."""
    told, before = _with_before(rows, key, value, order)
    told = told.withColumn("_changed", F.when(before == F.col(value), 0).otherwise(1))
    by = Window.partitionBy("_key", "_part").orderBy(*order)
    # rows since the last change of the day; before the first one they go on from the days before
    since = told.withColumn("_n", F.row_number().over(by)).withColumn("_at", F.max(F.when(F.col("_changed") == 1, F.col("_n"))).over(by))
    since = written(since, "islands")
    parts = since.groupBy("_key", "_part").agg(F.max("_n").alias("_size"), F.max("_at").alias("_open"))
    days = Window.partitionBy("_key").orderBy("_part")
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    upto = parts.withColumn("_total", F.sum("_size").over(days)).withColumn("_change", F.col("_total") - F.col("_size") + F.col("_open"))  # its place among all rows of the key
    upto = upto.select("_key", "_part", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.coalesce(F.max("_change").over(earlier), F.lit(1)) + 1).alias("_carried"))
    run = F.when(F.col("_at").isNotNull(), F.col("_n") - F.col("_at") + 1).otherwise(F.col("_n") + F.col("_carried"))
    return since.join(upto, ["_key", "_part"]).where(run >= times).select(rows.columns)


class Machine:
    """One plate's state: its visits, the open ones among them, and when the cooldown began.

    The same steps serve batches and streams.  Visits are named by the sighting that began them.
    """

    def __init__(self, cooldown: int = COOLDOWN_MS, last: int | None = None, visits: dict[int, list] | None = None):
        self.cooldown, self.last = cooldown, last
        self.visits: dict[int, list] = visits if visits is not None else {}  # id -> [plate, registered, entry, exit]
        self.open = {i for i, v in self.visits.items() if v[3] is None}

    def seen(self, event_id: int, ts: int, plate: str, registered: bool) -> tuple[str, int] | None:
        """ENTRY or EXIT with the visit's id; None within the cooldown (a clock that went back included)."""
        if self.last is not None and ts - self.last < self.cooldown:
            return None
        self.last = ts
        if self.open:
            latest = max(self.open)
            self.open.discard(latest)
            self.visits[latest][3] = ts
            return "EXIT", latest
        self.open.add(event_id)
        self.visits[event_id] = [plate, registered, ts, None]
        return "ENTRY", event_id

    def correct(self, action: str, visit_id: int, ts: int) -> None:
        """undo (an entry goes, an exit is taken back), convert (an entry was an exit; its arrival is unknown), close
        (an open visit ends) or delete; all but convert end the cooldown.  Unknown visits are left alone."""
        if action != "convert":
            self.last = None
        v = self.visits.get(visit_id)
        if v is None:
            return
        if action == "delete" or (action == "undo" and v[3] is None):
            del self.visits[visit_id]
            self.open.discard(visit_id)
        elif action == "undo":
            v[3] = None
            self.open.add(visit_id)
        elif action in ("convert", "close") and v[3] is None:
            self.open.discard(visit_id)
            if action == "close":
                v[3] = ts
            else:
                v[2], v[3] = None, v[2] if v[2] is not None else ts


class Ledger:
    """What corrections do to one plate's visits, told in stretches: the sightings let through between two corrections.

    The first of a stretch end the visits that are open, the latest (by id) first; those after begin and end visits in turn,
    and one may be open at the end.  So a stretch is known by its size and its last sighting, and only visits that are open
    or that a later correction names are held.  Sightings are named by their place among all of the plate's.
    """

    def __init__(self):
        self.visits: dict[int, list] = {}  # id -> [its place, place of its end, time of its end, has no entry]
        self.open: set[int] = set()
        self.latest: list[int] = []  # heap of negative ids; some aren't open any more
        self.named: set[int] = set()
        self.first = self.skipped = 0

    def _opens(self, i: int) -> None:
        self.visits[i][1:3] = [None, None]
        self.open.add(i)
        heapq.heappush(self.latest, -i)

    def stretch(self, first: int, n: int, last_id: int) -> Iterator[tuple]:
        """Visits that its sightings end and no correction names any more."""
        self.first, self.skipped = first, 0
        while self.open and self.skipped < n:
            i = -heapq.heappop(self.latest)
            if i in self.open:
                self.open.discard(i)
                self.visits[i][1] = first + self.skipped
                self.skipped += 1
                if i not in self.named:
                    yield self.leave(i)
        if (n - self.skipped) % 2:
            self.visits[last_id] = [first + n - 1, None, None, False]
            self._opens(last_id)

    def name(self, i: int, place: int) -> None:
        """A sighting of the stretch that a later correction names; nothing if it didn't begin a visit."""
        nth = place - self.first - self.skipped
        if nth >= 0 and nth % 2 == 0:
            self.named.add(i)
            self.visits.setdefault(i, [place, place + 1, None, False])

    def correct(self, action: str | None, i: int, ts: int, final: bool) -> Iterator[tuple]:
        """As :meth:`Machine.correct`; ``final`` is the last correction that names the visit."""
        v, is_open = self.visits.get(i), i in self.open
        if v is None or i not in self.named:
            return
        if action == "delete" or (action == "undo" and is_open):
            self.open.discard(i)
            self.named.discard(i)
            del self.visits[i]
            yield i, True, None, None, None
            return
        if action == "undo":
            self._opens(i)
        elif action in ("convert", "close") and is_open:
            self.open.discard(i)
            if action == "close" or v[3]:
                v[2] = ts
            else:
                v[1], v[3] = v[0], True
        if final:
            self.named.discard(i)
            if i not in self.open:
                yield self.leave(i)

    def leave(self, i: int) -> tuple:
        """(id, gone, has no entry, place of its end, time of its end)"""
        _, place, ts, entered_unknown = self.visits.pop(i)
        return i, False, entered_unknown, place, ts

    def rest(self) -> Iterator[tuple]:
        for i in list(self.visits):
            yield self.leave(i)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A plate's corrections, stretches and named sightings in order, to visits that differ from what their stretch tells
    (KEY, id, gone, no_entry, place, ended) and each stretch's first and number of ends (KEY, stretch, first, skipped)."""

    def run():
        key, book = None, None
        for k, stretch, kind, i, n, place, ts, action, final in rows_of(batches):
            if k != key:
                if book:
                    yield from ((key, *v, None, None, None) for v in book.rest())
                key, book = k, Ledger()
            if kind == 0:
                yield from ((k, *v, None, None, None) for v in book.correct(action, i, ts, final))
            elif kind == 1:
                yield from ((k, *v, None, None, None) for v in book.stretch(place, n, i))
                yield k, None, None, None, None, None, stretch, place, book.skipped
            else:
                book.name(i, place)
        if book:
            yield from ((key, *v, None, None, None) for v in book.rest())

    number, flag = pa.int64(), pa.bool_()
    names = [(KEY, pa.string()), ("id", number), ("gone", flag), ("no_entry", flag), ("place", number), ("ended", number), ("stretch", number), ("first", number), ("skipped", number)]
    return batches_of(run(), pa.schema(names))


def corrected(sightings: DataFrame, corrections: DataFrame, cooldown: int = COOLDOWN_MS) -> DataFrame:
    """Visits as in :func:`visits`, after corrections (event_id, ts, action, visit_id, canonical) took their turn.

    Corrections at the time of a sighting come after it; those without a plate, a time or a visit are left out, and so
    are sightings without a time.  Whether a sighting passes follows from times alone (all corrections but convert end the cooldown), so
    that fold runs by plate, count of such corrections and day.  Between two corrections a plate's sightings take
    one row in the only step that takes a plate's corrections in turn (:class:`Ledger`).
    """
    known = sightings.where((F.coalesce(F.col(KEY), F.lit("")) != "") & F.col("ts").isNotNull())
    told = corrections.where(f"{KEY} <> '' and ts is not null and visit_id is not null")
    told = told.select(KEY, F.col("ts").cast("long").alias("ts"), F.lit(1).alias("turn"), F.col("event_id").cast("long").alias("event_id"), "action", F.col("visit_id").cast("long").alias("visit_id"))
    seen = known.select(KEY, F.col("ts").cast("long").alias("ts"), F.lit(0).alias("turn"), F.col("event_id").cast("long").alias("event_id"), stripped("raw_plate").alias("plate"), F.col("is_registered").alias("registered"))

    # each row's stretch: the corrections up to it, those of days before in a row per day
    rows = written(_days(seen.unionByName(told, allowMissingColumns=True), KEY, "ts"), "turns")
    by = Window.partitionBy(KEY, "_part").orderBy("ts", "turn", "event_id", "visit_id", "action").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_told, ends = F.sum("turn"), F.sum(F.when((F.col("turn") == 1) & ~F.col("action").eqNullSafe("convert"), 1).otherwise(0))
    rows = _around(rows, KEY, {"_told": (is_told, "sum"), "_ended": (ends, "sum")})
    rows = rows.withColumn("stretch", F.col("_told") + is_told.over(by)).withColumn("_fold", F.concat_ws(":", F.col("_ended") + ends.over(by), KEY))
    rows = written(rows.drop("_told", "_ended"), "stretches")

    ids = let_through(rows.where("turn = 0"), "_fold", "ts", "event_id", F.col("_part"), [cooldown], ([0], [0]))
    through = _around(written(rows.where("turn = 0").join(ids, "event_id", "left_semi"), "passed"), KEY, {"_earlier": (F.count(F.lit(1)), "sum"), "_next": (F.min("ts"), "after")})
    by = Window.partitionBy(KEY, "_part").orderBy("ts", "event_id")
    through = through.withColumn("place", F.col("_earlier") + F.row_number().over(by)).withColumn("next", F.coalesce(F.lead("ts").over(by), "_next"))
    through = written(through.select(KEY, "stretch", "place", "event_id", "ts", "next", "plate", "registered"), "through")

    fixes = rows.where("turn = 1").select(KEY, "stretch", "visit_id", "ts", "action")
    named = fixes.groupBy(KEY, "visit_id").agg(F.max("stretch").alias("until"))
    null = lambda kind: F.lit(None).cast(kind)
    fixed = fixes.join(named, [KEY, "visit_id"]).select(KEY, "stretch", F.lit(0).alias("kind"), F.col("visit_id").alias("i"), null("long").alias("n"), null("long").alias("place"), "ts", "action", (F.col("stretch") == F.col("until")).alias("final"))
    wide = [null("long").alias("ts"), null("string").alias("action"), null("boolean").alias("final")]
    stretches = through.groupBy(KEY, "stretch").agg(F.max_by("event_id", "place").alias("i"), F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    stretches = stretches.select(KEY, "stretch", F.lit(1).alias("kind"), "i", "n", "place", *wide)
    begun = through.join(named.withColumnRenamed("visit_id", "event_id"), [KEY, "event_id"]).where("until > stretch")
    begun = begun.select(KEY, "stretch", F.lit(2).alias("kind"), F.col("event_id").alias("i"), null("long").alias("n"), "place", *wide)
    turns = fixed.unionByName(stretches).unionByName(begun).repartition(KEY).sortWithinPartitions(KEY, "stretch", "kind", "place")
    settled = written(turns.mapInArrow(_settled, f"{KEY} string, id long, gone boolean, no_entry boolean, place long, ended long, stretch long, first long, skipped long"), "settled")

    places = through.select(KEY, "place", F.col("ts").alias("_at"))
    odd = settled.where("id is not null").join(places, [KEY, "place"], "left")
    odd = odd.select(KEY, F.col("id").alias("event_id"), "gone", "no_entry", F.coalesce("ended", "_at").alias("_exit"))
    began = through.join(settled.where("id is null").select(KEY, "stretch", "first", "skipped"), [KEY, "stretch"])
    nth = F.col("place") - F.col("first") - F.col("skipped")
    began = began.where((nth >= 0) & (nth % 2 == 0)).join(odd, [KEY, "event_id"], "left").where("not coalesce(gone, false)")
    exit_at = F.when(F.col("gone").isNull(), F.col("next")).otherwise(F.col("_exit"))
    entry_at = F.when(~F.coalesce("no_entry", F.lit(False)), F.col("ts"))
    return began.select(F.col("event_id").alias("id"), F.col("plate").alias("plateNumber"), F.col(KEY).alias("canonicalPlate"), F.col("registered").alias("isRegistered"), entry_at.alias("entryAt"), exit_at.alias("exitAt"))
