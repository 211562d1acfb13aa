"""Reports over visits: who is parked, what a day held, labels and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.operators.visits import duration

DAY_MS = 86_400_000


def parked(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("exitAt").isNull())


def parked_count(visits: DataFrame) -> DataFrame:
    return visits.agg(F.count_if(F.col("exitAt").isNull()).alias("parked"))


def open_visits(visits: DataFrame) -> DataFrame:
    """The latest open visit (by id) of each plate."""
    latest = parked(visits).groupBy("canonicalPlate").agg(F.max_by(F.struct("id", "plateNumber", "isRegistered", "entryAt"), "id").alias("v"))
    return latest.select("canonicalPlate", "v.*")


def on_day(start: Column, end: Column) -> Column:
    """Whether a visit touches [start, end): begun before its end and not ended before its start (an exit at the
    start counts); without a known entry, ended within it.  A visit without either end touches no day."""
    entry, exit_ = F.col("entryAt"), F.col("exitAt")
    begun = entry.isNotNull() & (entry < end) & (exit_.isNull() | (exit_ >= start))
    orphan = entry.isNull() & (exit_ >= start) & (exit_ < end)
    return F.coalesce(begun | orphan, F.lit(False))


def visits_for_day(visits: DataFrame, start_ms: int) -> DataFrame:
    """Latest first, by exit, else entry; ties by id."""
    return visits.where(on_day(F.lit(start_ms), F.lit(start_ms + DAY_MS))).orderBy(F.coalesce("exitAt", "entryAt").desc(), F.desc("id"))


def by_first_instant(visits: DataFrame) -> DataFrame:
    return visits.orderBy(F.coalesce("entryAt", "exitAt").asc(), "id")


def visit_days(visits: DataFrame, horizon_ms: int) -> DataFrame:
    """A row for each day (start in ms, UTC) that a visit touches; open visits run to the day of ``horizon_ms``.

    Days are listed per visit, which joins days to visits by equality where a range join would compare all pairs.
    """
    entry, exit_ = F.col("entryAt"), F.col("exitAt")
    first = F.floor(F.coalesce(entry, exit_) / DAY_MS)
    last = F.when(entry.isNull(), first).otherwise(F.floor(F.coalesce(exit_, F.lit(horizon_ms)) / DAY_MS))
    listed = visits.where("entryAt is not null or exitAt is not null").withColumn("_first", first).withColumn("_last", last)
    each = listed.where("_first <= _last").withColumn("_day", F.explode(F.sequence("_first", "_last")))  # a reversed stay touches none
    return each.withColumn("day", F.col("_day") * DAY_MS).drop("_first", "_last", "_day")


def counts_by_day(visits: DataFrame, horizon_ms: int) -> DataFrame:
    """(day, n, ids): how many visits touch each day as in :func:`visit_days`, and the sum of their ids.

    A visit adds one at its first day and takes it back after its last, so the work follows the visits and the
    days, not the days that visits span.  Days without visits are left out.
    """
    entry, exit_ = F.col("entryAt"), F.col("exitAt")
    first = F.floor(F.coalesce(entry, exit_) / DAY_MS)
    last = F.when(entry.isNull(), first).otherwise(F.floor(F.coalesce(exit_, F.lit(horizon_ms)) / DAY_MS))
    spans = visits.where("entryAt is not null or exitAt is not null").select("id", first.alias("first"), last.alias("last")).where("first <= last")
    begins = spans.select(F.col("first").alias("day"), F.lit(1).alias("n"), F.col("id").alias("ids"))
    ends = spans.select((F.col("last") + 1).alias("day"), F.lit(-1).alias("n"), (-F.col("id")).alias("ids"))
    steps = begins.unionByName(ends).groupBy("day").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))  # a row per day
    upto = Window.orderBy("day")
    level = steps.select("day", F.lead("day").over(upto).alias("next"), F.sum("n").over(upto).alias("n"), F.sum("ids").over(upto).alias("ids"))
    each = level.where("n > 0").select(F.explode(F.sequence("day", F.col("next") - 1)).alias("day"), "n", "ids")
    return each.select((F.col("day") * DAY_MS).alias("day"), "n", "ids")


def day_summary(visits: DataFrame, start_ms: int) -> DataFrame:
    """(entered, exited, parked, stays, average_ms, total_ms) of the visits of a day; durations aren't clipped to it,
    the average drops fractions, both are null where they say nothing."""
    day = visits.where(on_day(F.lit(start_ms), F.lit(start_ms + DAY_MS))).withColumn("_ms", duration())
    within = lambda c: F.count_if((F.col(c) >= start_ms) & (F.col(c) < start_ms + DAY_MS))
    sums = day.agg(within("entryAt").alias("entered"), within("exitAt").alias("exited"), F.count_if(F.col("exitAt").isNull()).alias("parked"), F.count("_ms").alias("stays"), F.sum("_ms").alias("_total"))
    return sums.select("entered", "exited", "parked", "stays", F.expr("_total div nullif(stays, 0)").alias("average_ms"), F.when(F.col("_total") > 0, F.col("_total")).alias("total_ms"))


def duration_text(ms: Column) -> Column:
    """Hours and minutes, minutes dropped at full hours and hours below one."""
    minutes = F.floor(ms / 60_000)
    h, m = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return F.when(ms.isNull(), None).when(minutes < 60, F.concat(m, F.lit("분"))).when(minutes % 60 == 0, F.concat(h, F.lit("시간"))).otherwise(F.concat(h, F.lit("시간 "), m, F.lit("분")))


def clock(ms: str, pattern: str) -> Column:
    """A time in the session's zone."""
    return F.date_format(F.timestamp_millis(F.col(ms)), pattern)


def day_start(ms: Column) -> Column:
    """Midnight (ms) of a moment's day in the session's zone."""
    return F.unix_millis(F.date_trunc("day", F.timestamp_millis(ms)))


def day_label(ms: Column) -> Column:
    ts = F.timestamp_millis(ms)
    weekday = F.element_at(F.array(*map(F.lit, "일월화수목금토")), F.dayofweek(ts))
    return F.concat(F.date_format(ts, "yyyy년 M월 d일 ("), weekday, F.lit(")"))


def may_go_forward(day_ms: Column, now_ms: Column) -> Column:
    """Whether a day after the shown one may be asked for: not beyond today."""
    return day_start(day_ms) < day_start(now_ms)


def status_label(now_ms: int) -> Column:
    """A finished stay's duration; of an open one whether it is parked, or stale after 24 hours."""
    ms = duration()
    return (
        F.when(ms.isNotNull(), duration_text(ms))
        .when(F.col("exitAt").isNull() & (now_ms - F.col("entryAt") > DAY_MS), "미확인")
        .when(F.col("exitAt").isNull(), "주차 중")
        .otherwise("—")
    )


def span_label() -> Column:
    entry = F.coalesce(clock("entryAt", "HH:mm"), F.lit("입차 미확인"))
    return F.when(F.col("exitAt").isNull(), F.concat(entry, F.lit(" →"))).otherwise(F.concat(entry, F.lit(" → "), clock("exitAt", "HH:mm")))


def export_lines(visits: DataFrame) -> DataFrame:
    """(position, line): the export's lines in order of the first known instant, without its header; unknown parts
    are empty and nothing is quoted.  ``position`` orders them."""
    minutes = F.floor(duration() / 60_000).cast("string")
    part = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws(
        ",",
        "canonicalPlate",
        F.when(F.col("isRegistered"), "등록").otherwise("미등록"),
        part(clock("entryAt", "yyyy-MM-dd HH:mm")),
        part(clock("exitAt", "yyyy-MM-dd HH:mm")),
        part(minutes),
    )
    return visits.select(F.coalesce("entryAt", "exitAt").alias("position"), "id", line.alias("line"))
