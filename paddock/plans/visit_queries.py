"""Queries of visits, reports and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.operators import caps, lookup, report
from paddock.operators import visits as V
from paddock.plans.carrier import REGISTRY_SQL, SIGHTINGS_SQL, VISITS_SQL, millis, registry, registry_rows, sightings, table, visits
from paddock.plans.lookup_queries import BASE, RESOLVED_SQL
from paddock.scratch import scratch_path, written
from paddock.streaming import limits_stream, live, visits_stream

LONG_COOLDOWN = 6 * 3_600_000
DAY, NOW = 1_704_672_000_000, 1_706_745_600_000  # 2024-01-08 and 2024-02-01, UTC
ORDER_DAY = 820_454_400_000  # 1996-01-01, amid the orders


def _resolved(spark, sf_dir):
    return written(lookup.resolve(sightings(spark, sf_dir), registry(spark, sf_dir)), "resolved")


def _by_user(spark, sf_dir):
    return sightings(spark, sf_dir).select("event_id", "ts", F.col("user_id").cast("string").alias("canonical"))


def visits_cooldown(spark, sf_dir):
    return V.passed(_by_user(spark, sf_dir)).select("event_id", "canonical", "ts")


def visits_cooldown_long(spark, sf_dir):
    return V.records(_by_user(spark, sf_dir), LONG_COOLDOWN).select("event_id", "canonical", "ts", "kind")


def visits_toggle(spark, sf_dir):
    return V.visits(_resolved(spark, sf_dir)).withColumn("durationMs", V.duration())


def _corrections(seen):
    """A minute after each entry, one of the four corrections."""
    action = F.element_at(F.array(*map(F.lit, ("undo", "convert", "close", "delete"))), (F.col("event_id") % 4 + 1).cast("int"))
    told = V.visits(seen).select(F.col("id").alias("event_id"), (F.col("entryAt") + 60_000).alias("ts"), F.col("id").alias("visit_id"), F.col("canonicalPlate").alias("canonical"))
    return told.withColumn("action", action)


def visits_corrections(spark, sf_dir):
    seen = _resolved(spark, sf_dir)
    return V.corrected(seen, _corrections(seen)).withColumn("durationMs", V.duration())


def _stream(spark, sf_dir, name):
    """A table as a stream, all of it in one batch."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _as_stream(spark, rows, name):
    """Rows written and read as a stream."""
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(spark, frame):
    """All that a stream appends, read back."""
    base = scratch_path(spark, "stream")
    visits_stream.write_records(frame, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/out")


def visits_stream_corrections(spark, sf_dir):
    """Sightings and corrections by hand as one stream: undo, convert, close and delete in the keyed state."""
    seen = _resolved(spark, sf_dir)
    turns = _as_stream(spark, visits_stream.turns(seen, _corrections(seen)), "turns")
    return visits_stream.visits_of(_drained(spark, visits_stream.visit_changes(turns))).withColumn("durationMs", V.duration())


def _event_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type", millis("ts").alias("ts"))


def captures_spaced_stream(spark, sf_dir):
    """Captures of a user at least six hours apart."""
    return _drained(spark, limits_stream.spaced(_event_stream(spark, sf_dir), LONG_COOLDOWN))


def result_spells_stream(spark, sf_dir):
    """Spells during which a user's results are shown, each for three hours."""
    return _drained(spark, limits_stream.shown_spells(_event_stream(spark, sf_dir), 3 * 3_600_000))


def frequency_cap_stream(spark, sf_dir):
    asks = _event_stream(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 3 == 0, "open").otherwise("ask"))
    return _drained(spark, limits_stream.granted(asks, gap_ms=2 * 3_600_000, per_day=2))


def adaptive_throttle_stream(spark, sf_dir):
    frames = _event_stream(spark, sf_dir).withColumn("hit", F.col("event_type") == "purchase")
    return _drained(spark, limits_stream.looked(frames, active_ms=3_600_000, idle_ms=14_400_000, idle_after=3))


def _visit_records(spark, sf_dir):
    u = F.col("user_id")
    seen = _event_stream(spark, sf_dir).select("event_id", "ts", u.cast("string").alias("raw_plate"), u.cast("string").alias("canonical"), (u % 4 != 3).alias("is_registered"))
    return visits_stream.visit_records(seen, LONG_COOLDOWN)


def live_parked(spark, sf_dir):
    """Parked vehicles, registered and not, kept up to date over the stream of records."""
    base = scratch_path(spark, "live")
    records = _as_stream(spark, _drained(spark, _visit_records(spark, sf_dir)), "records")
    live.keep_current(visits_stream.live_parked(records, "registered"), f"{base}/parked", f"{base}/checkpoint").awaitTermination()
    return live.current(spark, f"{base}/parked", ["registered"], "registered boolean, parked long")


def live_plates(spark, sf_dir):
    """The registry's list, newest first, kept up to date: plates are added, noted anew a day later, and some removed."""
    base = scratch_path(spark, "live")
    i = F.col("id")
    added = registry_rows(spark, sf_dir).select("plateNumber", "id", "note", "createdAt", F.lit(False).alias("removed"), F.col("createdAt").alias("changed_at"))
    noted = added.where(i % 3 == 0).select("plateNumber", "id", F.concat("note", F.lit(" *")).alias("note"), "createdAt", "removed", (F.col("changed_at") + 86_400_000).alias("changed_at"))
    removed = added.where(i % 7 == 0).select("plateNumber", "id", "note", "createdAt", F.lit(True).alias("removed"), (F.col("changed_at") + 2 * 86_400_000).alias("changed_at"))
    changes = _as_stream(spark, added.unionByName(noted).unionByName(removed), "changes")
    live.keep_current(live.newest_plates(changes), f"{base}/plates", f"{base}/checkpoint").awaitTermination()
    kept = live.current(spark, f"{base}/plates", ["plateNumber"], "plateNumber string, id long, note string, createdAt long, removed boolean")
    return live.newest_first(kept)


ANSWER_MS, WAIT_MS, LAST_MS = 20 * 86_400_000, 3_600_000, 4_102_444_800_000


def _answers(spark, sf_dir):
    """For each text that was seen, an answer some minutes after it was first seen; every fifth text gets none."""
    first = _resolved(spark, sf_dir).groupBy("raw_plate").agg(F.min(F.struct("ts", "event_id")).alias("f"), F.min_by("canonical", "event_id").alias("canonical"), F.min_by("is_registered", "event_id").alias("is_registered"))
    return first.where("f.event_id % 5 <> 0").select("raw_plate", (F.col("f.ts") + F.col("f.event_id") % 100 * 60_000).alias("answered_at"), "canonical", "is_registered")


def detections_pending_stream(spark, sf_dir):
    """Detections shown with the answer that the registry gives in time, or else as pending."""
    # a last detection and a last answer, of other texts, move the watermark past all others
    last = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(LAST_MS).cast("long").alias("ts"), F.lit("").alias("raw_plate"))
    said = last.select(F.lit(" ").alias("raw_plate"), F.col("ts").alias("answered_at"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("boolean").alias("is_registered"))
    seen = _as_stream(spark, sightings(spark, sf_dir).select("event_id", "ts", "raw_plate").unionByName(last), "detections")
    answers = _as_stream(spark, _answers(spark, sf_dir).unionByName(said), "answers")
    return _drained(spark, live.answered(seen, answers, ANSWER_MS, WAIT_MS)).where("event_id >= 0")


def visits_stream_records(spark, sf_dir):
    """The machine over the events read as a stream, its records read back."""
    return _drained(spark, _visit_records(spark, sf_dir))


def parked_now(spark, sf_dir):
    return report.parked_count(visits(spark, sf_dir))


def open_visit_latest(spark, sf_dir):
    return report.open_visits(visits(spark, sf_dir))


def visits_for_day(spark, sf_dir):
    return report.visits_for_day(visits(spark, sf_dir), ORDER_DAY).select("id", "canonicalPlate", "entryAt", "exitAt")


def visits_by_day(spark, sf_dir):
    return report.counts_by_day(visits(spark, sf_dir), NOW)


def day_summary(spark, sf_dir):
    return report.day_summary(visits(spark, sf_dir), ORDER_DAY)


def visit_status_labels(spark, sf_dir):
    rows = visits(spark, sf_dir)
    return rows.select("id", report.status_label(NOW).alias("status"), report.span_label().alias("span"))


def visits_export_rows(spark, sf_dir):
    return report.export_lines(visits(spark, sf_dir))


def day_labels(spark, sf_dir):
    seen = sightings(spark, sf_dir)
    return seen.select("event_id", report.day_label(F.col("ts")).alias("label"), report.day_start(F.col("ts")).alias("day_start"), report.may_go_forward(F.col("ts"), F.lit(DAY)).alias("forward"), F.expr("ts div 86400000").alias("utc_day"))


def _asks(spark, sf_dir):
    return sightings(spark, sf_dir).select("event_id", "ts", "user_id", F.when(F.col("event_id") % 3 == 0, "open").otherwise("ask").alias("kind"))


def frequency_cap(spark, sf_dir):
    return caps.allowed(_asks(spark, sf_dir), gap_ms=2 * 3_600_000, per_day=2)


def daily_event_counts(spark, sf_dir):
    return caps.daily_counts(sightings(spark, sf_dir))


def recent_top5(spark, sf_dir):
    return caps.latest(sightings(spark, sf_dir), "raw_plate")


def recent_merged(spark, sf_dir):
    """The five plates seen last, misread ones under the plate that they turned out to be."""
    return caps.latest(_resolved(spark, sf_dir), "canonical")


def parking_sightings(spark, sf_dir):
    """Visits begin in parking mode only; here every fourth hour isn't."""
    mode = F.when(F.expr("ts div 3600000 % 4") == 0, "PATROL").otherwise("PARKING")
    return V.passed(V.parking_only(_by_user(spark, sf_dir).withColumn("mode", mode))).select("event_id", "canonical", "ts")


def results_alive(spark, sf_dir):
    """Sightings whose result is still shown at a moment."""
    return caps.within(sightings(spark, sf_dir).where(F.col("ts") <= DAY), DAY, 3 * 3_600_000).select("event_id", "ts")


def consecutive_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return V.consecutive(events, "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "event_type")


def confirmed_reads(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return V.confirmed(events, "user_id", "event_type", "ts", "event_id", times=2).select("event_id", "user_id", "event_type")


def adaptive_throttle(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', ts)").alias("ts"), (F.col("event_type") == "purchase").alias("hit"))
    return caps.throttled(frames, active_ms=3_600_000, idle_ms=14_400_000, idle_after=3)


def _cooldown_sql(ms: int) -> str:
    return f"""
s AS (SELECT event_id, user_id::VARCHAR AS canonical, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM sightings),
nxt AS (SELECT a.canonical, a.n, min(b.n) AS m FROM s a JOIN s b ON b.canonical = a.canonical AND b.ts >= a.ts + {ms} AND b.n > a.n GROUP BY 1, 2),
passed AS (SELECT canonical, 1::BIGINT AS n, 1 AS k FROM s WHERE n = 1 UNION ALL SELECT canonical, nxt.m, k + 1 FROM passed JOIN nxt USING (canonical, n)),
records AS (SELECT s.*, CASE WHEN k % 2 = 1 THEN 'ENTRY' ELSE 'EXIT' END AS kind FROM passed JOIN s USING (canonical, n))"""


def _day(column: str) -> str:
    return f"strftime(make_timestamp({column} * 1000), '%Y-%m-%d %H:%M')"


ON_DAY = f"((entryAt IS NOT NULL AND entryAt < {ORDER_DAY + report.DAY_MS} AND (exitAt IS NULL OR exitAt >= {ORDER_DAY})) OR (entryAt IS NULL AND exitAt >= {ORDER_DAY} AND exitAt < {ORDER_DAY + report.DAY_MS}))"
MS = "CASE WHEN entryAt IS NOT NULL AND exitAt IS NOT NULL THEN greatest(0, exitAt - entryAt) END"
MINUTES = f"(({MS}) // 60000)"
DURATION_TEXT = f"CASE WHEN {MINUTES} < 60 THEN {MINUTES} || '분' WHEN {MINUTES} % 60 = 0 THEN {MINUTES} // 60 || '시간' ELSE {MINUTES} // 60 || '시간 ' || {MINUTES} % 60 || '분' END"

QUERIES = {
    f.__name__: f
    for f in (
        visits_cooldown, visits_cooldown_long, visits_toggle, visits_corrections, visits_stream_records, parked_now, open_visit_latest, visits_for_day, visits_by_day, day_summary, visit_status_labels,
        visits_export_rows, day_labels, frequency_cap, daily_event_counts, recent_top5, consecutive_dedup, confirmed_reads, adaptive_throttle, recent_merged, parking_sightings, results_alive,
        visits_stream_corrections, captures_spaced_stream, result_spells_stream, frequency_cap_stream, adaptive_throttle_stream, live_parked, live_plates, detections_pending_stream,
    )
}
LONG = f"WITH RECURSIVE {SIGHTINGS_SQL},{_cooldown_sql(LONG_COOLDOWN)}"
TOGGLE = f"""
q AS (SELECT event_id, ts, raw_plate, canonical, is_registered, row_number() OVER (PARTITION BY canonical ORDER BY ts, event_id) AS n FROM resolved),
nxt AS (SELECT a.canonical, a.n, min(b.n) AS m FROM q a JOIN q b ON b.canonical = a.canonical AND b.ts >= a.ts + 90000 AND b.n > a.n GROUP BY 1, 2),
passed AS (SELECT canonical, 1::BIGINT AS n, 1 AS k FROM q WHERE n = 1 UNION ALL SELECT canonical, nxt.m, k + 1 FROM passed JOIN nxt USING (canonical, n)),
told AS (SELECT q.*, k, lead(ts) OVER (PARTITION BY canonical ORDER BY k) AS exitAt FROM passed JOIN q USING (canonical, n))"""
ORACLES = {
    "visits_cooldown": f"WITH RECURSIVE {SIGHTINGS_SQL},{_cooldown_sql(90_000)} SELECT event_id, canonical, ts FROM records",
    "visits_cooldown_long": f"{LONG} SELECT event_id, canonical, ts, kind FROM records",
    "visits_toggle": BASE.replace("WITH", "WITH RECURSIVE", 1) + f""",{RESOLVED_SQL},{TOGGLE}
SELECT event_id AS id, raw_plate AS plateNumber, canonical AS canonicalPlate, is_registered AS isRegistered, ts AS entryAt, exitAt, greatest(0, exitAt - ts) AS durationMs FROM told WHERE k % 2 = 1""".replace("greatest(0, exitAt - ts)", "CASE WHEN exitAt IS NOT NULL THEN greatest(0, exitAt - ts) END"),
    "visits_corrections": BASE.replace("WITH", "WITH RECURSIVE", 1) + f""",{RESOLVED_SQL},{TOGGLE},
ev AS (SELECT canonical, ts, 0 AS turn, event_id, raw_plate AS plate, is_registered AS reg, NULL::VARCHAR AS action, NULL::BIGINT AS vid FROM resolved WHERE canonical <> ''
  UNION ALL SELECT canonical, ts + 60000, 1, event_id, NULL::VARCHAR, NULL::BOOLEAN, ['undo', 'convert', 'close', 'delete'][event_id % 4 + 1], event_id FROM told WHERE k % 2 = 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY ts, turn, event_id) AS n FROM ev),
m AS (
  SELECT DISTINCT canonical, 0::BIGINT AS n, NULL::BIGINT AS since, []::STRUCT(id BIGINT, plate VARCHAR, reg BOOLEAN, entered BIGINT, gone BIGINT)[] AS vs FROM seq
  UNION ALL SELECT canonical, n, CASE WHEN turn = 0 AND due THEN ts WHEN turn = 0 OR action = 'convert' THEN since END,
    CASE WHEN turn = 0 AND NOT due THEN vs
      WHEN turn = 0 AND latest IS NULL THEN list_append(vs, {{'id': event_id, 'plate': plate, 'reg': reg, 'entered': ts, 'gone': NULL::BIGINT}})
      WHEN turn = 0 THEN list_transform(vs, lambda v: CASE WHEN v.id = latest THEN {{'id': v.id, 'plate': v.plate, 'reg': v.reg, 'entered': v.entered, 'gone': ts}} ELSE v END)
      ELSE list_transform(list_filter(vs, lambda v: NOT (v.id = vid AND (action = 'delete' OR (action = 'undo' AND v.gone IS NULL)))), lambda v: CASE
        WHEN v.id <> vid THEN v
        WHEN action = 'undo' THEN {{'id': v.id, 'plate': v.plate, 'reg': v.reg, 'entered': v.entered, 'gone': NULL::BIGINT}}
        WHEN v.gone IS NULL AND action = 'close' THEN {{'id': v.id, 'plate': v.plate, 'reg': v.reg, 'entered': v.entered, 'gone': ts}}
        WHEN v.gone IS NULL AND action = 'convert' THEN {{'id': v.id, 'plate': v.plate, 'reg': v.reg, 'entered': NULL::BIGINT, 'gone': coalesce(v.entered, ts)}} ELSE v END) END
  FROM (SELECT s.*, m.since, m.vs, m.since IS NULL OR s.ts - m.since >= 90000 AS due, list_max(list_transform(list_filter(m.vs, lambda v: v.gone IS NULL), lambda v: v.id)) AS latest
    FROM m JOIN seq s ON s.canonical = m.canonical AND s.n = m.n + 1)),
ends AS (SELECT canonical, unnest(vs) AS v FROM m QUALIFY n = max(n) OVER (PARTITION BY canonical))
SELECT v.id AS id, v.plate AS plateNumber, canonical AS canonicalPlate, v.reg AS isRegistered, v.entered AS entryAt, v.gone AS exitAt, CASE WHEN v.entered IS NOT NULL AND v.gone IS NOT NULL THEN greatest(0, v.gone - v.entered) END AS durationMs FROM ends""",
    "visits_stream_records": f"""{LONG}, k AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY ts, event_id) AS k FROM records),
e AS (SELECT canonical, k, event_id, ts FROM k WHERE k % 2 = 1)
SELECT k.canonical, k.kind, e.event_id AS visit_id, k.ts, k.canonical AS plate, k.canonical::BIGINT % 4 <> 3 AS registered, CASE WHEN k.kind = 'EXIT' THEN k.ts - e.ts END AS duration_ms
FROM k JOIN e ON e.canonical = k.canonical AND e.k = k.k - (k.k + 1) % 2""",
    "parked_now": f"WITH {VISITS_SQL} SELECT count(*) FILTER (exitAt IS NULL) AS parked FROM visits",
    "open_visit_latest": f"WITH {VISITS_SQL} SELECT canonicalPlate, id, plateNumber, isRegistered, entryAt FROM visits WHERE exitAt IS NULL QUALIFY row_number() OVER (PARTITION BY canonicalPlate ORDER BY id DESC) = 1",
    "visits_for_day": f"WITH {VISITS_SQL} SELECT id, canonicalPlate, entryAt, exitAt FROM visits WHERE {ON_DAY}",
    "visits_by_day": f"""WITH {VISITS_SQL}, r AS (SELECT id, coalesce(entryAt, exitAt) // 86400000 AS a, CASE WHEN entryAt IS NULL THEN exitAt ELSE coalesce(exitAt, {NOW}) END // 86400000 AS b FROM visits WHERE entryAt IS NOT NULL OR exitAt IS NOT NULL),
e AS (SELECT id, unnest(range(a, b + 1)) * 86400000 AS day FROM r WHERE a <= b) SELECT day, count(*) AS n, sum(id)::BIGINT AS ids FROM e GROUP BY day""",
    "day_summary": f"""WITH {VISITS_SQL}, d AS (SELECT *, {MS} AS ms FROM visits WHERE {ON_DAY})
SELECT count(*) FILTER (entryAt >= {ORDER_DAY} AND entryAt < {ORDER_DAY + report.DAY_MS}) AS entered, count(*) FILTER (exitAt >= {ORDER_DAY} AND exitAt < {ORDER_DAY + report.DAY_MS}) AS exited,
  count(*) FILTER (exitAt IS NULL) AS parked, count(ms) AS stays, (sum(ms) // nullif(count(ms), 0))::BIGINT AS average_ms, CASE WHEN sum(ms) > 0 THEN sum(ms)::BIGINT END AS total_ms FROM d""",
    "visit_status_labels": f"""WITH {VISITS_SQL}
SELECT id, CASE WHEN ({MS}) IS NOT NULL THEN {DURATION_TEXT} WHEN exitAt IS NULL AND {NOW} - entryAt > 86400000 THEN '미확인' WHEN exitAt IS NULL THEN '주차 중' ELSE '—' END AS status,
  coalesce(substr({_day('entryAt')}, 12), '입차 미확인') || ' →' || coalesce(' ' || substr({_day('exitAt')}, 12), '') AS span FROM visits""",
    "visits_export_rows": f"""WITH {VISITS_SQL}
SELECT coalesce(entryAt, exitAt) AS position, id, concat_ws(',', canonicalPlate, CASE WHEN isRegistered THEN '등록' ELSE '미등록' END, coalesce({_day('entryAt')}, ''), coalesce({_day('exitAt')}, ''), coalesce(({MINUTES})::VARCHAR, '')) AS line FROM visits""",
    "day_labels": f"""WITH {SIGHTINGS_SQL}, t AS (SELECT *, make_timestamp(ts * 1000) AS moment FROM sightings)
SELECT event_id, year(moment) || '년 ' || month(moment) || '월 ' || day(moment) || '일 (' || substr('일월화수목금토', dayofweek(moment)::INT + 1, 1) || ')' AS label, ts // 86400000 * 86400000 AS day_start, ts // 86400000 * 86400000 < {DAY} AS forward, ts // 86400000 AS utc_day FROM t""",
    "frequency_cap": f"""WITH RECURSIVE {SIGHTINGS_SQL},
e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'ask' END AS kind, count(*) FILTER (event_id % 3 = 0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS opens FROM sightings),
a AS (SELECT event_id, ts, user_id, ts // 86400000 AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e WHERE kind = 'ask' AND opens > 5),
g AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS last, -1::BIGINT AS day, 0 AS n, NULL::BIGINT AS event_id, false AS fits FROM a
  UNION ALL SELECT user_id, k, CASE WHEN fits THEN ts ELSE last END, CASE WHEN fits THEN day ELSE was END, CASE WHEN fits THEN today + 1 ELSE n END, event_id, fits FROM (
    SELECT a.user_id, a.k, a.ts, a.day, g.day AS was, g.last, g.n, a.event_id, CASE WHEN g.day = a.day THEN g.n ELSE 0 END AS today,
      a.ts - g.last >= 7200000 AND CASE WHEN g.day = a.day THEN g.n ELSE 0 END < 2 AS fits FROM g JOIN a ON a.user_id = g.user_id AND a.k = g.k + 1))
SELECT e.event_id, e.ts, e.user_id, e.kind, coalesce(g.fits, false) AS shown FROM e LEFT JOIN g ON g.event_id = e.event_id""",
    "adaptive_throttle": """WITH RECURSIVE f AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts, event_type = 'purchase' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
g AS (
  SELECT event_id, user_id, ts, hit, k, ts AS last, CASE WHEN hit THEN 0 ELSE 1 END AS misses, true AS due FROM f WHERE k = 1
  UNION ALL SELECT event_id, user_id, ts, hit, k, CASE WHEN due THEN ts ELSE last END, CASE WHEN NOT due THEN misses WHEN hit THEN 0 ELSE misses + 1 END, due FROM (
    SELECT f.event_id, f.user_id, f.ts, f.hit, f.k, g.last, g.misses, f.ts - g.last >= CASE WHEN g.misses >= 3 THEN 14400000 ELSE 3600000 END AS due FROM g JOIN f ON f.user_id = g.user_id AND f.k = g.k + 1))
SELECT event_id, user_id, ts, hit FROM g WHERE due""",
    "daily_event_counts": f"WITH {SIGHTINGS_SQL} SELECT user_id, ts // 86400000 AS day, count(*) AS n FROM sightings GROUP BY ALL",
    "recent_merged": f"{BASE},{RESOLVED_SQL} SELECT canonical, max(ts) AS ts FROM resolved GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "parking_sightings": f"WITH RECURSIVE {SIGHTINGS_SQL},{_cooldown_sql(90_000).replace('FROM sightings)', 'FROM sightings WHERE ts // 3600000 % 4 <> 0)')} SELECT event_id, canonical, ts FROM records",
    "results_alive": f"WITH {SIGHTINGS_SQL} SELECT event_id, ts FROM sightings WHERE ts <= {DAY} AND {DAY} - ts < {3 * 3_600_000}",
    "recent_top5": f"WITH {SIGHTINGS_SQL} SELECT raw_plate, max(ts) AS ts FROM sightings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "consecutive_dedup": "SELECT event_id, user_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) IS DISTINCT FROM event_type",
    "confirmed_reads": """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
SELECT event_id, user_id, event_type FROM i QUALIFY row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) >= 2""",
}
RECORDS_SQL = ORACLES["visits_stream_records"]
ORACLES |= {
    "visits_stream_corrections": ORACLES["visits_corrections"],
    "captures_spaced_stream": f"{LONG} SELECT event_id, ts FROM records",
    "result_spells_stream": f"""WITH {SIGHTINGS_SQL}, s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < {3 * 3_600_000} THEN 0 ELSE 1 END AS starts FROM sightings),
g AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM s)
SELECT user_id, min(ts) AS begins, max(ts) + {3 * 3_600_000} AS ends, count(*) AS n FROM g GROUP BY user_id, spell HAVING max(ts) + {3 * 3_600_000} <= (SELECT max(ts) FROM sightings)""",
    "frequency_cap_stream": f"SELECT event_id, ts, shown FROM ({ORACLES['frequency_cap']})",
    "adaptive_throttle_stream": f"SELECT event_id, ts FROM ({ORACLES['adaptive_throttle']})",
    "live_parked": f"SELECT registered, sum(CASE WHEN kind = 'ENTRY' THEN 1 ELSE -1 END)::BIGINT AS parked FROM ({RECORDS_SQL}) GROUP BY registered",
    "live_plates": f"""WITH {REGISTRY_SQL}, c AS (
  SELECT plateNumber, id, note, createdAt, false AS removed, createdAt AS changed_at FROM registry_rows
  UNION ALL SELECT plateNumber, id, note || ' *', createdAt, false, createdAt + 86400000 FROM registry_rows WHERE id % 3 = 0
  UNION ALL SELECT plateNumber, id, note, createdAt, true, createdAt + 172800000 FROM registry_rows WHERE id % 7 = 0)
SELECT plateNumber, id, note, createdAt FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY plateNumber ORDER BY changed_at DESC, id DESC) = 1) WHERE NOT removed ORDER BY createdAt DESC, id""",
    "detections_pending_stream": f"""{BASE},{RESOLVED_SQL},
a AS (SELECT raw_plate, arg_min(canonical, event_id) AS canonical, arg_min(is_registered, event_id) AS is_registered, min((ts, event_id)) AS f FROM resolved GROUP BY raw_plate HAVING f[2] % 5 <> 0)
SELECT s.event_id, s.ts, coalesce(a.canonical, s.raw_plate) AS shown, a.is_registered FROM sightings s
LEFT JOIN a ON a.raw_plate = s.raw_plate AND f[1] + f[2] % 100 * 60000 BETWEEN s.ts - {ANSWER_MS} AND s.ts + {WAIT_MS}""",
}
