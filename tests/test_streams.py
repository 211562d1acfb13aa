"""Streams against batches: the same rows in many micro-batches, and state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from paddock.operators import caps, visits
from paddock.streaming import limits_stream, live, visits_stream
from tests.test_visits import START, machine_visits, sightings


def streamed(spark, tmp_path, rows, schema, parts=4, name="in"):
    """A stream of rows in order of their place in ``parts`` micro-batches."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def drained(spark, frame, tmp_path, name="out"):
    query = visits_stream.write_records(frame, str(tmp_path / name), str(tmp_path / f"{name}-check"))
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(str(tmp_path / name)), query


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


CLOCK = START + 10**10  #: a later row of another key, which moves the watermark past all others


def test_corrections_in_a_stream_equal_the_machine(spark, tmp_path):
    rows, frame = sightings(spark, 300)
    rng = random.Random(2)
    told = [(10_000 + k, v[4] + rng.randint(0, 200_000), rng.choice(["undo", "convert", "close", "delete"]), v[0], v[2]) for k, v in enumerate(machine_visits(rows, 90_000)[::2])]
    fixes = spark.createDataFrame(told, "event_id long, ts long, action string, visit_id long, canonical string")
    turns = visits_stream.turns(frame, fixes)
    every = sorted((tuple(r) for r in turns.collect()), key=lambda r: (r[1] + rng.randint(0, 5_000), r[3]))  # some overtake others
    stream = streamed(spark, tmp_path, [*every, ("zz", CLOCK, 0, 99_999, "zz", True, None, None)], turns.schema)
    changes, query = drained(spark, visits_stream.visit_changes(stream, keep_ms=1_000_000, delay="6 seconds"), tmp_path)
    got = visits_stream.visits_of(changes).where("id <> 99999")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(machine_visits(rows, 90_000, told), key=repr)
    still_open = got.where("exitAt is null").count()
    assert state_rows(query)[-1] <= still_open + 4 < max(state_rows(query))  # the clock's own rows and timers besides


@pytest.mark.parametrize("parts", [1, 3])
def test_limits_equal_batches_and_leave_no_state(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = sorted(((i, START + rng.randint(0, 300_000_000), rng.choice("abc"), rng.choice(["open", "ask", "ask", None]), rng.choice([True, False, False, None])) for i in range(400)), key=lambda r: r[1])
    schema = "event_id long, ts long, user_id string, kind string, hit boolean"
    frame = spark.createDataFrame(rows, schema)
    stream = streamed(spark, tmp_path, [*rows, (9_999, CLOCK, "zz", None, None)], frame.schema, parts)

    spaced, query = drained(spark, limits_stream.spaced(stream, 600_000), tmp_path, "spaced")
    last, want = {}, []
    for i, t, k, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if k not in last or t - last[k] >= 600_000:
            last[k] = t
            want.append(i)
    assert sorted(r.event_id for r in spaced.where("event_id < 9999").collect()) == sorted(want)
    assert state_rows(query)[-1] <= 2

    limits = {"gap_ms": 3_000_000, "per_day": 3, "grace": 2}
    shown, query = drained(spark, limits_stream.granted(stream, **limits), tmp_path, "granted")
    batch = caps.allowed(frame, **limits)
    assert sorted((r.event_id, r.shown) for r in shown.where("event_id < 9999").collect()) == sorted((r.event_id, r.shown) for r in batch.collect())

    times = {"active_ms": 300_000, "idle_ms": 1_200_000, "idle_after": 3}
    seen, _ = drained(spark, limits_stream.looked(stream, **times), tmp_path, "looked")
    assert sorted(r.event_id for r in seen.where("event_id < 9999").collect()) == sorted(r.event_id for r in caps.throttled(frame, **times).collect())

    spells, _ = drained(spark, limits_stream.shown_spells(stream, 2_000_000), tmp_path, "spells")
    want = []
    for k in "abc":
        for t in sorted(r[1] for r in rows if r[2] == k):
            if want and want[-1][0] == k and t < want[-1][2]:
                want[-1] = (k, want[-1][1], t + 2_000_000, want[-1][3] + 1)
            else:
                want.append((k, t, t + 2_000_000, 1))
    assert sorted(map(tuple, spells.collect())) == sorted(want)


def test_live_tables_follow_every_batch(spark, tmp_path):
    rows = [("a", "ENTRY", True), ("b", "ENTRY", False), ("a", "EXIT", True), ("c", "ENTRY", None), ("d", "ENTRY", True), ("b", "EXIT", False)]
    schema = spark.createDataFrame(rows, "canonical string, kind string, registered boolean").schema
    stream = streamed(spark, tmp_path, rows, schema, 3)
    live.keep_current(visits_stream.live_parked(stream, "registered"), str(tmp_path / "parked"), str(tmp_path / "check")).awaitTermination()
    now = live.current(spark, str(tmp_path / "parked"), ["registered"], "registered boolean, parked long")
    assert {r.registered: r.parked for r in now.collect()} == {True: 1, False: 0, None: 1}
    assert sorted(p.name for p in (tmp_path / "parked").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    live.keep_current(visits_stream.live_parked(stream), str(tmp_path / "all"), str(tmp_path / "check-all")).awaitTermination()
    assert live.current(spark, str(tmp_path / "all"), [], "parked long").first()[0] == 2

    changes = [("p", 1, "x", 10, False, 10), ("q", 2, "y", 20, False, 20), ("p", 1, "new", 10, False, 30), ("q", 2, "y", 20, True, 40), ("r", 3, "", 20, False, 50), ("s", 4, "", 20, False, 50)]
    schema = spark.createDataFrame(changes, "plateNumber string, id long, note string, createdAt long, removed boolean, changed_at long").schema
    stream = streamed(spark, tmp_path, changes, schema, 3, "changes")
    live.keep_current(live.newest_plates(stream), str(tmp_path / "plates"), str(tmp_path / "check-plates")).awaitTermination()
    kept = live.current(spark, str(tmp_path / "plates"), ["plateNumber"], "plateNumber string, id long, note string, createdAt long, removed boolean")
    assert [tuple(r) for r in live.newest_first(kept).collect()] == [("r", 3, "", 20), ("s", 4, "", 20), ("p", 1, "new", 10)]


def test_answers_that_arrive_later(spark, tmp_path):
    seen = [(1, START, "a"), (2, START + 1_000, "b"), (3, START + 9_000, "a"), (4, START + 60_000, "a"), (5, START + 61_000, None), (-1, CLOCK, "")]
    said = [("a", START + 4_000, "A", True), ("b", START + 30_000, "B", False), (" ", CLOCK, None, None)]
    left = streamed(spark, tmp_path, seen, spark.createDataFrame(seen, "event_id long, ts long, raw_plate string").schema, 2, "seen")
    right = streamed(spark, tmp_path, said, spark.createDataFrame(said, "raw_plate string, answered_at long, canonical string, is_registered boolean").schema, 1, "said")
    out, query = drained(spark, live.answered(left, right, keep_ms=50_000, wait_ms=10_000), tmp_path)
    got = sorted((r.event_id, r.shown, r.is_registered) for r in out.where("event_id > 0").collect())
    assert got == [(1, "A", True), (2, "b", None), (3, "A", True), (4, "a", None), (5, None, None)]
    assert state_rows(query)[-1] <= 2
    assert out.where(F.col("event_id") < 0).count() <= 1


def test_a_result_at_the_end_of_the_last_begins_a_spell(spark, tmp_path):
    rows = [(START, "a"), (START + 999, "a"), (START + 1_999, "a"), (START, "b"), (START + 1_000, "b"), (START + 2_001, "b"), (START + 5_000, "z")]
    stream = streamed(spark, tmp_path, rows, spark.createDataFrame(rows, "ts long, user_id string").schema, 1)
    spells, query = drained(spark, limits_stream.shown_spells(stream, 1_000), tmp_path)
    want = [("a", 0, 1_999, 2), ("a", 1_999, 2_999, 1), ("b", 0, 1_000, 1), ("b", 1_000, 2_000, 1), ("b", 2_001, 3_001, 1)]
    assert sorted(map(tuple, spells.collect())) == [(k, START + a, START + b, n) for k, a, b, n in want]
    assert state_rows(query)[-1] == 1
