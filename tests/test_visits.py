"""The visit machine, batches against it, corrections, limits, and streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from paddock.operators import caps, lookup, report, visits
from paddock.streaming import visits_stream

START = 1_700_000_000_000


def run(offsets, cooldown=90_000):
    m = visits.Machine(cooldown)
    return [told and told[0] for told in (m.seen(i, START + t, "p", True) for i, t in enumerate(offsets))], m


def test_machine():
    assert run([0, 7_200_000])[0] == ["ENTRY", "EXIT"]
    assert run([0, 500, 30_500, 89_500])[0] == ["ENTRY", None, None, None]
    assert run([0, 90_000])[0] == ["ENTRY", "EXIT"] and run([0, 91_000])[0] == ["ENTRY", "EXIT"]
    told, m = run([0, 3_600_000, 7_200_000])
    assert told == ["ENTRY", "EXIT", "ENTRY"] and len(m.visits) == 2
    assert run([0, -5_000])[0] == ["ENTRY", None]


def test_machine_corrections():
    _, m = run([0])
    m.correct("undo", 0, START + 1)
    assert not m.visits and m.seen(5, START + 2, "p", True) == ("ENTRY", 5)
    _, m = run([0, 100_000])
    m.correct("undo", 0, START + 100_001)
    assert m.seen(9, START + 200_000, "p", True) == ("EXIT", 0)
    _, m = run([0])
    m.correct("convert", 0, START + 1)
    assert m.visits[0][2:] == [None, START] and m.seen(3, START + 2, "p", True) is None
    _, m = run([0])
    m.correct("close", 0, START + 5)
    assert m.visits[0][2:] == [START, START + 5] and m.seen(3, START + 6, "p", True) == ("ENTRY", 3)
    m.correct("delete", 3, START + 7)
    m.correct("delete", 77, START + 7)
    assert list(m.visits) == [0]


def sightings(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, START + rng.randint(0, 4_000_000), f"raw{i}", rng.choice(["a", "b", "c", "hot", "hot", "hot", "", None]), rng.random() < 0.5) for i in range(n)]
    rows += [(n + 1, rows[3][1], "tie", rows[3][3], True)]
    return rows, spark.createDataFrame(rows, "event_id long, ts long, raw_plate string, canonical string, is_registered boolean")


def machine_visits(rows, cooldown, corrections=()):
    machines = {}
    turns = [(ts, 0, i, key, (plate, reg)) for i, ts, plate, key, reg in rows if key] + [(ts, 1, i, key, (action, v)) for i, ts, action, v, key in corrections]
    for ts, turn, i, key, what in sorted(turns, key=lambda t: (t[:3], t[4][1], t[4][0] or "") if t[1] else (t[:3],)):
        m = machines.setdefault(key, visits.Machine(cooldown))
        m.correct(what[0], what[1], ts) if turn else m.seen(i, ts, *what)
    return sorted((i, v[0], k, v[1], v[2], v[3]) for k, m in machines.items() for i, v in m.visits.items())


@pytest.mark.parametrize(("cooldown", "part"), [(90_000, 86_400_000), (90_000, 50_000), (20_000, 1_000_000), (1, 7_000)])
def test_batch_equals_machine(spark, monkeypatch, cooldown, part):
    monkeypatch.setattr(visits, "PART_MS", part)
    rows, frame = sightings(spark)
    assert sorted(map(tuple, visits.visits(frame, cooldown).collect())) == machine_visits(rows, cooldown)


def test_corrections_equal_machine(spark):
    rows, frame = sightings(spark)
    rng = random.Random(2)
    known = machine_visits(rows, 90_000)
    told = [(10_000 + k, v[4] + rng.randint(0, 200_000), rng.choice(["undo", "convert", "close", "delete"]), v[0], v[2]) for k, v in enumerate(known[::2])]
    fixes = spark.createDataFrame(told, "event_id long, ts long, action string, visit_id long, canonical string")
    assert sorted(map(tuple, visits.corrected(frame, fixes).collect()), key=repr) == sorted(machine_visits(rows, 90_000, told), key=repr)


def test_stream_equals_batch(spark, tmp_path):
    rows, frame = sightings(spark, 400, 3)
    frame.orderBy("ts").createOrReplaceTempView("seen")
    ordered = frame.orderBy("ts", "event_id").collect()
    for k in range(4):  # four files in order of time make four micro-batches
        spark.createDataFrame(ordered[k * 101 : (k + 1) * 101], frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    visits_stream.write_records(visits_stream.visit_records(source, 90_000), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = visits.records(frame, 90_000)
    assert sorted((r.canonical, r.ts, r.kind) for r in got.collect()) == sorted((r.canonical, r.ts, r.kind) for r in want.collect())
    parked = visits_stream.live_parked(got).first()[0]
    assert parked == visits.visits(frame, 90_000).where("exitAt is null").count()


def test_frequency_cap(spark):
    def ask(opens, asks, **limits):
        rows = [(i, 1_000_000_000 + i, "u", "open") for i in range(opens)] + [(100 + k, 1_000_000_000 + t, "u", "ask") for k, t in enumerate(asks)]
        frame = spark.createDataFrame(rows, "event_id long, ts long, user_id string, kind string")
        return [r.shown for r in caps.allowed(frame, **limits).where("kind = 'ask'").orderBy("event_id").collect()]

    minute = 60_000
    assert ask(5, [minute]) == [False] and ask(6, [minute]) == [True]
    assert ask(6, [minute, 4 * minute, 6 * minute]) == [True, False, True]
    assert ask(6, [10 * minute * k for k in range(1, 8)]) == [True] * 6 + [False]
    assert ask(6, [*[10 * minute * k for k in range(1, 8)], 25 * 60 * minute]) == [True] * 6 + [False, True]


def test_reports(spark):
    day, ms = 1_700_006_400_000, 86_400_000
    rows = [(1, day - 5, day), (2, day - 5, day - 1), (3, None, day), (4, None, day + ms), (5, day + 1, None), (6, None, None), (7, day + 10, day + 5)]
    frame = spark.createDataFrame([(i, "p", "p", True, a, b) for i, a, b in rows], "id long, plateNumber string, canonicalPlate string, isRegistered boolean, entryAt long, exitAt long")
    assert sorted(r.id for r in report.visits_for_day(frame, day).collect()) == [1, 3, 5, 7]
    s = report.day_summary(frame, day).first()
    assert (s.entered, s.exited, s.parked, s.stays, s.average_ms, s.total_ms) == (2, 3, 1, 2, 2, 5)
    days = report.visit_days(frame, day + 3 * ms).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).collect()
    assert sorted(map(tuple, days)) == sorted(map(tuple, report.counts_by_day(frame, day + 3 * ms).collect())) and len(days) == 5
    texts = [r[0] for r in spark.createDataFrame([(0,), (59_999,), (3_600_000,), (3_660_000,), (90_000_000,), (None,)], "m long").select(report.duration_text(F.col("m"))).collect()]
    assert texts == ["0분", "0분", "1시간", "1시간 1분", "25시간", None]


def test_lookup_rules(spark):
    registry = spark.createDataFrame([(1, "100가1000", "n", 0, "1001000"), (2, "56더4895", "n", 0, "564895"), (3, "11가1111", "n", 0, "111111"), (4, "11가1111", "n", 0, "111111")], "id long, plateNumber string, note string, createdAt long, digitsKey string")
    scans = spark.createDataFrame([(1, " 100가1000 "), (2, "1001000"), (3, "56너4895"), (4, "56L4895"), (5, "111111"), (6, "11가1111"), (7, "99"), (8, "")], "event_id long, raw_plate string")
    got = {r.event_id: (r.canonical, r.is_registered) for r in lookup.resolve(scans, registry).collect()}
    assert got == {1: ("100가1000", True), 2: ("100가1000", True), 3: ("56너4895", False), 4: ("56더4895", True), 5: ("111111", False), 6: ("11가1111", True), 7: ("99", False), 8: ("", False)}
    entries = spark.createDataFrame([(" ",), ("12가3456",), ("x",)], "p string")
    assert [r[0] for r in entries.select(lookup.entry_error("p")).collect()] == ["empty", None, "invalid"]


@pytest.mark.parametrize("most", [5, 0])
def test_large_registries_are_met_by_frequent_keys_apart(spark, monkeypatch, most):
    """A plate, a digit key and texts without a match with most of the rows; null texts; the registry beyond the broadcast bound."""
    plates = [f"{10 + k}가{1000 + k}" for k in range(40)] + ["56더4895", "11나1111", "11나1111", None]
    registry = spark.createDataFrame([(k, p, "n", 0, "".join(c for c in p or "" if c.isdigit())) for k, p in enumerate(plates)], "id long, plateNumber string, note string, createdAt long, digitsKey string")
    texts = ["56더4895"] * 300 + ["561 4895", "56L4895"] * 60 + [None] * 50 + ["unseen"] * 40 + [p for p in plates if p] + ["111111"] * 30
    scans = spark.createDataFrame(list(enumerate(texts)), "event_id long, raw_plate string")
    cache = spark.createDataFrame([(t, t, True) for t in sorted({t for t in texts if t})], "text string, canonical string, is_registered boolean")
    results = lambda: [sorted(map(tuple, f.collect()), key=repr) for f in (lookup.resolve(scans, registry), lookup.exact_matches(scans, registry), lookup.digit_matches(scans, registry), lookup.with_cache(scans, cache), lookup.import_plates(scans.select(F.col("raw_plate").alias("plate"), F.lit("").alias("note")), registry))]
    want = results()
    monkeypatch.setattr(lookup, "FREQUENT", 1 / 20)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", most)
    assert results() == want and len(want[0]) == len(texts)


def test_new_rows_get_ids_once(spark):
    registry = spark.createDataFrame([(7,)], "id long")
    rows = spark.range(1000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("plate"), F.lit("n").alias("note"), F.lit(1).alias("extra")).repartition(5)
    got = lookup.with_ids(rows, registry, 5)
    assert sorted(r.id for r in got.collect()) == list(range(8, 1008)) and got.select("plateNumber").distinct().count() == 1000
    assert lookup.with_ids(rows.limit(0), registry, 5).count() == 0


def unbroken(spark, n=3000, users=("hot",), seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 40) * 1000 + START + i * 7_000, rng.choice(users), rng.random() < 0.2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts long, user_id string, hit boolean")


def arrays(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return "collect_list" in plan or "array_sort" in plan


@pytest.mark.parametrize(("cooldown", "part"), [(90_000, 600_000), (21_600_000, 900_000), (20_000, 50_000)])
def test_unbroken_runs_hold_no_arrays(spark, monkeypatch, cooldown, part):
    monkeypatch.setattr(visits, "PART_MS", part)
    rows, frame = unbroken(spark)
    got, last, want = visits.passed(frame, cooldown, "user_id"), None, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        if last is None or t - last >= cooldown:
            last = t
            want.append(i)
    assert not arrays(got) and sorted(r.event_id for r in got.collect()) == sorted(want)


def test_limits_hold_no_arrays(spark, monkeypatch):
    monkeypatch.setattr(caps, "DAY_MS", 3_600_000)
    rows, frame = unbroken(spark, users=("hot", "hot", "b", None))
    looked, granted = set(), set()
    state, limits = {}, {}
    for i, t, u, hit in sorted(rows, key=lambda r: (r[1], r[0])):
        last, misses = state.get(u, (None, 0))
        if last is None or t - last >= (200_000 if misses >= 3 else 30_000):
            looked.add(i)
            state[u] = (t, 0 if hit else misses + 1)
        opens, last, day, count = limits.get(u, (0, 0, None, 0))
        if i % 3 == 0:
            opens += 1
        elif opens > 5:
            count = count if day == t // 3_600_000 else 0
            day = t // 3_600_000
            if t - last >= 240_000 and count < 6:
                granted.add(i)
                last, count = t, count + 1
        limits[u] = (opens, last, day, count)
    throttled = caps.throttled(frame, active_ms=30_000, idle_ms=200_000, idle_after=3)
    allowed = caps.allowed(frame.withColumn("kind", F.when(F.col("event_id") % 3 == 0, "open").otherwise("ask")))
    assert not arrays(throttled) and {r.event_id for r in throttled.collect()} == looked
    assert not arrays(allowed) and {r.event_id for r in allowed.where("shown").collect()} == granted and allowed.count() == len(rows)


SEEN = "event_id long, ts long, raw_plate string, canonical string, is_registered boolean"
FIXES = "event_id long, ts long, action string, visit_id long, canonical string"


def test_finished_visits_are_not_held():
    """A plate's stretches hold the open visits and those that a later correction names, however long they are."""
    book = visits.Ledger()
    for k in range(300):
        first = 1 + 1001 * k
        list(book.correct("undo", 10_000 * (k - 1), 5, True))
        left = list(book.stretch(first, 1001, 10_000 * k + 1000))
        book.name(10_000 * k, first + book.skipped)
        assert len(book.visits) <= 2 and len(left) <= 2
    list(book.stretch(1 + 1001 * 300, 1001, 9))
    assert len(book.visits) <= 2


@pytest.mark.parametrize(("seed", "part"), [(11, 50_000), (12, 400_000), (13, 86_400_000)])
def test_corrections_cut_a_plate_into_stretches(spark, monkeypatch, seed, part):
    """Several corrections of one visit, of visits to come, of sightings that began none, at one time, twice the same."""
    monkeypatch.setattr(visits, "PART_MS", part)
    rows, _ = sightings(spark, 500, seed)
    rows = [r if r[3] in ("", None) else (*r[:3], "hot" if r[0] % 5 else r[3], r[4]) for r in rows]
    rng = random.Random(seed)
    ids = [r[0] for r in rows if r[3]]
    of = {r[0]: r[3] for r in rows}
    named = [rng.choice(ids) for _ in range(40)] + [v[0] for v in machine_visits(rows, 90_000)][::2]
    told = [(10_000 + k, START + rng.randint(0, 400) * 10_000, rng.choice(["undo", "undo", "convert", "close", "delete", "other", None]), v, of[v] if rng.random() < 0.95 else "b") for k, v in enumerate(named * 3)]
    told += [(30_000 + k, START + 2_000_000, "undo", v, of[v]) for k, v in enumerate(named[-5:])] + [told[5]] * 2
    lost = [(20_001, None, "undo", ids[0], "hot"), (20_002, START + 9, "undo", None, "hot"), (20_003, START + 9, "undo", ids[0], None)]
    got = visits.corrected(spark.createDataFrame(rows + [(9999, None, "x", "hot", True)], SEEN), spark.createDataFrame(told + lost, FIXES)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(machine_visits(rows, 90_000, told), key=repr)


def test_corrections_of_nothing(spark):
    none, no_fixes = spark.createDataFrame([], SEEN), spark.createDataFrame([], FIXES)
    fixes = spark.createDataFrame([(1, 2, "undo", 3, "hot")], FIXES)
    assert visits.corrected(none, fixes).collect() == [] and visits.corrected(none, no_fixes).collect() == []
    rows, frame = sightings(spark, 60)
    assert sorted(map(tuple, visits.corrected(frame, no_fixes).collect())) == machine_visits(rows, 90_000)


def test_islands_of_a_frequent_key(spark):
    """Values in a row, over the borders of days: one user has most rows; null keys, values and times."""
    import random

    from paddock.operators import visits as V

    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, 0, 1]) if rng.random() < 0.05 else rng.randint(0, 5) * V.PART_MS + rng.randint(0, 40), rng.choice(["a", "a", "a", "b", None] if rng.random() < 0.3 else ["a"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, u long, ts long, v string")
    by_key = {}
    for i, u, ts, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        by_key.setdefault(u, []).append((i, v))
    kept, again = set(), {2: set(), 3: set()}
    for seen in by_key.values():
        before, n = None, 0
        for i, v in seen:
            same = before is not None and v is not None and before == v
            n = n + 1 if same else 1
            again[2].update([i] if n >= 2 else [])
            again[3].update([i] if n >= 3 else [])
            if before is None or (v is not None and before != v):
                kept.add(i)
            before = v
    assert {r.id for r in V.consecutive(frame, "u", "v", "ts", "id").collect()} == kept
    for times, want in again.items():
        out = V.confirmed(frame, "u", "v", "ts", "id", times=times)
        assert out.columns == frame.columns and {r.id for r in out.collect()} == want


def test_names_are_trimmed_and_messages_are_whole(spark):
    from paddock.operators import lookup
    from paddock.operators import visits as V

    seen = spark.createDataFrame([(1, 1_000, " 12가3456 ", "12가3456", True)], "event_id long, ts long, raw_plate string, canonical string, is_registered boolean")
    assert V.visits(seen).first().plateNumber == "12가3456"
    counts = spark.createDataFrame([(3, 2, 1), (0, 0, 0)], "added int, already_present int, skipped int")
    assert [r[0] for r in counts.select(lookup.import_message()).collect()] == ["3대 추가, 2대 이미 등록됨, 1줄 건너뜀", "0대 추가"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from paddock.scratch import shared_dir

    conf = {"spark.master": "spark://there:7077"}
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__)))
    conf["spark.checkpoint.dir"] = "hdfs://there/shared/"
    assert shared_dir(SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__))) == "hdfs://there/shared"


def test_digits_with_many_registry_rows_are_met_once_a_glyph(spark, monkeypatch):
    """Rows that share digits and glyph are one for the lookup, and so are equal scans."""
    rows = [(k, "12가3456", "123456") for k in range(400)] + [(1000 + k, "12나3456", "123456") for k in range(400)] + [(2000, "12다3456", "123456"), (2001, "55라7777", "557777"), (2002, "55라7777", "557777"), (2003, "99 마9999", "999999")]
    registry = spark.createDataFrame(rows, "id long, plateNumber string, digitsKey string")
    texts = ["12가3456", "12나3456", "12다3456", "12L3456", "123456", "55라7777", "99마9999", "99L9999", "", None]
    scans = spark.createDataFrame(list(enumerate(texts * 30)), "event_id long, raw_plate string")
    got = sorted(map(tuple, lookup.digit_matches(scans, registry).collect()))
    want = {2: ("12다3456", 2000), 6: ("99 마9999", 2003), 7: ("99 마9999", 2003)}
    assert got == sorted((i, *want[i % 10]) for i in range(300) if i % 10 in want)
    seen = []
    met = lookup.met
    monkeypatch.setattr(lookup, "met", lambda left, right, key, how="left": seen.append((left.count(), right.count())) or met(left, right, key, how))
    lookup.digit_matches(scans, registry)
    assert seen[0][0] <= 12 and seen[0][1] == 5
