"""Samples of plates and settings saved last."""

from pyspark.sql import functions as F

from paddock.functions import text
from paddock.operators import samples


def test_each_glyph_comes_once_then_the_tricky_ones(spark):
    seeds = spark.createDataFrame([(7,), (8,), (None,)], "seed long")
    got = {}
    for r in samples.sample_plates(seeds).orderBy("seed", "position").collect():
        got.setdefault(r.seed, []).append(r.plate)
    assert set(got) == {7, 8} and got[7] != got[8] and all(len(v) == 50 for v in got.values())
    for plates in got.values():
        glyphs = [p[-5] for p in plates]
        assert glyphs[:39] == list(samples.USED_ONCE) and len(set(glyphs[:39])) == 39 and glyphs[39:] == list(samples.TRICKY[:11])
        leads = [int(p[:-5]) for p in plates]
        assert [len(p) for p in plates] == [8 if i % 2 == 0 else 7 for i in range(39)] + [7 if i % 2 == 0 else 8 for i in range(11)]
        assert all(100 <= n < 500 if len(p) == 8 else 10 <= n < 100 for n, p in zip(leads, plates)) and all(1000 <= int(p[-4:]) for p in plates)
    made = spark.createDataFrame([(p,) for p in got[7]], "p string")
    assert made.where(text.is_plate("p")).count() == 50
    again = samples.sample_plates(seeds.repartition(3)).where("seed = 7").orderBy("position")
    assert [r.plate for r in again.collect()] == got[7]


def test_more_samples_than_tricky_glyphs_begin_again(spark):
    rows = samples.sample_plates(spark.range(1).select(F.col("id").alias("seed")), n=60).orderBy("position").collect()
    assert [r.plate[-5] for r in rows[39:]] == [samples.TRICKY[i % 15] for i in range(21)]


ALLOWED = {"mode": samples.MODES, "sound": ("on", "off")}


def test_the_last_save_counts(spark):
    saves = [
        ("a", "mode", "PARKING", 5, 1), ("a", "mode", "CHECK", 4, 2), ("a", "sound", "off", 1, 3), ("a", "theme", "dark", 9, 4),  # an earlier save arrives later
        ("b", "mode", "CHECK", 5, 1), ("b", "mode", "PARKING", 5, 2),  # a tie in time
        ("c", "mode", "PARKING", 1, 1), ("c", "mode", "parking", 2, 2), ("d", "theme", "x", 1, 1), ("e", "mode", None, 3, 1), (None, "mode", "PARKING", 1, 1),
    ]
    frame = spark.createDataFrame(saves + saves, "owner string, key string, value string, at long, id long")
    got = {r.owner: (r["mode"], r.sound) for r in samples.last_settings(frame, ALLOWED).collect()}
    assert got == {"a": ("PARKING", "off"), "b": ("PARKING", "on"), "c": ("CHECK", "on"), "d": ("CHECK", "on"), "e": ("CHECK", "on"), None: ("PARKING", "on")}
    assert samples.last_settings(frame.limit(0), ALLOWED).count() == 0


def test_settings_shuffle_partial_sums_only(spark):
    frame = spark.range(100).selectExpr("id % 3 AS owner", "'mode' AS key", "'CHECK' AS value", "id AS at", "id")
    plan = samples.last_settings(frame, ALLOWED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan
