"""Made-up plates for tests of readers, and settings as they were last saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.text import GLYPHS

# The glyphs that a set of samples uses once each, and those that follow because they are common or easily mistaken.
USED_ONCE = GLYPHS[:39]
TRICKY = "러머너서저거가나다바조호아사하"
SAMPLES = 50


def _drawn(seed: Column, position: Column, part: int, least: int, bound: int) -> Column:
    """A number from ``least`` up to below ``bound``, drawn by seed and position alone, so that a task that runs again draws the same."""
    digits = F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), position.cast("string")).cast("binary")), 7 * part + 1, 7)
    return F.lit(least) + F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(bound - least))


def sample_plates(seeds: DataFrame, seed: str = "seed", n: int = SAMPLES) -> DataFrame:
    """(seed, position, plate): ``n`` plates for each seed.  Each glyph comes once, then the tricky ones in turn; three and two
    leading digits alternate.  A null seed has no plates; equal seeds have equal ones."""
    at = F.col("position")
    beyond = at - len(USED_ONCE)
    glyph = F.when(beyond < 0, F.substring(F.lit(USED_ONCE), at + 1, F.lit(1))).otherwise(F.substring(F.lit(TRICKY), beyond % len(TRICKY) + 1, F.lit(1)))
    three = F.when(beyond < 0, at % 2 == 0).otherwise(beyond % 2 == 1)
    each = seeds.where(F.col(seed).isNotNull()).select(F.col(seed).alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("position"))
    lead = F.when(three, _drawn(F.col("seed"), at, 0, 100, 500)).otherwise(_drawn(F.col("seed"), at, 1, 10, 100))
    return each.select("seed", "position", F.concat(lead.cast("string"), glyph, _drawn(F.col("seed"), at, 2, 1000, 10_000).cast("string")).alias("plate"))


# What a scan may mean, the default first.
MODES = ("CHECK", "PARKING")


def last_settings(saves: DataFrame, allowed: dict[str, tuple[str, ...]], owner: str = "owner") -> DataFrame:
    """(owner, setting...) from saves (owner, key, value, at, id): of each setting its value saved last, by time and then id.

    ``allowed`` names the settings with their values, the default first.  A setting never saved, or saved last with a value
    that isn't allowed, has its default; other keys are ignored.  A save overwrites by one aggregate, combined before the shuffle, so an
    owner with a third of all saves is no heavier than another.
    """
    mine = lambda key: F.max_by("value", F.when(F.col("key") == key, F.struct("at", "id")))
    last = saves.groupBy(owner).agg(*[mine(key).alias(key) for key in allowed])
    told = [F.when(F.col(key).isin(*values), F.col(key)).otherwise(F.lit(values[0])).alias(key) for key, values in allowed.items()]
    return last.select(owner, *told)
