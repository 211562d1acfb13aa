"""Connected components of a link table, by alternating stars.

Links stay a distributed table; every round is two aggregations by the smallest neighbour, which combine map-side, with
joins back, which are broadcast or salted, so that a node with very many links is many tasks' work.  Rounds grow with
the logarithm of the longest chain, and each one's links are written to the shared folder, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import join_small, written


#: Most links up to which the least neighbours (a node and a number each, 16 bytes) are broadcast without a count of their own.
FEW_LINKS = 250_000
#: Tasks that share few links after a shuffle, at most some 60,000 rows each, however many partitions the session has.
FEW_TASKS = 8


def _dealt(rows: DataFrame, few: bool) -> DataFrame:
    """Rows that come out of a shuffle: where ``few`` links are at work, a round costs what its tasks cost to start and its
    files to write, so the shuffle's partitions are read several to a task."""
    return rows.coalesce(FEW_TASKS) if few else rows


def _with_least(links: DataFrame, few: bool) -> DataFrame:
    """Links (u, v) with ``m``, the least v of u.  Nodes are twice the links at most, so ``few`` links have few of them."""
    least = _dealt(links.groupBy("u").agg(F.min("v").alias("m")), few)
    return links.join(F.broadcast(least), "u") if few else join_small(links, written(least, "least"), ["u"])


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each linked id with the smallest id that it can reach, the smallest itself included.

    Links with a null end or from an id to itself, and repeated links, add nothing.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v")
    stars = written(pairs.distinct(), "links")
    few, mark = stars.limit(FEW_LINKS + 1).count() <= FEW_LINKS, None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, few).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        joined = _with_least(written(_dealt(large, few), "large"), few)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        stars = written(_dealt(small, few), "small")
        found = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark:
            break
        few, mark = found[0] <= FEW_LINKS, found
    ends = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return written(stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(_dealt(ends, few)), "components")
