"""Near-duplicates by circulant MinHash, confirmed on full shingle sets.

Signatures come from two permutations of a circle of ``CIRCLE`` places: the first one puts a shingle on its
place, and signature coordinate k is the least value of the second one, shifted by k, over the places taken.
Documents with equal sets are one class from then on.  Classes that share a band form candidate groups, found
by joining ids only.  Each candidate's text then travels once to its group, whose classes are compared exactly
by blocked products of their set matrices; what leaves a task is a spanning star for each component, never pairs.

Groups too large for a task are dealt into chunks.  Chunks are linked inside, and so is a sample across them;
that leaves one large component and the rest.  A link still unknown has an end in that rest, so the rest, in
blocks, is compared with every chunk: the result is exact, and quadratic only in what no component has claimed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import BROADCAST_ROWS, text_slices, written
from paddock.llm.components import connected
from paddock.llm.hashing import grams, mixed, word_hashes

CIRCLE = 1 << 20
MISS = 5e-7  #: most probable miss of a pair just at the threshold, by all bands together
ROWS, MOST_BANDS = 6, 128  #: rows of a band, and fewer where a low threshold would need more bands than these
GROUP_DOCS, GROUP_SHINGLES = 1_000, 2_000_000  #: most classes and shingles that one task compares with each other
COLUMNS = 4_096

SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): at 85 percent 31 bands of 6 rows, at 80 percent 48."""
    for rows in range(ROWS, 0, -1):
        hit = min(percent / 100, 1 - 1e-9) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-hit))
        if bands <= MOST_BANDS or rows == 1:
            return max(1, bands), rows


@lru_cache(2)
def circle(coordinates: int, seed: int = 1) -> np.ndarray:
    """The second permutation, with its first coordinates repeated so that every shift is a plain slice."""
    turn = np.random.default_rng(seed).permutation(CIRCLE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([turn, turn[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Least value of the shifted permutation over the places of the shingles, for every shift."""
    places = (mixed(shingles + np.uint64(0x5851F42D4C957F2D)) % np.uint64(CIRCLE)).astype(np.int64)
    turn, least = circle(coordinates), np.full(coordinates, CIRCLE, np.int32)
    for k in range(0, len(places), 2_048):
        np.minimum(least, turn[places[k : k + 2_048]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + rows[:, k])
    return key.astype(np.int64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``size`` words, A-Z in lower case; a text with
    fewer words has its whole sequence as one shingle, one without words none."""
    words, counts = word_hashes(texts, lower=True)
    out, at = [], 0
    for n in counts.tolist():
        out.append(np.unique(grams(words[at : at + n], min(n, size))) if n else np.zeros(0, np.uint64))
        at += n
    return out


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(size: int, percent: int) -> Callable:
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, 1_000_000):
            sets = shingle_sets(part.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest_of(s) for s in sets], pa.binary()),
                    pa.array([band_keys(signature(s, bands * rows), bands) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def _matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and column of each shingle that at least two sets have, and the columns' begins."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(flat) else np.zeros(0, bool)
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    return owner, column, np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))


def intersections(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with all sets, by products of 0/1 column blocks."""
    owner, column, cuts = _matrix(sets)
    total = np.zeros((len(rows), len(sets)), np.float32)
    for i in range(len(cuts) - 1):
        a, b = cuts[i], cuts[i + 1]
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - i * COLUMNS] = 1
        total += block[rows] @ block.T
    return total.astype(np.int64)


def stars(sets: list[np.ndarray], rows: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning set of links among the sets, of those that have an end in ``rows``."""
    sizes = np.array([len(s) for s in sets])
    linked = similar(intersections(sets, rows), sizes[rows][:, None], sizes[None, :], percent)
    row_of = np.full(len(sets), -1)
    row_of[rows] = np.arange(len(rows))
    unseen, found = np.ones(len(sets), bool), []
    for start in rows.tolist():
        if not unseen[start]:
            continue
        unseen[start], queue = False, [start]
        while queue:
            x = queue.pop()
            if row_of[x] >= 0:
                more = np.flatnonzero(linked[row_of[x]] & unseen)
            else:  # known only as a column: its links are the rows that have it
                more = rows[linked[:, x] & unseen[rows]]
            unseen[more] = False
            found += [(x, y) for y in more.tolist()]
            queue += more.tolist()
    return found


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of equal leading columns from sorted batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
        first = 0
        for i in range(len(keys)):
            if keys[i] != key:
                if i > first:
                    held.append(batch.slice(first, i - first))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, first = [], keys[i], i
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _link(size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            ids, rest, digests = (group.column(i).to_pylist() for i in (2, 3, 4))
            sets = shingle_sets(group.column(5).to_pylist(), size)
            own = [i for i, (s, d) in enumerate(zip(sets, digests)) if digest_of(s) == d]  # an id can stand for several texts
            sets, ids, rest = [sets[i] for i in own], [ids[i] for i in own], np.array([rest[i] for i in own], bool)
            rows = np.flatnonzero(rest)
            found = stars(sets, rows, percent) if len(sets) > 1 and len(rows) else []
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

    return run


def linked_within(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning links (a, b) of the groups of ``members`` (g, h, doc_id, compared, digest): rows that are
    ``compared`` meet all rows of their group (g, h).  Texts come from ``docs`` (doc_id, text)."""
    if members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    rows = docs.join(members, "doc_id").select("g", "h", "doc_id", "compared", "digest", "text")
    return rows.repartition("g", "h").sortWithinPartitions("g", "h").mapInArrow(_link(size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group_docs: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; ``component_id`` is the
    smallest doc_id that links reach and ``kept`` says that it is the document itself.  Texts without words (null,
    empty) link with nothing; rows with a null id have a null component and stay; repeated rows come back repeated.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign(size, percent), SIGNED), "signed")
    usable = F.col("n_shingles") > 0
    classes = signed.where(usable & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")

    # ids that share a band: a star for each band key, then components of all stars
    keys = classes.select("rep", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first")
    near = keys.join(least, "key").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    groups = connected(near).select(F.col("component").alias("g"), F.col("id").alias("rep"))
    group_docs = group_docs or GROUP_DOCS
    needs = groups.join(classes.select("rep", "digest", "n"), "rep")
    needs = written(needs, "candidates")
    sizes = needs.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    sizes = written(sizes.select("g", F.greatest(F.ceil(F.col("m") / group_docs), F.ceil(F.col("shingles") / GROUP_SHINGLES)).cast("long").alias("chunks")), "sizes")
    members = written(needs.join(sizes, "g").withColumnRenamed("rep", "doc_id").withColumn("h", _deal(F.col("doc_id"), F.col("chunks"), 1)), "members")
    all_ = F.lit(True).alias("compared")
    small = members.select("g", "h", "doc_id", all_, "digest")
    links = written(linked_within(texts, small, size, percent), "found")
    if sizes.where("chunks > 1").limit(1).count():
        links = written(links.unionByName(_across(texts, members.where("chunks > 1"), links, size, percent)), "found")
    component = connected(links)

    of_class = classes.select("digest", "rep").join(component.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    of_class = written(of_class, "of-class")
    joined = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    id_ = F.when(F.col("doc_id").isNotNull(), F.when(usable, F.col("component_id")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", id_.alias("component_id"), F.coalesce(F.col("doc_id") == id_, F.lit(True)).alias("kept"))


def _deal(id_: Column, parts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(id_, F.lit(seed)), parts)


def _across(texts: DataFrame, members: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between chunks of large groups, given the links inside chunks."""
    sample = members.where(_deal(F.col("doc_id"), F.col("chunks"), 2) == 0).select("g", F.lit(-1).cast("long").alias("h"), "doc_id", F.lit(True).alias("compared"), "digest")
    more = written(linked_within(texts, sample, size, percent), "sampled")
    label = connected(links.unionByName(more)).withColumnRenamed("id", "doc_id")
    named = written(members.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    counts = named.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("g").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    marked = written(named.join(largest, "g").withColumn("rest", F.col("component") != F.col("largest")), "marked")
    # the rest of a group in blocks, each of which meets every chunk of the group
    blocks = marked.where("rest").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / GROUP_DOCS).cast("long").alias("blocks"))
    per_block = marked.join(blocks, "g")
    chunk = F.col("h") + F.lit(0)
    own = per_block.where("rest").select("g", _deal(F.col("doc_id"), F.col("blocks"), 3).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), "doc_id", "digest", F.lit(True).alias("compared"))
    met = per_block.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk.alias("c"), "doc_id", "digest", F.lit(False).alias("compared"))
    pairs = own.unionByName(met).groupBy("g", "block", "c", "doc_id", "digest").agg(F.max("compared").alias("compared"))
    wide = written(pairs.select("g", F.xxhash64("block", "c").alias("h"), "doc_id", "compared", "digest"), "blocks")
    return more.unionByName(linked_within(texts, wide, size, percent))
