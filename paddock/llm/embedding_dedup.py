"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors are scaled to length one and rounded to 8 bits with a scale of their own; the length of what rounding
took away is kept with each.  For two vectors the product of their codes then differs from the true cosine by
at most ``e_a * |code_b| + |code_a| * e_b + e_a * e_b``.  Tiles are multiplied as whole numbers, pairs whose
bound can't reach the threshold are settled, and only the others are computed from the full vectors, in double
precision.  A tile holds vectors that are near the same pivot; a pair of tiles is skipped when the angle between
their centres, less both radii, exceeds the angle of the threshold (a bound as well, so nothing is lost).

Vectors with equal components are one class before any product.  A task compares two tiles by their codes alone,
which is all that travels with every pair of tiles.  Pairs that the bounds settle either way are settled there; the
full vectors that the others need are sent to the pair of tiles afterwards, each once, and only pairs still open
are computed from them.  Tasks return a number of links per vector and a spanning set of links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import join_small, written
from paddock.llm.components import connected

TILE = 32_768  #: most vectors of a tile, about: 3 MB of codes at 64 dimensions
LEAST_TILES = 8  #: tables that fit in fewer tiles are cut into this many, so that more than one task works on them
PIVOTS = 1_024  #: most vectors, chosen by a hash, that tiles are gathered around; one for every two tiles
SLACK = 1e-9  #: added to every bound for the rounding of double precision itself


def usable(column: str) -> F.Column:
    """Not null, some component, all of them finite, not all zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled by the largest component first, so that nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), their scales, and the length of each row's rounding error."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    error = np.sqrt(((units - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def floats(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def tile_links(a: dict, b: dict | None, threshold: float, block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices of the pairs of two tiles (of one tile with itself, i < j, where ``b`` is None) that may be linked, and
    whether their bounds already say so, in blocks of rows of the first tile, so that what is held at once is bounded."""
    same = b is None
    b = a if same else b
    # products of codes are whole numbers; float32 holds them exactly up to 1,040 dimensions
    kind = np.float32 if b["codes"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    wide = b["codes"].astype(kind)
    length_b = np.sqrt((wide.astype(np.float64) ** 2).sum(axis=1)) * b["scale"]
    for k in range(0, len(a["codes"]), block):
        codes = a["codes"][k : k + block].astype(kind)
        scale, error = a["scale"][k : k + block], a["error"][k : k + block]
        length_a = np.sqrt((codes.astype(np.float64) ** 2).sum(axis=1)) * scale
        # no link unless codes . codes * scales + bound reaches the threshold; here with the block's largest bound and scale
        bound = error.max() * length_b + (length_a.max() + error.max()) * b["error"]
        least = (threshold - SLACK - bound) / b["scale"] / scale.max()
        product = codes @ wide.T
        i, j = np.nonzero(product >= (np.minimum(least, (threshold - SLACK - bound) / b["scale"] / scale.min()) * (1 - 1e-6) - 1e-3).astype(kind))
        if same:
            i, j = i[i + k < j], j[i + k < j]
        about = product[i, j].astype(np.float64) * scale[i] * b["scale"][j]
        tight = error[i] * length_b[j] + (length_a[i] + error[i]) * b["error"][j] + SLACK
        possible = about + tight >= threshold
        i, j, sure = i[possible], j[possible], (about - tight)[possible] >= threshold
        if len(i):
            yield i + k, j, sure


class Spanning:
    """Keeps, of links that come by rows, as few as connect the same nodes."""

    def __init__(self, nodes: int):
        self.label = np.arange(nodes)
        self.kept: list[tuple[int, int]] = []

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        """``first`` ascending."""
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        for x, others in zip(first[starts].tolist(), np.split(second, starts[1:])):
            labels = self.label[others]
            if (labels != self.label[x]).any():
                labels, at = np.unique(labels, return_index=True)
                new = labels != self.label[x]
                self.kept += [(x, y) for y in others[at[new]].tolist()]
                self.label[np.isin(self.label, labels)] = self.label[x]


def _as_tile(rows: pa.Table) -> dict | None:
    if not rows.num_rows:
        return None
    rows = rows.sort_by("key").combine_chunks()  # both passes must take a pair's ends in one order
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int8).reshape(rows.num_rows, -1)
    tile = {"ids": rows.column("key").to_numpy(), "codes": codes, **{c: rows.column(c).to_numpy() for c in ("n", "scale", "error")}}
    if "embedding" in rows.column_names:
        tile["unit"] = unit(floats(rows.column("embedding").combine_chunks()))
    return tile


def _code(pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit(floats(batch.column(2)))
            codes, scale, error = quantised(units)
            near = units @ pivots.T
            cell = near.argmax(axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "cell", "away", "codes", "scale", "error"])

    return run


TILED = "tile long, cell int, centre array<double>, radius double"


def _summary(tile: pa.Table) -> pa.Table:
    """A tile's centre and angular radius, from its codes; what rounding took away widens the radius."""
    made = _as_tile(tile)
    rows = made["codes"].astype(np.float64)
    units = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    centre = units.mean(axis=0)
    length = math.sqrt(float(centre @ centre))
    centre = centre / length if length > 1e-9 else units[0]
    # a vector of length one whose codes are off by e is turned by asin(e) at most
    off = np.arcsin(np.clip(made["error"], 0, 1))
    radius = float((np.arccos(np.clip(units @ centre, -1, 1)) + off).max())
    columns = [tile.column("tile")[:1], tile.column("cell")[:1], pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])]
    return pa.table(columns, names=["tile", "cell", "centre", "radius"])


#: a number of links of a vector; or a link of a spanning set, to ``other``; or a vector whose components tiles a and b need
FOUND = "a long, b long, key long, links long, other long, second boolean"


def _compare(threshold: float, exact: bool) -> Callable:
    """Links of two tiles, or of one with itself.  By codes alone, those that the bounds are sure of, and a row for each
    vector of a pair that they leave open; with the vectors of these, the links among the open pairs."""

    def run(pair: pa.Table) -> pa.Table:
        second = pair.column("second").to_numpy()
        a, b = (_as_tile(pair.filter(pa.array(own)).combine_chunks()) for own in (~second, second))
        names = (pair.column("a")[0].as_py(), pair.column("b")[0].as_py())
        same = names[0] == names[1]
        if a is None or (b is None and not same):
            return pa.table({c.split()[0]: pa.array([], pa.bool_() if "boolean" in c else pa.int64()) for c in FOUND.split(", ")})
        offset = 0 if same else len(a["ids"])
        ids, sizes = a["ids"], a["n"]
        if not same:
            ids, sizes = np.concatenate([ids, b["ids"]]), np.concatenate([sizes, b["n"]])
        links, span, open_ = np.zeros(len(ids)), Spanning(len(ids)), np.zeros(len(ids), bool)
        for i, j, sure in tile_links(a, b, threshold):
            if exact:
                i, j = i[~sure], j[~sure]
                other = a["unit"] if same else b["unit"]
                good = [(a["unit"][i[s : s + 65_536]] * other[j[s : s + 65_536]]).sum(axis=1) >= threshold for s in range(0, len(i), 65_536)]
                linked = np.concatenate(good) if good else np.zeros(0, bool)
                i, j = i[linked], j[linked] + offset
            else:
                open_[i[~sure]] = True
                open_[j[~sure] + offset] = True
                i, j = i[sure], j[sure] + offset
            if len(i):
                links += np.bincount(i, sizes[j], len(ids)) + np.bincount(j, sizes[i], len(ids))
                span.add(i, j)
        some, asked = np.flatnonzero(links), np.flatnonzero(open_)
        key = np.concatenate([ids[some], ids[[x for x, _ in span.kept]], ids[asked]])
        n, none = len(some) + len(span.kept), np.full(len(asked), -1)
        count = np.concatenate([links[some].astype(np.int64), np.zeros(len(span.kept), np.int64), none])
        other = pa.array([*[None] * len(some), *ids[[y for _, y in span.kept]].tolist(), *[None] * len(asked)], pa.int64())
        in_second = np.concatenate([np.zeros(n, bool), asked >= offset if not same else none > 0])
        return pa.table([pa.array(np.full(len(key), x)) for x in names] + [pa.array(key), pa.array(count), other, pa.array(in_second)], names=["a", "b", "key", "links", "other", "second"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors are linked when their cosine in double precision is at least ``threshold`` (above 0); ``n_links``
    counts the other vectors linked directly, equal ones included, and ``component_id`` is the smallest id that
    links reach.  Null vectors, zero vectors and those with null, NaN or infinite components link with nothing,
    and neither do vectors of different dimensions; rows with a null id have no links and a null component, and
    stay.  Repeated rows are vectors of their own.
    """
    rows = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")), "vectors")
    good = rows.where(F.col("vec_id").isNotNull() & usable("embedding"))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "vector-classes")  # written once, so keys stay
    spread = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]  # dimensions: one, or very few
    parts = [_links_of(classes.where(F.size("embedding") == d), threshold, tile) for d in spread]
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = written(found, "vector-links")
    else:
        found = vectors.sparkSession.createDataFrame([], "key long, links long, other long")
    component = connected(found.where("other is not null"), "key", "other").withColumnRenamed("id", "key")
    totals = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    of_class = written(classes.join(totals, "key", "left").join(component, "key", "left").withColumn("component", F.coalesce("component", "key")), "of-classes")
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    of_class = written(of_class, "of-vectors")
    keyed = rows.withColumn("embedding", F.when(F.col("vec_id").isNotNull() & usable("embedding"), F.col("embedding")))
    joined = keyed.join(of_class, "embedding", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def _links_of(classes: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(key, links, other) of the classes of one dimension: numbers of links, and a spanning set of them."""
    spark, count = classes.sparkSession, classes.count()
    tile = max(1, min(tile, math.ceil(count / LEAST_TILES)))
    n_pivots = max(1, min(PIVOTS, count // (2 * tile)))
    chosen = classes.orderBy(F.xxhash64("key"), "key").limit(n_pivots).select("embedding").toArrow()  # PIVOTS rows at most
    pivots = unit(floats(chosen.column(0).combine_chunks()))
    coded = classes.select("key", "n", "embedding").mapInArrow(_code(pivots), "key long, n long, cell int, away double, codes binary, scale double, error double")
    # cells are cut into tiles by the angle from the pivot, through the counts of narrow rings: no cell is sorted as one
    coded = written(coded.withColumn("ring", F.floor(F.col("away") * 2_000).cast("long")), "codes")
    order = Window.partitionBy("cell").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = coded.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("c"))  # PIVOTS * 6,284 narrow rows at most
    rings = written(rings.select("cell", "ring", F.floor(F.coalesce(F.sum("c").over(order), F.lit(0)) / tile).alias("part"), F.ceil(F.col("c") / tile).alias("pieces")), "rings")
    # a ring with more vectors than a tile is dealt into pieces by a hash
    piece = F.when(F.col("pieces") > 1, F.concat_ws("/", F.lit("r"), "ring", F.pmod(F.xxhash64("key"), F.col("pieces")))).otherwise(F.col("part").cast("string"))
    tiles = join_small(coded, rings, ["cell", "ring"]).select(F.xxhash64("cell", piece).alias("tile"), "cell", "key", "n", "codes", "scale", "error")
    tiles = written(tiles, "tiles")
    summaries = written(tiles.groupBy("tile").applyInArrow(_summary, TILED), "tile-summaries")
    pairs = written(_tile_pairs(spark, coded, summaries, pivots, threshold), "tile-pairs")
    shape = ["a", "b", "second", "key", "n", "codes", "scale", "error"]
    # as many rows as there are tiles near a tile, times the vectors: their codes, 8 times narrower than the vectors
    first = join_small(tiles.withColumnRenamed("tile", "a"), pairs, ["a"]).withColumn("second", F.lit(False)).select(shape)
    second = join_small(tiles.withColumnRenamed("tile", "b"), pairs.where("a <> b"), ["b"]).withColumn("second", F.lit(True)).select(shape)
    by_codes = written(first.unionByName(second).groupBy("a", "b").applyInArrow(_compare(threshold, exact=False), FOUND), "by-codes")
    # the vectors of open pairs, once for each pair of tiles that needs them
    asked = by_codes.where("links < 0").select("a", "b", "key", "second")
    needed = asked.join(tiles.select("key", "n", "codes", "scale", "error"), "key").join(classes.select("key", "embedding"), "key")
    by_vectors = needed.groupBy("a", "b").applyInArrow(_compare(threshold, exact=True), FOUND)
    both = by_codes.where("links >= 0").unionByName(by_vectors)
    return both.groupBy("key", "other").agg(F.sum("links").alias("links")).select("key", "links", "other")


def _tile_pairs(spark, coded: DataFrame, summaries: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """(a, b), a <= b: the pairs of tiles that may hold a link, by way of the pairs of cells that may."""
    wide = math.acos(min(1.0, threshold)) + 1e-6
    found = coded.groupBy("cell").agg(F.max("away").alias("r")).toArrow()  # PIVOTS rows at most
    cell, reach = found.column("cell").to_numpy(), found.column("r").to_numpy()
    between = np.arccos(np.clip(pivots[cell] @ pivots[cell].T, -1, 1)) - reach[:, None] - reach[None, :]
    p, q = np.nonzero((between <= wide) | np.eye(len(cell), dtype=bool))  # PIVOTS * PIVOTS pairs at most
    near = spark.createDataFrame(pa.table({"p": cell[p], "q": cell[q]}))
    left, right = summaries.toDF("a", "p", "ca", "ra"), summaries.toDF("b", "q", "cb", "rb")
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))) - F.col("ra") - F.col("rb")
    joined = left.join(near, "p").join(right, "q")
    return joined.where((F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) & (apart <= wide))).select("a", "b")
