"""Image kernels as Spark columns: Arrow UDFs over STRUCT<w, h, px>, and array functions where those suffice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from paddock.functions import images
from paddock.functions.text import GLYPHS

GRAY = "w int, h int, px array<int>"
#: Fixed value: the glyphs that enclose an area.
CLOSED = "마머모무바버보부배아어오우하허호"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _values(column: pa.Array) -> Iterator[object]:
    """The values of an Arrow array: lists of numbers as numpy arrays, others as Python's own; None for null, and for lists with
    nulls inside."""
    if not pa.types.is_list(column.type):
        yield from column.to_pylist()
        return
    at, inside = column.offsets.to_numpy(), column.values
    holes = np.concatenate([[0], inside.is_null().to_numpy(zero_copy_only=False).cumsum()]) if inside.null_count else None
    flat = (inside.fill_null(0) if inside.null_count else inside).to_numpy()
    for good, i, k in zip(column.is_valid().to_pylist(), at[:-1].tolist(), at[1:].tolist()):
        yield flat[i:k] if good and (holes is None or holes[i] == holes[k]) else None


def grays(part: pa.StructArray, *more: str) -> Iterator[list]:
    """For each row of an Arrow array STRUCT<w, h, px, ...> its image, None for null and malformed ones (px of another size, or
    with nulls), and the fields ``more``.  Pixels are taken from Arrow's memory, not value by value."""
    fields = dict(zip((f.name for f in part.type), part.flatten()))
    for w, h, px, *rest in zip(*(_values(fields[name]) for name in ("w", "h", "px", *more))):
        good = px is not None and w and h and len(px) == w * h
        yield [px.astype(np.int64).reshape(h, w) if good else None, *rest]


def kernel(function: Callable[..., object], result: str, *more: str):
    """An Arrow UDF that applies ``function`` to gray images and to the fields ``more`` beside w, h and px; null and malformed
    images give null."""
    kind = to_arrow_type(StructType.fromDDL(f"x {result}")["x"].dataType)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if g is None else function(g, *rest) for g, *rest in grays(part, *more)], kind)

    return F.arrow_udf(run, result)


def _shaped(g: np.ndarray | None):
    return None if g is None else np.asarray(g).ravel().astype(int).tolist()


def ink_mask(image) -> Column:
    return kernel(lambda g: images.ink_mask(g).ravel().tolist(), "array<boolean>")(_col(image))


def skew(image) -> Column:
    return kernel(images.skew, "double")(_col(image))


def holes(image) -> Column:
    """Enclosed areas of the image after Otsu's threshold."""
    return kernel(lambda g: images.holes(images.otsu(g)), "int")(_col(image))


def tight_box(image) -> Column:
    return kernel(images.tight_box, "array<int>")(_col(image))


def deskewed(image) -> Column:
    return kernel(lambda g: _shaped(images.deskewed(g)), "array<int>")(_col(image))


def glyph_from_right(image) -> Column:
    return kernel(images.glyph_from_right, "array<double>")(_col(image))


def without_dark_rows(image) -> Column:
    return kernel(lambda g: _shaped(images.without_dark_rows(g)), "array<int>")(_col(image))


def template(image) -> Column:
    return kernel(lambda g: None if (t := images.template(g)) is None else t.ravel().tolist(), "array<boolean>")(_col(image))


def template_bits(image) -> Column:
    """A template's 48 by 72 bits in 54 numbers, for :func:`likeness`; null without ink."""
    return kernel(lambda g: None if (t := images.template(g)) is None else np.packbits(t.ravel()).view(">i8").astype(np.int64).tolist(), "array<long>")(_col(image))


def likeness(a, b) -> Column:
    """:func:`dice` of two masks in the numbers of :func:`template_bits`."""
    count = lambda m: F.aggregate(m, F.lit(0), lambda s, x: s + F.bit_count(x))
    a, b = _col(a), _col(b)
    both = count(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    return F.when(count(a) + count(b) == 0, 0.0).otherwise(2.0 * both / (count(a) + count(b)))


def cropped(image, box) -> Column:
    """The part of an image inside a box (l, t, r, b), which must lie within it, row by row; null for a null box."""
    image, box = _col(image), _col(box)
    rows = F.transform(F.sequence(box["t"], box["b"] - 1), lambda y: F.slice(image["px"], y * image["w"] + box["l"] + 1, box["r"] - box["l"]))
    return F.when(box.isNotNull(), F.struct((box["r"] - box["l"]).alias("w"), (box["b"] - box["t"]).alias("h"), F.flatten(rows).alias("px")))


def prepared(image, size: int = 48) -> Column:
    """What a glyph model reads: dark rows cut, Otsu's threshold, box averages, standardised."""
    return kernel(lambda g: images.model_input(images.otsu(images.without_dark_rows(g)), size).tolist(), "array<double>")(_col(image))


# -- array functions ------------------------------------------------------------------------------------------


def total(values) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda s, x: s + x)


def _each(value: Column, array: Column) -> Column:
    """``value`` once for every element.  Inside a lambda it would be computed again for each of them."""
    return F.array_repeat(value, F.size(array))


def standardised(values) -> Column:
    """Mean 0 and (population) deviation 1; the deviation gets 1e-6 added."""
    v = F.transform(_col(values), lambda x: x.cast("double"))
    away = F.zip_with(v, _each(total(v) / F.size(v), v), lambda x, m: x - m)
    deviation = F.sqrt(F.aggregate(away, F.lit(0.0), lambda s, d: s + d * d) / F.size(v)) + 1e-6
    return F.zip_with(away, _each(deviation, v), lambda d, s: d / s)


def gray_of(values) -> Column:
    """An array of numbers as gray values 0..255, its least black and its greatest white."""
    v = _col(values)
    ends = _each(F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high")), v)
    return F.zip_with(v, ends, lambda x, e: F.when(e["high"] > e["low"], F.floor((x - e["low"]) * 255 / (e["high"] - e["low"]))).otherwise(0).cast("int"))


def histogram(values) -> Column:
    """Counts of the gray values 0 to 255; others count at the nearer end."""

    @F.pandas_udf("array<int>")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([None if px is None else np.bincount(np.clip(np.asarray(px, np.int64), 0, 255), minlength=256).tolist() for px in parts])

    return run(_col(values))


def enlarged(image, times: int) -> Column:
    """Every pixel as a square of ``times`` by ``times``."""
    px = kernel(lambda g: _shaped(np.kron(g, np.ones((times, times), np.int64))), "array<int>")(_col(image))
    image = _col(image)
    return F.struct((image["w"] * times).alias("w"), (image["h"] * times).alias("h"), px.alias("px"))


def otsu_threshold(values) -> Column:
    """The first gray value that best separates dark from bright, by a fold over the sorted values; 127 if none does.

    Separations that are equal to three decimals count as equal: in floating point equal ones differ in their last digits.
    """
    px = F.array_sort(F.transform(_col(values), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x))))
    n = F.size(px)
    pairs = F.arrays_zip(px.alias("x"), F.slice(px, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("after"))  # with the pixel after it
    whole = F.aggregate(px, F.lit(0).cast("long"), lambda s, x: s + x)
    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("sum"), F.lit(0.0).alias("best"), F.lit(127).alias("at"), n.alias("n"), whole.alias("whole"))

    def step(s: Column, p: Column) -> Column:
        k, part = s["k"] + 1, s["sum"] + p["x"]
        last = p["after"].isNotNull() & (p["after"] != p["x"])  # the last pixel of its value, with brighter ones after it
        gap = part / k - (s["whole"] - part) / (s["n"] - k)
        thousands = k.cast("double") * (s["n"] - k) * (gap * gap) * 1000.0
        rest = thousands % 1.0  # and no floor, which whole numbers of 64 bits would bound
        between = F.when(last, thousands - rest + F.when(rest >= 0.5, 1.0).otherwise(0.0)).otherwise(0.0)
        better = between > s["best"]
        return F.struct(k.alias("k"), part.alias("sum"), F.when(better, between).otherwise(s["best"]).alias("best"), F.when(better, p["x"]).otherwise(s["at"]).alias("at"), s["n"].alias("n"), s["whole"].alias("whole"))

    return F.aggregate(pairs, start, step)["at"]


def dice(a, b) -> Column:
    """2 |A and B| / (|A| + |B|) of two masks; 0 where both are empty."""
    count = lambda m: F.size(F.filter(m, lambda x: x))
    a, b = _col(a), _col(b)
    both = count(F.zip_with(a, b, lambda x, y: F.coalesce(x & y, F.lit(False))))
    return F.when(count(a) + count(b) == 0, 0.0).otherwise(2.0 * both / (count(a) + count(b)))


def argmax(scores, allowed=None) -> Column:
    """Place (from 0) of the greatest score among the allowed ones, the first at ties; null without any."""
    s = _col(scores)
    able = s if allowed is None else F.zip_with(s, _col(allowed), lambda x, a: F.when(a, x))
    best = F.array_max(able)
    return F.when(best.isNotNull(), F.array_position(able, best).cast("int") - 1)


def possible_glyphs(n_holes) -> Column:
    """Which of the 40 glyphs an image may show: without an enclosed area none of the closed ones."""
    open_ = F.array(*[F.lit(g not in CLOSED) for g in GLYPHS])
    every = F.array(*[F.lit(True) for _ in GLYPHS])
    return F.when(_col(n_holes) > 0, every).otherwise(open_)


def top_two(scores) -> Column:
    """(best, place, margin): the greatest score, its place, and how far it is ahead of the second."""
    s = _col(scores)
    ordered = F.sort_array(s, asc=False)
    return F.struct(F.element_at(ordered, 1).alias("best"), (F.array_position(s, F.element_at(ordered, 1)).cast("int") - 1).alias("place"), (F.element_at(ordered, 1) - F.element_at(ordered, 2)).alias("margin"))


def confident(best, margin) -> Column:
    return (_col(best) >= 0.60) & (_col(margin) >= 0.05)


def upper_median(values) -> Column:
    """The middle value, of an even number the upper one."""
    v = F.array_sort(_col(values))
    return F.element_at(v, (F.size(v) / 2).cast("int") + 1)


def nearest_rank(values, percent: int) -> Column:
    """The value at ``percent`` of the sorted array, by whole places."""
    v = F.array_sort(_col(values))
    return F.element_at(v, F.least(F.expr("0") + (F.size(v) * percent / 100).cast("int"), F.size(v) - 1) + 1)


def gaps(values) -> Column:
    v = _col(values)
    n = F.size(v)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: (b - a).cast("double")))


def moving_average(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Adds ``smooth``: the mean over ``width // 2`` rows to either side, fewer at the ends."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return rows.withColumn("smooth", F.avg(value).over(by))


def prefix_sums(rows: DataFrame, key: str, y: str, x: str, value: str) -> DataFrame:
    """Adds ``integral``: the sum over the rectangle from the origin to each pixel, by two window passes."""
    across = rows.withColumn("_row", F.sum(value).over(Window.partitionBy(key, y).orderBy(x)))
    return across.withColumn("integral", F.sum("_row").over(Window.partitionBy(key, x).orderBy(y))).drop("_row")


# How far, in pitches, a search moves the centre of a glyph's window, and half its width.
CENTRES = (-0.5, -0.35, -0.2, -0.1, 0.0, 0.1, 0.2, 0.35, 0.5)
HALF_WIDTHS = (0.45, 0.55, 0.66)


def best_window(scores, margins) -> Column:
    """(window, score, margin) of a sweep: the window with the greatest sum of score and margin, the first at ties; windows
    without a score don't count, and null comes of none.  Both arrays follow the order of :func:`sweep`."""
    sums = F.zip_with(_col(scores), _col(margins), lambda a, b: a + b)
    at = F.array_position(sums, F.array_max(sums)).cast("int")
    windows = sweep(CENTRES, HALF_WIDTHS)
    return F.when(F.array_max(sums).isNotNull(), F.struct(F.get(windows, at - 1).alias("window"), F.get(_col(scores), at - 1).alias("score"), F.get(_col(margins), at - 1).alias("margin")))


MOST_TEMPLATES = 1_000


def bank_of(known: DataFrame, glyph: str = "glyph") -> list[tuple[str, list[list[int]]]]:
    """Templates by glyph from images of known glyphs (glyph, image): a bank of at most MOST_TEMPLATES, which is a parameter of
    a search.  A glyph may have several, one for each typeface; images without ink have none."""
    rows = known.limit(MOST_TEMPLATES + 1).select(F.col(glyph).cast("string").alias("glyph"), template_bits("image").alias("bits")).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"a bank has at most {MOST_TEMPLATES} templates")
    by: dict[str, list[list[int]]] = {}
    for name, bits in sorted({(r.glyph, tuple(r.bits)) for r in rows if r.bits}):
        by.setdefault(name, []).append(list(bits))
    return sorted(by.items())


def best_window_of(g: np.ndarray, box: tuple, slot: tuple, bank: np.ndarray, starts: np.ndarray) -> tuple | None:
    """(place of the glyph, score, margin, number of the window) of the best window around a slot of an image: box (l, t, r, b),
    slot (index, slots); ``bank`` has the packed templates glyph by glyph, ``starts`` where each begins."""
    (left, top, right, bottom), (index, slots) = box, slot
    offset, width = np.array([(o, w) for o in CENTRES for w in HALF_WIDTHS]).T
    pitch, more = (right - left) / slots, (bottom - top) * 0.08
    centre, half = left + (index + 0.5 + offset) * pitch, pitch * width
    ends = np.stack([np.maximum(np.trunc(centre - half), 0), np.minimum(np.trunc(centre + half), g.shape[1])], 1).astype(np.int64)
    t, b = max(int(top - more), 0), min(int(bottom + more), g.shape[0])
    able = np.flatnonzero(ends[:, 1] - ends[:, 0] >= 8)
    if b - t < 8 or not len(able) or not len(bank):
        return None
    bits, kept = images.window_templates(g[t:b], ends[able])
    if not len(kept):
        return None
    count = lambda m: np.bitwise_count(m).sum(-1, dtype=np.int64)
    both, size = count(bits[:, None] & bank), count(bits)[:, None] + count(bank)
    scores = np.maximum.reduceat(np.where(size > 0, 2.0 * both / np.maximum(size, 1), 0.0), starts, 1)
    place, ordered = scores.argmax(1), np.sort(scores, 1)
    score = ordered[:, -1]
    margin = ordered[:, -1] - ordered[:, -2] if len(starts) > 1 else np.zeros(len(kept))
    k = int((score + margin).argmax())
    return int(place[k]), float(score[k]), float(margin[k]) if len(starts) > 1 else None, int(able[kept[k]])


def best_glyphs(slots: DataFrame, bank: list[tuple[str, list[list[int]]]], key: str = "id") -> DataFrame:
    """(key, glyph, score, margin, offset, width) of slots (key, image, box, slot): of all windows around the slot, the one whose
    best glyph is the likest and the furthest ahead of the second (score and margin together; at ties the first window).

    All windows of a slot are cut out, made templates and compared with every template of the bank at once, so that an image is
    read once.  Slots without a window of a usable size or without ink have no row.
    """
    known = np.array([t for _, some in bank for t in some], np.int64).reshape(-1, 54).view(np.uint64)
    starts = np.array([0, *np.cumsum([len(some) for _, some in bank])[:-1]], np.int64)

    where = ("l", "t", "r", "b", "index", "slots")

    def found(g, *at):
        return None if g is None or None in at else best_window_of(g, at[:4], at[4:], known, starts)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"place": pa.int32(), "score": pa.float64(), "margin": pa.float64(), "k": pa.int32()}
        for part in parts:
            out = [found(*row) or (None,) * 4 for row in grays(part, *where)]
            yield pa.StructArray.from_arrays([pa.array([t[i] for t in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    run = F.arrow_udf(run, "place int, score double, margin double, k int").asNondeterministic()  # else the filter below moves under a second copy of the kernel
    told = slots.select(key, run(F.struct("image.*", "box.*", "slot.*")).alias("t")).where("t.k is not null")
    window = F.get(sweep(CENTRES, HALF_WIDTHS), F.col("t.k"))
    glyph = F.get(F.array(*[F.lit(g) for g, _ in bank]), F.col("t.place"))
    return told.select(key, glyph.alias("glyph"), F.col("t.score").alias("score"), F.col("t.margin").alias("margin"), window["offset"].alias("offset"), window["width"].alias("width"))


def slot_of_digits(leading) -> Column:
    """(index, slots) of the glyph in a line of which only digits were read; null unless two or three come before it."""
    n = _col(leading)
    return F.when(n.between(2, 3), F.struct(n.alias("index"), (n + 5).alias("slots")))


def slot_in_reading(index, length) -> Column:
    """(index, slots) of the glyph in a line read as a whole; null for an index outside of it, or fewer than five characters."""
    i, n = _col(index), _col(length)
    return F.when((i >= 0) & (n >= 5) & (i < n), F.struct(i.alias("index"), n.alias("slots")))


def slot_window(box: Column, slot: Column, window: Column, width: Column, height: Column) -> Column:
    """The box (l, t, r, b) of a glyph's window in an image: the line's box in equal slots, the window's centre moved and its
    width in pitches, 8 % of the height added above and below; null where less than 8 pixels are left."""
    pitch = (box["r"] - box["l"]).cast("double") / slot["slots"]
    centre, half = box["l"] + (slot["index"] + 0.5 + window["offset"]) * pitch, pitch * window["width"]
    more = (box["b"] - box["t"]) * 0.08
    l, r = F.greatest((centre - half).cast("int"), F.lit(0)), F.least((centre + half).cast("int"), width)
    t, b = F.greatest((box["t"] - more).cast("int"), F.lit(0)), F.least((box["b"] + more).cast("int"), height)
    return F.when(slot["slots"].isNotNull() & (r - l >= 8) & (b - t >= 8), F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")))


def sweep(offsets, widths) -> Column:
    """Every pair of an offset and a width, for a search over windows."""
    return F.flatten(F.transform(F.array(*map(F.lit, offsets)), lambda o: F.transform(F.array(*map(F.lit, widths)), lambda w: F.struct(o.alias("offset"), w.alias("width")))))
