"""Shapes in images: connected components, boxes of text, lines of characters, cells between valleys.

An image is a row (id, image STRUCT<w, h, px>); what is found in it are rows with its id.  An image's shapes concern it alone, so
each is found by one kernel over its pixels, which never leave the image's row; relations hold what was found.  The columns
:func:`parts_of`, :func:`line_of` and :func:`cells_of` serve where image and findings are in one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions import images as kernels
from paddock.operators import glyphs

# The kernels' columns count as nondeterministic only for the optimiser, which else moves a later filter below them with a
# copy of the kernel, and runs it twice.
PART = ("label", "left", "top", "right", "bottom", "area")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rows(flat: Column, names: tuple[str, ...], kind: str, skip: int = 0) -> Column:
    """An array of numbers, beyond the first ``skip``, as an array of structs with a field for each of ``names``."""
    at = lambda k, i: F.get(flat, k * len(names) + i + skip).cast("long" if names[i] == "label" else kind)
    n = ((F.size(flat) - skip) / len(names)).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(*[at(k, i).alias(name) for i, name in enumerate(names)]))
    return F.when(n > 0, made).when(flat.isNotNull(), F.array().cast(f"array<struct<{','.join(f'{name}:' + ('bigint' if name == 'label' else kind) for name in names)}>>"))


def parts_of(image) -> Column:
    """An image's connected ink as an array of numbers, six for each component: those named in PART."""
    return glyphs.kernel(lambda g: kernels.shapes(kernels.ink_mask(g)).ravel().tolist(), "array<long>").asNondeterministic()(_col(image))


def components_of(parts) -> Column:
    """The array of :func:`parts_of` as an array of structs."""
    return _rows(_col(parts), PART, "int")


def components(images: DataFrame, key: str = "id") -> DataFrame:
    """(key, label, left, top, right, bottom, area) of the connected ink of images; right and bottom excluded."""
    return images.select(key, parts_of("image").alias("parts")).select(key, F.inline(components_of("parts")))


def _sized(parts: DataFrame) -> DataFrame:
    return parts.withColumn("width", F.col("right") - F.col("left")).withColumn("height", F.col("bottom") - F.col("top"))


def _middle(values: str) -> Column:
    """The middle of a group's values, of an even number the upper one."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def text_boxes(parts: DataFrame, sizes: DataFrame, key: str = "id") -> DataFrame:
    """(key, left, top, right, bottom, n) around the components (with ``sizes``: key, w, h) that look like the characters of
    one line: at least three of usual proportions and density, near the middle height and row."""
    within = lambda c, low, high: F.col(c).between(low, high)
    area, h = F.col("width") * F.col("height"), F.col("h")
    like = _sized(parts.join(sizes.where("w >= 8 and h >= 8"), key)).where(within("height", 0.25 * h, 0.98 * h) & within("width", 0.08 * F.col("height"), 1.6 * F.col("height")) & within("area", 0.05 * area, 0.90 * area))
    like = like.withColumn("row", F.expr("(top + bottom - 1) div 2"))
    usual = like.groupBy(key).agg(F.count(F.lit(1)).alias("n"), _middle("height").alias("tall"), _middle("row").alias("at")).where("n >= 3").drop("n")
    line = like.join(usual, key).where(within("height", 0.65 * F.col("tall"), 1.35 * F.col("tall")) & (F.abs(F.col("row") - F.col("at")) <= 0.5 * F.col("tall")))
    return line.groupBy(key).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("n")).where("n >= 3")


def columns_of(boxes: Column, overlap: float = 0.35) -> Column:
    """An array of boxes (left, right) as character columns: one that reaches into the last column by more than ``overlap`` of
    the narrower of the two widens it."""
    none = F.array().cast("array<struct<left:int,right:int>>")

    def take(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        reach = overlap * F.least(b["right"] - b["left"], last["right"] - last["left"])
        wider = F.struct(last["left"].alias("left"), F.greatest(last["right"], b["right"]).alias("right"))
        own = F.struct(b["left"].alias("left"), b["right"].alias("right"))
        return F.when(b["left"] < last["right"] - reach, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(own)))

    return F.aggregate(F.array_sort(boxes), none, take)


def _told(line: tuple | None) -> list[int] | None:
    return None if line is None else [*line[:4], *(x for column in line[4] for x in column)]


def line_of(image, parts) -> Column:
    """The best line of dark characters on a bright plate of an image with its components as of :func:`parts_of`: numbers that
    :func:`line_parts` names, null without any."""
    image = _col(image)
    find = glyphs.kernel(lambda g, parts: None if parts is None else _told(kernels.best_line(g, parts)), "array<int>", "parts").asNondeterministic()
    return find(F.struct(image["w"].alias("w"), image["h"].alias("h"), image["px"].alias("px"), _col(parts).alias("parts")))


def line_parts(line) -> list[Column]:
    """left, top, right, bottom and columns of the numbers of :func:`line_of`."""
    line = _col(line)
    return [F.get(line, i).alias(name) for i, name in enumerate(("left", "top", "right", "bottom"))] + [_rows(line, ("left", "right"), "int", 4).alias("columns")]


def lines(images: DataFrame, parts: DataFrame, key: str = "id") -> DataFrame:
    """(key, left, top, right, bottom, columns) of the best line of each image, with its components ``parts``; images without
    a line have none."""
    own = parts.groupBy(key).agg(F.flatten(F.collect_list(F.array(*[F.col(name).cast("long") for name in PART]))).alias("parts"))
    return images.join(own, key).select(key, line_of("image", "parts").alias("line")).where("line is not null").select(key, *line_parts("line"))


SLOT = ("top", "bottom", "centre", "pitch")


def _cells(g: np.ndarray, *slots) -> list[int] | None:
    if any(s is None for s in slots):
        return None
    mask, out = kernels.ink_mask(g), []
    for i, slot in enumerate(zip(*slots)):
        found = None if any(v != v for v in slot) else kernels.cell(mask, *slot)
        if found:
            out.extend((i, *found))
    return out


def cells_of(image, slots) -> Column:
    """The cells of an image's slots, an array of structs with the fields of SLOT, none of them null: numbers, three for each
    slot that has one (its place in the array, left, right)."""
    image, slots = _col(image), _col(slots)
    fields = [slots[name].cast("array<int>" if name in ("top", "bottom") else "array<double>").alias(name) for name in SLOT]
    return glyphs.kernel(_cells, "array<int>", *SLOT).asNondeterministic()(F.struct(image["w"].alias("w"), image["h"].alias("h"), image["px"].alias("px"), *fields))


def cells(images: DataFrame, slots: DataFrame, key: str = "id") -> DataFrame:
    """(key, slot, left, right) of character cells around slots (key, slot, top, bottom, centre, pitch) of images: the
    columns with the least ink about half a pitch to either side, smoothed over a small part of one.

    The first of equal columns counts; slots too small, without ink or without room for a cell have none.
    """
    own = slots.where("pitch > 0 and bottom - top >= 4 and centre is not null").groupBy(key).agg(F.collect_list(F.struct("slot", *SLOT)).alias("slots"))
    found = images.join(own, key).select(key, "slots", cells_of("image", "slots").alias("cells"))
    each = found.select(key, "slots", F.inline(_rows(F.col("cells"), ("at", "left", "right"), "int")))
    return each.select(key, F.get("slots", F.col("at"))["slot"].alias("slot"), "left", "right")
