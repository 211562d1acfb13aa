"""Plates in frames of recognised text: ARRAY<STRUCT<text, box STRUCT<l, t, r, b>>> per frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paddock.functions.text import clean, digits_only, lenient_plate

BLOCKS = "array<struct<text string, box struct<l int, t int, r int, b int>>>"


def _int_half(x: Column) -> Column:
    """Half of a whole number, towards zero."""
    return F.when(x >= 0, F.floor(x / 2)).otherwise(F.ceil(x / 2)).cast("int")


def united(a: Column, b: Column) -> Column:
    """The box around two boxes."""
    return F.struct(F.least(a["l"], b["l"]).alias("l"), F.least(a["t"], b["t"]).alias("t"), F.greatest(a["r"], b["r"]).alias("r"), F.greatest(a["b"], b["b"]).alias("b"))


def are_stacked(a: Column, b: Column) -> Column:
    """Whether box ``a`` may be the upper line of a plate and ``b`` the lower: at least half the narrower one's width in
    common, and a gap from minus half to twice the mean height."""
    width = lambda x: x["r"] - x["l"]
    common = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    narrow = F.least(width(a), width(b))
    height = _int_half((a["b"] - a["t"]) + (b["b"] - b["t"]))
    gap = b["t"] - a["b"]
    return F.coalesce((a["t"] < b["t"]) & (narrow > 0) & (2 * common >= narrow) & (gap >= _int_half(-height)) & (gap <= 2 * height), F.lit(False))


def stacked_pairs(blocks) -> Column:
    """Blocks on top of each other as one: their texts joined, in a box around both.  Blocks without a box have no pairs.

    A frame has few blocks, so its pairs are made within the row: no join.
    """
    boxed = F.filter(blocks, lambda x: x["box"].isNotNull())
    pair = lambda a, b: F.struct(F.concat(a["text"], b["text"]).alias("text"), united(a["box"], b["box"]).alias("box"))
    return F.flatten(F.transform(boxed, lambda a: F.transform(F.filter(boxed, lambda b: are_stacked(a["box"], b["box"])), lambda b: pair(a, b))))


def _read(blocks: Column) -> Column:
    cleaned = F.transform(blocks, lambda x: F.struct(x["box"].alias("box"), clean(x["text"]).alias("text")))  # once, not wherever it is read
    return F.transform(cleaned, lambda x: F.struct(x["box"].alias("box"), lenient_plate(x["text"]).alias("plate")))


def plates(blocks, pairs) -> Column:
    """(box, plate) of every block that shows a plate; only if none does, of every stacked pair.  ``pairs`` is the
    column of :func:`stacked_pairs`."""
    found = lambda c: F.filter(_read(F.col(c)), lambda x: x["plate"].isNotNull())
    single = found(blocks)
    return F.when(F.size(single) > 0, single).otherwise(found(pairs))


def ambiguous(blocks, pairs) -> Column:
    """Boxes of blocks and pairs with at least four digits but no plate."""
    unread = lambda x: x["box"].isNotNull() & (F.length(digits_only(x["text"])) >= 4) & lenient_plate(x["text"]).isNull()
    cleaned = lambda c: F.transform(F.col(c), lambda x: F.struct(x["box"].alias("box"), clean(x["text"]).alias("text")))
    boxes = lambda c: F.transform(F.filter(cleaned(c), unread), lambda x: x["box"])
    return F.concat(boxes(blocks), boxes(pairs))


def widest(boxes) -> Column:
    """The widest box, the first at ties."""
    widths = F.transform(boxes, lambda x: x["r"] - x["l"])
    return F.try_element_at(boxes, F.nullif(F.array_position(widths, F.array_max(widths)), F.lit(0)).cast("int"))


def rotated(box: Column, width: Column, height: Column, degrees: Column) -> Column:
    """A box of an image (width, height) after the image turned clockwise by a multiple of 90 degrees."""
    l, t, r, b = (box[x] for x in "ltrb")
    as_box = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, "ltrb")])
    turn = F.pmod(degrees, F.lit(360))
    return (
        F.when(turn == 90, as_box(height - b, l, height - t, r))
        .when(turn == 180, as_box(width - r, height - b, width - l, height - t))
        .when(turn == 270, as_box(t, width - r, b, width - l))
        .otherwise(as_box(l, t, r, b))
    )


def on_screen(box: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """A box scaled and moved to where it is shown."""
    return F.struct((box["l"] * scale + dx).alias("l"), (box["t"] * scale + dy).alias("t"), (box["r"] * scale + dx).alias("r"), (box["b"] * scale + dy).alias("b"))


def state_label(is_registered) -> Column:
    return F.when(F.col(is_registered), "registered").when(~F.col(is_registered), "unregistered").otherwise("pending")


def padded(box: Column, width: Column, height: Column, share: float = 0.3, target: int = 800) -> Column:
    """A box with a margin, inside the image, and the factor that scales its width up to ``target``."""
    pw, ph = ((box["r"] - box["l"]) * share).cast("int"), ((box["b"] - box["t"]) * share).cast("int")
    l, t = F.greatest(box["l"] - pw, F.lit(0)), F.greatest(box["t"] - ph, F.lit(0))
    r, b = F.least(box["r"] + pw, width), F.least(box["b"] + ph, height)
    return F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"), F.greatest(F.lit(1.0), F.lit(float(target)) / F.greatest(r - l, F.lit(1))).alias("scale"))


def any_without_syllable(plates_col) -> Column:
    return F.exists(plates_col, lambda p: ~p["plate"].rlike("[가-힣]"))
