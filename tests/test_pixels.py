"""Shapes in images as rows, against loops over single images."""

import numpy as np
from pyspark.sql import functions as F

from paddock.functions import images
from paddock.operators import glyphs, pixels
from tests.test_images import flood, plate_image, random_images


def framed(spark, pictures):
    rows = [(i, (g.shape[1], g.shape[0], [int(v) for v in g.ravel()])) for i, g in enumerate(pictures)]
    return spark.createDataFrame([*rows, (1000, None), (1001, (3, 3, [1]))], "id long, image struct<w int, h int, px array<int>>")


def boxes(g):
    label, n = flood(images.ink_mask(g), True)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1, len(x)))
    return sorted(out)


def winding():
    """One long shape that goes back and forth, so that labels have far to go."""
    g = np.full((41, 60), 220)
    for k in range(10):
        g[4 * k, 2:58] = 10
        g[4 * k : 4 * k + 5, 57 if k % 2 else 2] = 10
    return g


def scene():
    g = np.full((120, 260), 90)
    g[30:80, 20:240] = 225  # a plate
    for k in range(7):
        x = 34 + 28 * k
        g[40:70, x : x + 14] = 25
        g[45:65, x + 4 : x + 10] = 225
    g[40:70, 24:30] = 25  # a solid badge
    return g


def test_components_equal_a_flood(spark):
    pictures = [*random_images(20), winding(), plate_image()]
    found = pixels.components(framed(spark, pictures))
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.left, r.top, r.right, r.bottom, r.area))
    assert {i: sorted(v) for i, v in got.items()} == {i: b for i, g in enumerate(pictures) if (b := boxes(g))}


def test_text_boxes_and_lines(spark):
    pictures = [plate_image(), np.full((30, 90), 200), scene()]
    frame = framed(spark, pictures)
    parts = pixels.components(frame).cache()
    sizes = frame.select("id", "image.w", "image.h")
    assert [(r.id, r.left, r.top, r.right, r.bottom, r.n) for r in pixels.text_boxes(parts, sizes).where("id = 0").collect()] == [(0, 8, 8, 136, 32, 7)]
    got = {r.id: ((r.left, r.top, r.right, r.bottom), [tuple(c) for c in r.columns]) for r in pixels.lines(frame, parts).collect()}
    assert got == {0: ((8, 8, 136, 32), [(8 + 20 * k, 16 + 20 * k) for k in range(7)]), 2: ((34, 40, 34 + 28 * 6 + 14, 70), [(34 + 28 * k, 48 + 28 * k) for k in range(7)])}


def test_columns(spark):
    some = spark.createDataFrame([(1, [(6, 12), (0, 10), (11, 20), (30, 33)]), (2, []), (3, [(0, 9), (0, 3), (2, 4)])], "id int, b array<struct<left int, right int>>")
    got = {r.id: [tuple(c) for c in r.c] for r in some.select("id", pixels.columns_of(F.col("b")).alias("c")).collect()}
    assert got == {1: [(0, 12), (11, 20), (30, 33)], 2: [], 3: [(0, 9)]}


def plain_cell(g, top, bottom, centre, pitch):
    if pitch <= 0 or bottom - top < 4:
        return None
    x0, x1 = (min(max(int(centre + s * pitch * 1.2), 0), g.shape[1]) for s in (-1, 1))
    if x1 - x0 < 6:
        return None
    ink = [int(images.ink_mask(g)[top:bottom, x].sum()) for x in range(x0, x1)]
    if not any(ink):
        return None
    reach = max(1, int(pitch * 0.08)) // 2
    smooth = [np.mean(ink[max(0, i - reach) : i + reach + 1]) for i in range(len(ink))]
    at, sides = min(max(int(centre) - x0, 0), len(ink) - 1), []
    for low, high in ((-0.80, -0.28), (0.28, 0.80)):
        low, high = (min(max(int(at + v * pitch), 0), len(ink)) for v in (low, high))
        if high <= low:
            return None
        sides.append(x0 + low + int(np.argmin(smooth[low:high])))
    return tuple(sides) if sides[1] - sides[0] >= 3 else None


def test_cells_between_valleys(spark):
    rng = np.random.default_rng(7)
    pictures = [plate_image(), scene(), *random_images(15)]
    slots = [(i, s, int(rng.integers(0, 8)), int(rng.integers(6, g.shape[0] + 8)), float(np.round(rng.uniform(0, g.shape[1]), 2)), float(np.round(rng.uniform(-1, 32), 2))) for i, g in enumerate(pictures) for s in range(6)]
    told = spark.createDataFrame(slots, "id long, slot int, top int, bottom int, centre double, pitch double")
    got = {(r.id, r.slot): (r.left, r.right) for r in pixels.cells(framed(spark, pictures), told).collect()}
    want = {(i, s): c for i, s, t, b, x, p in slots if (c := plain_cell(pictures[i], t, b, x, p))}
    assert got == want and len(want) > 5


def plain_match(g, box, slot, bank):
    """The sweep by loops: the best window's glyph, score, margin and place."""
    (left, top, right, bottom), (index, slots), best = box, slot, None
    pitch, more = (right - left) / slots, (bottom - top) * 0.08
    for offset in glyphs.CENTRES:
        for width in glyphs.HALF_WIDTHS:
            centre, half = left + (index + 0.5 + offset) * pitch, pitch * width
            l, r = max(int(centre - half), 0), min(int(centre + half), g.shape[1])
            t, b = max(int(top - more), 0), min(int(bottom + more), g.shape[0])
            mask = images.template(g[t:b, l:r]) if r - l >= 8 and b - t >= 8 else None
            if mask is None:
                continue
            ranked = sorted(((max(images.dice(mask, m) for m in some), -k) for k, (_, some) in enumerate(bank)), reverse=True)
            score, margin = ranked[0][0], ranked[0][0] - ranked[1][0]
            if best is None or score + margin > best[1] + best[2]:
                best = bank[-ranked[0][1]][0], score, margin, offset, width
    return best


def test_glyphs_by_a_bank_of_templates(spark):
    rng = np.random.default_rng(3)

    def drawn(kind):
        g = np.full((26, 14), 220)
        g[3:23, 2:12] = 20
        g[6:20, 5:9] = 220
        for bit in range(3):
            if kind >> bit & 1:
                g[8 + 4 * bit : 10 + 4 * bit, 5:9] = 20
        return g + np.add.outer(np.arange(26), np.arange(14)) % 5

    kinds = [(k, v) for k in range(8) for v in range(2)]
    known = [(str(k), np.roll(drawn(k), v, 0)) for k, v in kinds]
    rows = [(k, (g.shape[1], g.shape[0], [int(x) for x in g.ravel()])) for k, g in known]
    bank = glyphs.bank_of(spark.createDataFrame([*rows, ("none", (3, 3, [200] * 9))], "glyph string, image struct<w int, h int, px array<int>>"))
    assert [g for g, _ in bank] == [str(k) for k in range(8)]
    masks = {}
    for k, g in known:
        masks.setdefault(k, []).append(images.template(g))
    pictures, slots = [], []
    for i in range(16):
        line = np.hstack([drawn(int(rng.integers(0, 8))) for _ in range(7)])
        g = np.full((34, line.shape[1] + 20), 220)
        g[4:30, 9 : 9 + line.shape[1]] = line + rng.integers(-3, 4, line.shape)
        pictures.append(np.clip(g, 0, 255))
        shift = rng.integers(-3, 4, 2)
        slots.append((i, (9 + int(shift[0]), 6, 9 + line.shape[1] + int(shift[1]), 28), (int(i % 7), 7)))
    told = spark.createDataFrame([*slots, (500, (0, 0, 9, 9), (3, 7))], "id long, box struct<l int, t int, r int, b int>, slot struct<index int, slots int>")
    blank = spark.createDataFrame([(500, (20, 20, [200] * 400))], "id long, image struct<w int, h int, px array<int>>")
    found = glyphs.best_glyphs(told.join(framed(spark, pictures).where("id < 1000").unionByName(blank), "id"), bank)
    got = {r.id: (r.glyph, round(r.score, 9), round(r.margin, 9), r.offset, r.width) for r in found.collect()}
    plain_bank = [(g, masks[g]) for g, _ in bank]
    want = {i: plain_match(pictures[i], box, slot, plain_bank) for i, box, slot in slots}
    assert got == {i: (g, round(s, 9), round(m, 9), o, w) for i, (g, s, m, o, w) in want.items()}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_shapes_by_runs_equal_a_flood(spark):
    rng = np.random.default_rng(5)
    masks = [rng.random(rng.integers(1, 40, 2)) < rng.choice([0.0, 0.2, 0.4, 0.6, 1.0]) for _ in range(80)] + [images.ink_mask(winding())]
    for mask in masks:
        label, n = flood(mask, True)
        want = []
        for k in range(1, n + 1):
            y, x = np.nonzero(label == k)
            want.append([int(y[0]) * images.ROW + int(x[0]), x.min(), y.min(), x.max() + 1, y.max() + 1, len(x)])
        assert images.shapes(mask).tolist() == sorted(want)


def test_shapes_are_found_within_an_images_row(spark):
    """No joins, no shuffles, and each kernel once."""
    frame = framed(spark, [plate_image()])
    assert "Exchange" not in (plan := plan_of(pixels.components(frame))) and plan.count("ArrowEvalPython") == 1
    told = frame.withColumn("parts", pixels.parts_of("image")).withColumn("line", pixels.line_of("image", "parts")).where("line is not null").select("id", *pixels.line_parts("line"))
    assert "Exchange" not in (plan := plan_of(told)) and plan.count("ArrowEvalPython") == 2
    assert [tuple(r)[:5] for r in told.collect()] == [(0, 8, 8, 136, 32)]


def test_cells_beside_their_images(spark):
    """A slot in its image's row gives the cell that the join gives, after one reading of the image."""
    frame, slot = framed(spark, [plate_image(), scene()]), (8, 32, 75.5, 20.0)
    one = F.array(F.struct(*[F.lit(v).alias(name) for v, name in zip(slot, pixels.SLOT)]))
    beside = frame.select("id", pixels.cells_of("image", one).alias("cell")).where(F.size("cell") > 0)
    assert (plan := plan_of(beside)).count("ArrowEvalPython") == 1 and "Exchange" not in plan
    joined = pixels.cells(frame, frame.select("id", F.lit(3).alias("slot"), *[F.lit(v).alias(name) for v, name in zip(slot, pixels.SLOT)]))
    assert sorted((r.id, *r.cell[1:]) for r in beside.collect()) == sorted((r.id, r.left, r.right) for r in joined.collect()) != []


def test_windows_are_searched_in_one_row(spark):
    frame = framed(spark, [plate_image()]).where("id < 1000")
    bank = [("a", [[-1] * 54]), ("b", [[0] * 54])]
    slots = frame.select("id", "image", F.expr("named_struct('l', 8, 't', 8, 'r', 136, 'b', 32)").alias("box"), F.expr("named_struct('index', 3, 'slots', 7)").alias("slot"))
    found = glyphs.best_glyphs(slots, bank)
    assert "Generate" not in (plan := plan_of(found)) and "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert [r.glyph for r in found.collect()] == ["a"]
    assert glyphs.best_glyphs(slots, bank[:1]).first().margin is None
