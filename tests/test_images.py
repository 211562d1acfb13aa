"""Image kernels against plain loops over their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.functions import images
from paddock.operators import frames, glyphs


def random_images(n=25, seed=4):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        h, w = rng.integers(2, 40, 2)
        g = rng.integers(0, 256, (h, w))
        if rng.random() < 0.6:  # strokes on a bright ground
            g = np.full((h, w), 220) + rng.integers(-9, 9, (h, w))
            for _ in range(rng.integers(1, 9)):
                y, x = rng.integers(0, h), rng.integers(0, w)
                g[y : y + rng.integers(1, 9), x : x + rng.integers(1, 5)] = rng.integers(0, 60)
        yield g


def test_ink_mask():
    for g in random_images():
        h, w = g.shape
        for y in range(h):
            for x in range(w):
                part = g[max(0, y - 15) : y + 16, max(0, x - 15) : x + 16]
                assert images.ink_mask(g)[y, x] == (g[y, x] < part.sum() // part.size - 15) if (y + x) % 7 == 0 else True


def flood(mask, diagonal):
    h, w = mask.shape
    label, n = np.zeros((h, w), int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        label[y, x] = n
        while stack:
            a, b = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p, q = a + dy, b + dx
                    if (diagonal or not (dy and dx)) and 0 <= p < h and 0 <= q < w and mask[p, q] and not label[p, q]:
                        label[p, q] = n
                        stack.append((p, q))
    return label, n


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(diagonal):
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = rng.random(rng.integers(1, 24, 2)) < rng.choice([0.3, 0.5, 0.7, 1.0])
        got, (want, n) = images.components(mask, diagonal), flood(mask, diagonal)
        assert ((got > 0) == mask).all() and len({(a, b) for a, b in zip(got[mask], want[mask])}) == n == len(set(got[mask].tolist()))


def test_holes():
    g = np.full((40, 40), 255)
    g[8:32, 8:32] = 0
    assert images.holes(g) == 0
    g[14:26, 14:26] = 255
    assert images.holes(g) == 1
    g[19:21, 14:26] = 0
    assert images.holes(g) == 2
    g[8:14, 19] = 255  # a broken stroke is closed
    assert images.holes(g) == 2
    assert images.holes(np.full((3, 9), 255)) == 0


def test_otsu_and_model_input():
    for g in random_images():
        best, at = 0.0, 127
        for t in range(256):
            low, high = g[g <= t], g[g > t]
            if len(low) and len(high):
                between = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                if between > best * (1 + 1e-12):
                    best, at = between, t
        assert images.otsu_threshold(g) == at
        x = images.model_input(g, 16)
        assert x.shape == (256,) and abs(x.mean()) < 1e-6 and (abs(x.std() - 1) < 1e-3 or g.std() == 0)


def test_deskew_levels_a_tilted_line():
    g = np.full((40, 120), 230)
    for x in range(6, 114):
        y = int(14 + 0.1 * x)
        g[y : y + 6, x] = 20
    assert images.skew(g) == pytest.approx(0.1, abs=0.01)
    assert abs(images.skew(images.deskewed(g))) < 0.02
    assert images.deskewed(np.full((5, 5), 9)) is not None


def plate_image():
    g = np.full((40, 150), 230)
    for k in range(7):
        g[8:32, 8 + 20 * k : 16 + 20 * k] = 20
        g[12:28, 11 + 20 * k : 13 + 20 * k] = 230  # characters aren't solid
    g[::2] += 1
    return g


def test_boxes_of_a_plate():
    g = plate_image()
    assert images.tight_box(g) == (8, 8, 136, 32)
    centre, pitch = images.glyph_from_right(g)
    assert (centre, pitch) == (8 + 40 + 3.5, 20)
    dark = np.vstack([np.full((6, 150), 5), g])
    assert images.without_dark_rows(dark).shape == (40, 150)


def test_templates():
    a = images.template(plate_image())
    assert a.shape == (72, 48) and images.dice(a, a) == 1.0 and images.template(np.full((9, 9), 200)) is None


def test_columns_over_awkward_images(spark):
    rows = [(1, (2, 2, [0, 255, 255, 0])), (2, None), (3, (2, 2, [1, 2])), (4, (None, 2, [1])), (5, (1, 1, [7])), (6, (0, 0, []))]
    frame = spark.createDataFrame(rows, "id int, image struct<w int, h int, px array<int>>")
    got = {r.id: r for r in frame.select("id", glyphs.ink_mask("image").alias("m"), glyphs.holes("image").alias("h"), glyphs.tight_box("image").alias("b"), glyphs.prepared("image", 4).alias("p")).collect()}
    assert got[2].m is None and got[3].m is None and got[4].m is None and got[6].m is None
    assert got[1].h == 0 and got[1].b is None and len(got[1].p) == 16 and got[5].m == [False]


def test_native_functions_equal_kernels(spark):
    some = [g.ravel().tolist() for g in random_images(12)]
    frame = spark.createDataFrame([(i, px) for i, px in enumerate(some)], "id int, px array<int>")
    for r in frame.select("id", glyphs.otsu_threshold("px").alias("t"), glyphs.histogram("px").alias("h"), glyphs.nearest_rank("px", 85).alias("p"), glyphs.upper_median("px").alias("m")).collect():
        px = np.array(some[r.id])
        assert r.t == images.otsu_threshold(px) and list(r.h) == np.bincount(px, minlength=256).tolist()
        assert r.p == np.sort(px)[min(len(px) * 85 // 100, len(px) - 1)] and r.m == np.sort(px)[len(px) // 2]


def test_stacked_blocks(spark):
    box = lambda *v: dict(zip("ltrb", v))
    rows = [(1, [("80아", box(0, 0, 100, 20)), ("7890", box(0, 25, 100, 45))]), (2, [("80아", box(0, 0, 100, 20)), ("7890", box(90, 25, 200, 45))]), (3, [("80아", None), ("7890", box(0, 25, 100, 45))]), (4, []), (5, None)]
    frame = spark.createDataFrame(rows, f"id int, blocks {frames.BLOCKS}").withColumn("pairs", frames.stacked_pairs(F.col("blocks")))
    got = {r.id: r.p for r in frame.select("id", frames.plates("blocks", "pairs").alias("p")).collect()}
    assert [x.plate for x in got[1]] == ["80아7890"] and got[1][0].box.asDict() == box(0, 0, 100, 45)
    assert got[2] == [] and got[3] == [] and got[4] == [] and got[5] is None


def test_equal_separations_give_the_first_threshold(spark):
    """Symmetric grays have two best thresholds, which floating point tells apart."""
    some = [[16, 30, 30, 35, 35, 49], [11, 25, 29, 31, 35, 49], [12, 28, 30, 32, 34, 50]]
    frame = spark.createDataFrame([(i, px) for i, px in enumerate(some)], "id int, px array<int>")
    assert {r.id: r.t for r in frame.select("id", glyphs.otsu_threshold("px").alias("t")).collect()} == {0: 16, 1: 11, 2: 12}


TIED = np.array([[1, 60, 45, 53], [31, 16, 30, 8]])  #: 16 and 31 separate equally well


def test_templates_at_equal_separations(spark):
    g = TIED.repeat(4, 0).repeat(4, 1)
    frame = spark.createDataFrame([(16, 8, g.ravel().tolist())], "w int, h int, px array<int>").select(F.struct("w", "h", "px").alias("image"))
    want = (g < 16)[np.ix_(np.arange(72) * 8 // 72, 1 + np.arange(48) * 14 // 48)]
    assert frame.select(glyphs.template("image").alias("t")).first().t == want.ravel().tolist()


def test_model_inputs_at_equal_separations(spark):
    frame = spark.createDataFrame([(4, 2, TIED.ravel().tolist())], "w int, h int, px array<int>").select(F.struct("w", "h", "px").alias("image"))
    want = images.model_input(np.where(TIED <= 16, 0, 255), 4)
    assert frame.select(glyphs.prepared("image", 4).alias("x")).first().x == pytest.approx(want.tolist())
