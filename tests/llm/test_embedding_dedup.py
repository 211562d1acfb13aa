"""Links and components against the whole cosine matrix, the error bound, and awkward vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import embedding_dedup as E


def brute(rows, threshold):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {k: [0, rows[k][0]] for k in range(len(rows))}
    parent = {k: k for k in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    units = {k: E.unit(np.array([rows[k][1]], np.float64))[0] for k in good}
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            if len(units[a]) == len(units[b]) and (units[a] * units[b]).sum() >= threshold:
                out[a][0] += 1
                out[b][0] += 1
                parent[root(a)] = root(b)
    least = {}
    for k in good:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    for k in good:
        out[k][1] = least[root(k)]
    return sorted((-1 if rows[k][0] is None else rows[k][0], n, -1 if c is None else c, c is None or c == rows[k][0]) for k, (n, c) in out.items())


def result(frame):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in frame.collect())


@pytest.mark.parametrize("tile", [16, 4096])
def test_awkward_vectors(spark, tile):
    rng = np.random.default_rng(1)
    rows, nan, inf = [], float("nan"), float("inf")
    for _ in range(5):
        base = rng.normal(size=8)
        for _ in range(30):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4])]))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (3, rows[3][1]), (502, [2 * x for x in rows[3][1]]), (503, None), (504, []), (505, [0.0] * 8), (506, [nan] + [1.0] * 7), (507, [inf] + [1.0] * 7), (508, [None] + [1.0] * 7)]
    rows += [(509, [1.0, 0.0]), (510, [1.0, 0.1]), (None, rows[3][1]), (511, [1e-30] * 8), (512, [1e30] * 8), (513, [-0.0, 1.0]), (514, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")
    exact = [(r.vec_id, r.embedding and list(r.embedding)) for r in frame.collect()]
    assert result(E.near_vectors(frame, 0.9, tile=tile)) == brute(exact, 0.9)


def test_table_equals_all_pairs(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    want = brute(rows, 0.9)
    assert result(E.near_vectors(frame, 0.9, tile=64)) == want


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 0.0, 1.0]), (3, [0.01, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(E.near_vectors(frame, 0.9)) == brute(rows, 0.9)


def test_open_pairs_get_their_vectors(spark):
    """Codes leave pairs close to the threshold open, and few others."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    vectors = np.stack([base + rng.normal(size=64) * 0.33 for _ in range(300)])  # cosines around 0.9
    units = E.unit(vectors)
    codes, scale, error = E.quantised(units)
    tile = {"codes": codes, "scale": scale, "error": error}
    cosine, settled, open_ = units @ units.T, 0, 0
    for i, j, sure in E.tile_links(tile, None, 0.9):
        assert (cosine[i[sure], j[sure]] >= 0.9).all()
        settled, open_ = settled + sure.sum(), open_ + (~sure).sum()
        assert (np.abs(cosine[i[~sure], j[~sure]] - 0.9) < 0.05).all()
    assert settled > open_ > 0
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    assert result(E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, tile=50)) == brute(rows, 0.9)


def test_empty_table(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 70))
def test_error_bound_holds(seed, dimension):
    rng = np.random.default_rng(seed)
    u = E.unit(rng.normal(size=(40, dimension)) ** rng.choice([1, 3]))
    codes, scale, error = E.quantised(u)
    wide = codes * scale[:, None]
    length = np.sqrt((wide**2).sum(axis=1))
    bound = error[:, None] * length[None, :] + (length + error)[:, None] * error[None, :]
    assert (np.abs(u @ u.T - wide @ wide.T) <= bound + 1e-12).all()
