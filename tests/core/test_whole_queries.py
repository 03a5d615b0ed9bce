"""Queries over whole tables against brute force on a table longer than any window or box of their namesakes."""

import math

import numpy as np
import pytest

from voxmill.plans.queries import QUERIES

ROWS = 320


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    v = np.random.default_rng(3).normal(0.1, 0.3, (ROWS, 64))
    v[100:180] = np.minimum(v[100:180], 0.1)  # a long gap without a value of 0.2
    where = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, r.tolist(), i % 5) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{where}/embeddings.parquet")
    return where, v


def array(df, shape, column="v"):
    pdf = df.toPandas()
    assert len(pdf) == math.prod(shape)
    out = np.full(shape, np.nan)
    out[pdf["y"], pdf["x"]] = pdf[column]
    return out


def bilinear(v, y, x):
    y0, x0 = np.minimum(np.floor(y).astype(int), len(v) - 2), np.minimum(np.floor(x).astype(int), v.shape[1] - 2)
    p, q = (y - y0)[:, None], (x - x0)[None]
    at = lambda i, j: v[np.ix_(y0 + i, x0 + j)]
    return at(0, 0) * (1 - p) * (1 - q) + at(0, 1) * (1 - p) * q + at(1, 0) * p * (1 - q) + at(1, 1) * p * q


def test_masked(spark, table):
    where, v = table
    y, x = np.indices(v.shape)
    inside = (y * 5 + x * 3) % 7 < 4
    assert np.allclose(array(QUERIES["copy_masked_whole"](spark, where), v.shape), np.where(inside, v, 0))
    assert np.allclose(array(QUERIES["op_masked_whole"](spark, where), v.shape), np.where(inside, v + 1, 0), atol=1e-6)
    assert np.allclose(array(QUERIES["masked_write_whole"](spark, where), v.shape), np.where(inside, 1, v))
    for name, want in (("max", [v[inside].max()]), ("min", [v[inside].min()]), ("min_max", [v[inside].min(), v[inside].max()]), ("mean", [v[inside].mean()]), ("std", [v[inside].std()]), ("mean_std", [v[inside].mean(), v[inside].std()])):
        assert np.allclose(QUERIES[f"stats_{name}_masked_whole"](spark, where).first(), want, atol=1e-6)
    a, b = np.floor((v + 0.6) * 8).astype(int), np.floor((v + 0.6) * 4).astype(int) + (y % 5) % 2
    values, counts = np.unique(a[inside], return_counts=True)
    assert {tuple(r) for r in QUERIES["unique_masked_whole"](spark, where).collect()} == set(zip(values.tolist(), counts.tolist()))
    pairs, counts = np.unique(np.stack([a[inside], b[inside]]), axis=1, return_counts=True)
    assert {tuple(r) for r in QUERIES["contingency_masked_whole"](spark, where).collect()} == set(zip(*pairs.tolist(), counts.tolist()))


def test_resampled(spark, table):
    where, v = table
    rows = int((ROWS - 1) / 0.75) + 1
    assert np.allclose(array(QUERIES["affine_linear_whole"](spark, where), (rows, 127)), bilinear(v, np.arange(rows) * 0.75, np.arange(127) * 0.5), atol=1e-6)
    assert np.allclose(array(QUERIES["transform_coordinates_whole"](spark, where), (ROWS, 127)), bilinear(v, np.arange(ROWS) * 1.0, np.arange(127) * 0.5), atol=1e-6)

    def halfway(n):
        """Samples to values of their cubic spline at i + 1/2, ends mirrored."""
        taps, m = np.zeros((n - 1, n)), np.zeros((n, n))
        mirror = lambda i: abs(i) if i < n else 2 * n - 2 - i
        for i in range(n):
            for k, w in zip((-1, 0, 1), (1 / 6, 4 / 6, 1 / 6)):
                m[i, mirror(i + k)] += w
        for i in range(n - 1):
            for k, w in zip((-1, 0, 1, 2), (1 / 48, 23 / 48, 23 / 48, 1 / 48)):
                taps[i, mirror(i + k)] += w
        return taps @ np.linalg.inv(m)

    want = np.zeros(v.shape)
    want[:-1, :-1] = (halfway(ROWS) @ v @ halfway(64).T)[::-1, ::-1]
    assert np.allclose(array(QUERIES["affine_rotation_cubic_whole"](spark, where), v.shape), want, atol=2e-6)


def test_points(spark, table):
    where, v = table
    a = np.floor((v + 0.6) * 8).astype(int)
    objects = np.argwhere(a >= 7)
    want = set()
    for i in range(ROWS):
        d2 = ((objects - [i, i * 23 % 64]) ** 2).sum(1)
        k = int(d2.argmin())
        want.add((i, int(a[tuple(objects[k])]), int(d2[k])) if d2[k] <= 36 else (i, 0, -1))
    got = [tuple(r) for r in QUERIES["map_points_whole"](spark, where).collect()]
    assert len(got) == ROWS and set(got) == want and (140, 0, -1) in want


def all_distances(fg):
    bg, out = np.argwhere(~fg), np.zeros(fg.shape)
    for p in np.argwhere(fg):
        out[tuple(p)] = math.sqrt(((bg - p) ** 2).sum(1).min()) if len(bg) else math.inf
    return out


def test_distances(spark, table):
    where, v = table
    want = all_distances(v < 0.2)
    assert want.max() > 30  # far beyond any halo
    assert np.allclose(array(QUERIES["edt_exact_whole"](spark, where), v.shape, "distance"), want)
    near = QUERIES["edt_whole"](spark, where).toPandas()
    got, exact = np.full(v.shape, np.nan), np.zeros(v.shape, bool)
    got[near["y"], near["x"]], exact[near["y"], near["x"]] = near["distance"], near["exact"]
    assert len(near) == v.size and (exact == (want <= 8)).all() and np.allclose(got[exact], want[exact]) and (got >= want - 1e-5).all()


def test_distances_without_background(spark, tmp_path):
    spark.createDataFrame([(i, [0.0] * 64, 0) for i in range(20)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("edt_exact_whole", "edt_whole"):
        assert np.isinf(array(QUERIES[name](spark, str(tmp_path)), (20, 64), "distance")).all()
