"""What only shows on larger tables, on small ones that have it."""

import numpy as np

from voxmill.plans.queries import QUERIES


def embeddings(spark, where, v):
    spark.createDataFrame([(i, r.tolist(), i % 5) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{where}/embeddings.parquet")
    return str(where)


def array(df, shape):
    pdf = df.toPandas()
    out = np.full(shape, np.nan)
    out[tuple(pdf[a] for a in ("z", "y", "x")[-len(shape) :])] = pdf["v"]
    assert len(pdf) == out.size and not np.isnan(out).any()
    return out


def test_relabel_map_of_ids_below_zero_and_beyond_any_list(spark, tmp_path):
    v = np.random.default_rng(1).normal(0, 3, (20, 64))
    ids = np.floor((v + 0.6) * 8).astype(int)
    assert ids.min() < -16 and ids.max() > 32
    got = array(QUERIES["relabel_map"](spark, embeddings(spark, tmp_path, v)), v.shape)
    assert (got == np.fmod(ids * 7 + 3, 101)).all()  # SQL's remainder has the sign of the id




def test_resampling_makes_no_row_per_tap(spark, tmp_path):
    """Points meet blocks: tasks follow the number of points, and nothing is summed up per point."""
    from voxmill.operators import resample

    where = embeddings(spark, tmp_path, np.random.default_rng(2).normal(0, 0.2, (40, 64)))
    for name in ("resize_linear", "affine_linear_whole", "transform_coordinates_whole", "affine_rotation_cubic_whole"):
        plan = QUERIES[name](spark, where)._jdf.queryExecution().optimizedPlan().toString()
        assert "sum(" not in plan and "SortAggregate" not in plan, name
    old = resample.TASK
    resample.TASK = 500
    try:
        assert "RepartitionByExpression [_block#" in (plan := QUERIES["resize_linear"](spark, where)._jdf.queryExecution().optimizedPlan().toString()) and f"], {80 * 128 // 500 + 1}" in plan
    finally:
        resample.TASK = old


def test_sampling_of_odd_points(spark):
    """Far more points than voxels, points outside, nulls, NaNs and equal keys; short axes; missing voxels."""
    from pyspark.sql import functions as F

    from voxmill.operators.resample import resize, sample
    from voxmill.volume import Volume, from_numpy

    a = np.random.default_rng(4).normal(0, 1, (3, 5))
    big = resize(from_numpy(spark, a), (60, 100), 1)
    y, x = np.minimum(np.arange(60) * (3 / 60), 2), np.minimum(np.arange(100) * (5 / 100), 4)
    rows = np.stack([np.interp(x, np.arange(5), r) for r in a])
    want = np.stack([np.interp(y, np.arange(3), c) for c in rows.T], 1)
    assert np.allclose(array(big.df, (60, 100)), want)
    for order in range(6):
        v = from_numpy(spark, np.arange(6.0).reshape(1, 6))
        at = spark.createDataFrame([(0, 0.0, 2.0), (1, 0.0, 5.0), (2, 0.0, 7.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, -3.0, 1.0), (0, 0.0, 3.0)], "id int, p double, q double")
        got = sorted((r["id"], round(r["v"], 6)) for r in sample(v, at, ["id"], {"y": F.col("p"), "x": F.col("q")}, order, -1).collect())
        assert got == [(0, 2), (0, 3), (1, 5), (2, -1), (3, -1), (4, -1), (5, -1)], order
    sparse = Volume(spark.createDataFrame([(2, 1, 7.0)], "y long, x long, v double"), (40, 150), "float64", fill=1)
    got = array(resize(sparse, (40, 150), 1).df, (40, 150))
    assert got[2, 1] == 7 and got.sum() == 40 * 150 + 6


def test_deepest_voxels_line_by_line(spark, monkeypatch):
    """Objects that reach through the whole volume are never in one task; results are those of a whole distance transform."""
    from voxmill.operators import morphology
    from voxmill.operators.distance import edt
    from voxmill.volume import from_numpy

    monkeypatch.setattr(morphology, "LINES", 60)
    rng = np.random.default_rng(5)
    for shape, step in (((9, 14, 11), (3.0, 1.0, 1.5)), ((40, 23), (1.0, 2.0))):
        a = np.kron(rng.integers(0, 4, [-(-n // 3) for n in shape]), np.ones([3] * len(shape), int))[tuple(slice(n) for n in shape)]
        a[rng.random(shape) < 0.05] = 9
        vol = from_numpy(spark, a)
        rows = vol.df.where("v <> 0").withColumnRenamed("v", "label")
        got = {r[0]: tuple(r)[1:] for r in morphology.deepest(vol, rows, step).collect()}
        for k in np.unique(a[a > 0]):
            depth = edt(np.pad(a == k, 1), step)[0]
            assert got.pop(int(k)) == tuple(int(i) - 1 for i in np.unravel_index(depth.argmax(), depth.shape))
        assert not got
    pdf = rows.toPandas().assign(d=np.inf)
    whole = morphology._line_pass(vol.axes, 0, 1.0)(pdf)
    assert len(whole) == len(pdf) and whole["d"].max() < np.inf


def test_stitching_solves_once(spark, tmp_path):
    """Reading the result looks ids up in a table; the solver does not run again."""
    v = np.random.default_rng(6).normal(0, 0.2, (260, 64))
    df = QUERIES["stitch_segmentation"](spark, embeddings(spark, tmp_path, v))
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString().replace("stitch_tiles", "")
    got = array(df, v.shape)
    assert ((got == 0) == (v <= 0.05)).all() and set(np.unique(got)) == set(range(int(got.max()) + 1))


def test_matching_in_few_groups(spark):
    """As many pairs as augmenting paths find; components share groups, and lone edges need none."""
    from voxmill.operators.evaluation import matched_pairs

    rng = np.random.default_rng(7)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 300, (400, 2))} | {(1000 + i, 1000 + i) for i in range(50)})
    out = matched_pairs(spark.createDataFrame(edges + edges[:3], "a long, b long"))
    assert "_group" in out._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in out.collect()]
    partner: dict = {}

    def augment(a, seen):
        for b in [y for x, y in edges if x == a and y not in seen]:
            seen.add(b)
            if b not in partner or augment(partner[b], seen):
                partner[b] = a
                return True
        return False

    most = sum(augment(a, set()) for a in sorted({a for a, _ in edges}))
    assert len(got) == most == len({a for a, _ in got}) == len({b for _, b in got}) and set(got) <= set(edges)
