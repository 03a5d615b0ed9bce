"""Volumes, indexing, pointwise operations, reductions and metrics against numpy."""

import itertools
import math

import numpy as np
import pytest

from voxmill.operators import contingency, evaluation, pointwise, relabel, stats, views
from voxmill.volume import Volume, as_volume, block_id, derive_block_shape, from_numpy, register_source, select_blocks


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(42)


def one(df):
    return df.first().asDict()


def test_round_trip_and_slicing(spark, rng):
    for shape, dtype in (((7, 9), "float32"), ((3, 4, 5), "uint16"), ((11,), "int64"), ((2, 3, 2, 2), "uint8")):
        a = (rng.random(shape) * 200).astype(dtype)
        v = as_volume(a, spark)
        assert (v.to_numpy() == a).all() and v.to_numpy().dtype == a.dtype
    a = rng.random((7, 9))
    v = from_numpy(spark, a)
    for i in (np.s_[2:5, 3:], np.s_[-3:, :100], np.s_[4], np.s_[..., -1], np.s_[5:2], np.s_[1:2, 2]):
        assert np.array_equal(v[i].to_numpy(), a[i])
    assert v[-7, 0].shape == ()
    for bad in (np.s_[::2], np.s_[7], np.s_[..., 0, ...], np.s_[0, 0, 0]):
        with pytest.raises(ValueError):
            v[bad]
    with pytest.raises(TypeError):
        as_volume("some/path", spark)
    with pytest.raises(ValueError):
        from_numpy(spark, np.array([1 << 63], np.uint64))

    class Odd:
        pass

    register_source(lambda o: isinstance(o, Odd), lambda s, o: from_numpy(s, np.ones(3)))
    assert as_volume(Odd(), spark).shape == (3,)


def test_blocks(spark):
    a = np.arange(35).reshape(5, 7)
    v = from_numpy(spark, a)
    ids = Volume(v.df.withColumn("v", block_id(v, (2, 3))), v.shape, "int64").to_numpy()
    assert (ids == (np.arange(5)[:, None] // 2) * 3 + np.arange(7)[None] // 3).all()
    assert select_blocks(v, [0, 8], (2, 3)).df.count() == 6 + 1
    assert derive_block_shape((5, 7), (9, 3)) == (5, 3)


def test_stats(spark, rng):
    a = rng.random((33, 28)).astype("float32")
    m = np.zeros((33, 28), "uint8")
    m[2:8, 3:9] = 1
    v, w = from_numpy(spark, a), from_numpy(spark, m)
    assert stats.min_and_max(v) == (a.min(), a.max())
    assert stats.mean_and_std(v) == pytest.approx((a.mean(dtype=float), a.std(dtype=float)), abs=1e-5)
    assert stats.max(v, w) == a[m > 0].max() and stats.min(v, w) == a[m > 0].min()
    with pytest.raises(ValueError):
        stats.max(v, from_numpy(spark, np.zeros_like(m)))
    with pytest.raises(ValueError):
        stats.max(v, from_numpy(spark, m[:3]))
    a[0, 0] = np.nan
    v = from_numpy(spark, a)
    assert math.isnan(stats.min(v)) and math.isnan(stats.max(v))
    u = rng.integers(0, 50, (33, 28)).astype("uint64") * 1000
    got = stats.unique(from_numpy(spark, u), True).collect()
    ids, n = np.unique(u, return_counts=True)
    assert [tuple(r) for r in got] == list(zip(ids.tolist(), n.tolist()))


def test_pointwise_like_numpy(spark):
    x = np.array([[1.5, -2.0, 0.0, np.nan, np.inf, 3.0]])
    y = np.array([[0.0, 0.0, 0.0, 1.0, -np.inf, 3.0]])
    v, w = from_numpy(spark, x), from_numpy(spark, y)
    with np.errstate(all="ignore"):
        for name in ("add", "subtract", "multiply", "divide", "greater", "greater_equal", "less", "less_equal", "equal", "not_equal", "minimum", "maximum", "logical_and", "logical_or"):
            want, got = getattr(np, name)(x, y), pointwise.apply_operation(v, w, name)
            assert np.array_equal(got.to_numpy(), want, equal_nan=want.dtype.kind == "f"), name
            assert got.dtype == want.dtype.name
        for name in ("sqrt", "exp", "log", "abs", "isnan", "logical_not", "square"):
            want = getattr(np, name)(x)
            assert np.allclose(pointwise.apply_operation(v, None, name).to_numpy(), want, equal_nan=True), name
    for dtype in ("uint8", "int8", "int32", "uint32", "int64"):
        a, b = np.array([[250 % np.iinfo(dtype).max, 7, 100]]).astype(dtype), np.array([[10, 120, 100]]).astype(dtype)
        for name in ("add", "subtract", "multiply"):
            with np.errstate(over="ignore"):
                want = getattr(np, name)(a, b)
            assert (pointwise.apply_operation(from_numpy(spark, a), from_numpy(spark, b), name).to_numpy() == want).all(), (name, dtype)
    f = from_numpy(spark, np.ones((2, 2), "float32"))
    assert pointwise.add(f, 2.5).dtype == "float32"
    i = from_numpy(spark, np.array([[7, -7, 5]]))
    assert (pointwise.apply_operation(i, 3, "floor_divide").to_numpy() == [[2, -3, 1]]).all() and (pointwise.apply_operation(i, 3, "mod").to_numpy() == [[1, 2, 2]]).all()
    assert pointwise.divide(i, 2).dtype == "float64"


def test_broadcast_mask_and_errors(spark, rng):
    a, b = rng.random((4, 12)), rng.random((1, 12))
    m = rng.random((4, 12)) > 0.5
    v = from_numpy(spark, a)
    assert np.allclose(pointwise.multiply(v, from_numpy(spark, b)).to_numpy(), a * b)
    assert np.allclose(pointwise.add(v, from_numpy(spark, np.full((1, 1), 2.0))).to_numpy(), a + 2)
    assert np.allclose(pointwise.add(v, 1.0, mask=from_numpy(spark, m)).to_numpy(), np.where(m, a + 1, 0))
    assert np.allclose(pointwise.add(v, 1.0, mask=from_numpy(spark, m), output=v).to_numpy(), np.where(m, a + 1, a))
    with pytest.raises(NotImplementedError):
        pointwise.add(v, from_numpy(spark, b), mask=from_numpy(spark, m))
    for bad in (rng.random(12), rng.random((3, 12))):
        with pytest.raises(ValueError):
            pointwise.add(v, from_numpy(spark, bad))
    with pytest.raises(ValueError):
        pointwise.apply_operation(v, 1, "no_such")
    u = rng.integers(0, 10, (20, 18)).astype("uint8")
    for inline in (1000, 0):
        assert (pointwise.isin(from_numpy(spark, u), {1, 3, 5, 7}, most_inline=inline).to_numpy() == np.isin(u, [1, 3, 5, 7])).all()


def test_copy_and_views(spark, rng):
    a = rng.random((40, 48)) * 300
    v = from_numpy(spark, a)
    assert (pointwise.copy(v, dtype="uint8").to_numpy() == a.astype("int64").astype("uint8")).all()
    with pytest.raises(ValueError):
        pointwise.copy(v, v)
    assert (views.threshold(v, 100).to_numpy() == (a > 100)).all()
    block = np.zeros_like(a)
    for i, j in itertools.product(range(0, 40, 16), range(0, 48, 16)):
        c = a[i : i + 16, j : j + 16]
        block[i : i + 16, j : j + 16] = (c - c.min()) / (c.max() - c.min() + 1e-6)
    assert np.allclose(views.normalize(v, "float64", (16, 16)).to_numpy(), block)
    for mode in ("constant", "edge", "symmetric", "reflect"):
        assert np.allclose(views.pad(v, (3, 5), mode).to_numpy(), np.pad(a, [(0, 3), (0, 5)], mode))
    assert views.expand_dims(v, (0, 2)).to_numpy().shape == (1, 40, 1, 48)
    with pytest.raises(ValueError):
        views.expand_dims(v, (0, 0))
    assert views.roi(v, (3, slice(2, 9))).shape == (1, 7) and views.roi(v, (3, slice(2, 9)), squeeze=True).shape == (7,)
    with pytest.raises(IndexError):
        views.roi(v, (40,))
    assert np.allclose(views.transform_many(lambda p, q: p - q, v, v).to_numpy(), 0)
    assert np.allclose(views.transform(v, lambda b: b + b.max() * 0, halo=2, block_shape=(16, 16)).to_numpy(), a)


def test_contingency_micro(spark):
    a, b = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 1, 2, 2, 2])
    t = contingency.contingency_table(from_numpy(spark, a), from_numpy(spark, b))
    assert {(r[0], r[1]): r[2] for r in t.pairs.collect()} == {(0, 0): 1, (0, 1): 1, (1, 1): 1, (1, 2): 1, (2, 2): 2}
    assert t.as_dicts() == ({0: 2, 1: 2, 2: 2}, {0: 1, 1: 2, 2: 3}) and t.n_points() == 6
    d = t.drop_ignore([0])
    assert d.n_points() == 4 and {(r[0], r[1]) for r in d.pairs.collect()} == {(1, 1), (1, 2), (2, 2)}
    assert contingency.contingency_table(from_numpy(spark, np.array([0, 0, 1])), from_numpy(spark, np.array([1, 2, 0]))).drop_ignore([0], [0]).n_points() == 0
    with pytest.raises(ValueError):
        contingency.contingency_table(from_numpy(spark, a * 1.0), from_numpy(spark, b))


def test_metrics_micro(spark):
    seg = np.kron(np.array([[1, 2], [3, 4]]), np.ones((2, 2), int))
    merged = np.where(seg == 2, 1, seg)
    v, w = from_numpy(spark, seg), from_numpy(spark, merged)
    assert one(evaluation.variation_of_information(v, v)) == {"vi_split": 0, "vi_merge": 0}
    assert one(evaluation.rand_index(v, v)) == {"adapted_rand_error": 0, "rand_index": 1}
    assert one(evaluation.cremi_score(v, v))["cremi"] == 0
    split = one(evaluation.variation_of_information(v, w))
    assert split["vi_split"] > 0 and split["vi_merge"] == 0
    empty = contingency.contingency_table(v, v).drop_ignore([1, 2, 3, 4])
    assert one(evaluation.vi_scores(empty)) == {"vi_split": 0, "vi_merge": 0} and one(evaluation.rand_scores(empty)) == {"adapted_rand_error": 0, "rand_index": 1}
    obj = {r["label"]: r for r in evaluation.object_vi(v, w).collect()}
    assert obj[1]["vi_merge"] == pytest.approx(1) and obj[3]["vi_merge"] == 0


def match(spark, a, b, *args, **kw):
    return one(evaluation.matching(from_numpy(spark, np.array(a)), from_numpy(spark, np.array(b)), *args, **kw))


def test_matching_micro(spark):
    assert match(spark, [0, 1, 2, 3, 4], [0, 1, 0, 0, 0]) == {"precision": 0.25, "recall": 1.0, "segmentation_accuracy": 0.25, "f1": pytest.approx(0.4)}
    assert match(spark, [0, 0, 1, 1, 1, 2], [0, 0, 1, 1, 2, 2], 0.7)["f1"] == 0
    assert match(spark, [0, 0, 1, 1, 1, 2], [0, 0, 1, 1, 2, 2], 0.5)["f1"] == 1
    got = match(spark, [0, 1], [1, 2], ignore_label=0)
    assert got["precision"] == 1 and got["recall"] == 0.5 and got["f1"] == pytest.approx(2 / 3)
    assert match(spark, [0, 1], [1, 2], ignore_label=None)["f1"] == 1
    with pytest.raises(ValueError):
        match(spark, [0], [0], criterion="none")


def test_matching_is_maximum(spark, rng):
    """Against all assignments on a small graph with many ties."""
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    score = {}
    for i, j in itertools.product(range(1, 6), range(1, 6)):
        c = ((a == i) & (b == j)).sum()
        score[i, j] = c / ((a == i).sum() + (b == j).sum() - c)
    best = max(sum(score[i + 1, p] >= 0.1 for i, p in enumerate(perm)) for perm in itertools.permutations(range(1, 6)))
    assert match(spark, a, b, 0.1)["precision"] == pytest.approx(best / 5)


def test_points(spark):
    def pts(rows):
        return spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(rows)], "id long, y double, x double")

    got = one(evaluation.coordinate_matching(pts([(0, 0), (10, 0), (50, 50)]), pts([(0, 1), (10, 1)]), 2))
    assert got == {"precision": pytest.approx(2 / 3), "recall": 1.0, "segmentation_accuracy": pytest.approx(2 / 3), "f1": pytest.approx(0.8)}
    assert one(evaluation.coordinate_matching(pts([(0, 0)]), pts([(3, 4)]), 4))["f1"] == 0
    assert one(evaluation.coordinate_matching(pts([(0, 0)]), pts([(3, 4)]), 5))["f1"] == 1
    assert one(evaluation.coordinate_matching(pts([(0, 0)]), pts([(0, 3)]), 4, (1, 2)))["f1"] == 0
    assert one(evaluation.coordinate_matching(pts([]), pts([]), 4))["f1"] == 0


def test_dice(spark, rng):
    a, b = rng.integers(0, 5, (40, 40)), rng.integers(0, 5, (40, 40))
    got = one(evaluation.dice_score(from_numpy(spark, a), from_numpy(spark, b)))["dice"]
    assert got == pytest.approx(2 * ((a > 0) & (b > 0)).sum() / ((a > 0).sum() + (b > 0).sum()))
    s, t = rng.random((40, 40)), rng.random((40, 40))
    assert one(evaluation.dice_score(from_numpy(spark, s), from_numpy(spark, t), None, None))["dice"] == pytest.approx(2 * (s * t).sum() / (s.sum() + t.sum()))
    none = from_numpy(spark, np.zeros((40, 40), int))
    assert one(evaluation.dice_score(from_numpy(spark, a), from_numpy(spark, b), mask=none))["dice"] == 0


def test_relabel(spark, rng):
    a = rng.integers(0, 12, (33, 28)).astype("uint32")
    v = from_numpy(spark, a)
    table = {i: (5 * i + 1) % 97 if i else 0 for i in range(12)}
    want = np.vectorize(table.get)(a)
    assert (relabel.relabel(v, table).to_numpy() == want).all()
    assert (relabel.relabel(v, np.array([table[i] for i in range(12)])).to_numpy() == want).all()
    m = np.zeros(a.shape, "uint8")
    m[2:14, 3:15] = 1
    assert (relabel.relabel(v, table, from_numpy(spark, m)).to_numpy() == np.where(m, want, a)).all()
    with pytest.raises(Exception, match="no entry for id"):
        relabel.relabel(v, {0: 0}).df.collect()
    with pytest.raises(ValueError):
        relabel.relabel(from_numpy(spark, a * 1.0), table)
    b = from_numpy(spark, a * 7)
    for start, keep in ((0, True), (1, True), (1, False)):
        out, top, _ = relabel.relabel_consecutive(b, start, keep)
        new = a.astype(int) + start
        new = np.where(a == 0, 0, new) if keep else new
        assert (out.to_numpy() == new).all() and top == new.max()


def test_size_filter_micro(spark):
    a = np.zeros((20, 20), "uint32")
    a[0, 0], a[2:5, 2:5], a[8:16, 8:16] = 1, 7, 3
    v = from_numpy(spark, a)
    got = relabel.size_filter(v, 5).to_numpy()
    assert set(np.unique(got)) == {0, 1, 2} and got[0, 0] == 0 and got[3, 3] == 2 and got[9, 9] == 1
    assert set(np.unique(relabel.size_filter(v, 5, relabel=False).to_numpy())) == {0, 3, 7}
    assert set(np.unique(relabel.size_filter(v, max_size=9, relabel=False).to_numpy())) == {0, 1, 7}
    with pytest.raises(ValueError):
        relabel.size_filter(v)


def test_reductions_plan_partial_aggregates(spark):
    v = from_numpy(spark, np.ones((8, 8)))
    plan = stats.summary(v)._jdf.queryExecution().toString()
    assert "partial_max" in plan and "CartesianProduct" not in plan
    t = contingency.contingency_table(from_numpy(spark, np.ones((8, 8), int)), from_numpy(spark, np.ones((8, 8), int)))
    plan = t.pairs._jdf.queryExecution().toString()
    assert "partial_count" in plan and "NestedLoop" not in plan
