"""Every operator gives the same for a volume with and without rows for the voxels that hold its fill."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import components, contingency, distance, evaluation, graph, morphology, pointwise, relabel, resample, stats, stencil, stitching, views, watershed
from voxmill.volume import from_numpy, masked, select_blocks, write_masked

A = np.zeros((12, 20), "int32")
A[1:4, 2:7], A[6:8, 3:5], A[9:12, 15:20] = 1, 2, 5
B = np.zeros((12, 20), "int32")
B[2:5, 2:7], B[6:9, 12:16], B[9:12, 17:20] = 3, 1, 2
MASK = np.zeros((12, 20), "uint8")
MASK[:, 4:17] = 1


def both(spark, a, fill=0):
    dense = from_numpy(spark, a)
    return dense, replace(dense, df=dense.df.where(F.col("v") != fill), fill=fill, complete=False)


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module", params=[0, 5])
def forms(request, spark):
    """Pairs of (dense, sparse) for both arrays and the mask; the fill is background or an object."""
    fill = request.param
    return both(spark, A, fill), both(spark, B, 0), both(spark, MASK, 0)


def same(forms, f, mix=False):
    """``f(a, b, mask)`` on all combinations of forms against the dense one."""
    (a, a_), (b, b_), (m, m_) = forms
    want = f(a, b, m)
    for x, y, z in [(a_, b_, m_)] + [(a_, b, m), (a, b_, m_)] * mix:
        got = f(x, y, z)
        if isinstance(want, np.ndarray):
            np.testing.assert_allclose(got, want, rtol=1e-6)
        else:
            assert got == want
    return want


def test_reductions(forms):
    same(forms, lambda a, b, m: np.array(stats.summary(a).first(), float))
    same(forms, lambda a, b, m: np.array(stats.summary(a, m).first(), float))
    same(forms, lambda a, b, m: [tuple(r) for r in stats.unique(a, True).collect()])
    same(forms, lambda a, b, m: [tuple(r) for r in stats.unique(a, True, m).collect()])
    assert same(forms, lambda a, b, m: stats.mean_and_std(a)[0], mix=False) == pytest.approx(A.mean())


def test_tables_and_scores(forms):
    assert same(forms, lambda a, b, m: rows(contingency.contingency_table(a, b).pairs), mix=True) == sorted([(int(i), int(j), int(n)) for (i, j), n in zip(*np.unique(np.stack([A.ravel(), B.ravel()], 1), axis=0, return_counts=True))], key=str)
    same(forms, lambda a, b, m: rows(contingency.contingency_table(a, b, m).pairs))
    for f in (evaluation.variation_of_information, evaluation.rand_index, evaluation.cremi_score, evaluation.symmetric_best_dice_score, evaluation.dice_score):
        same(forms, lambda a, b, m, f=f: np.array(f(a, b).first(), float))
    same(forms, lambda a, b, m: np.array(evaluation.dice_score(a, b, None, None, m).first(), float))
    same(forms, lambda a, b, m: rows(evaluation.object_vi(a, b)))


def test_pointwise(forms):
    same(forms, lambda a, b, m: pointwise.add(a, b).to_numpy(), mix=True)
    same(forms, lambda a, b, m: pointwise.add(a, 3).to_numpy())
    same(forms, lambda a, b, m: pointwise.divide(a, b).to_numpy()[0])
    same(forms, lambda a, b, m: pointwise.subtract(a, b[0:1]).to_numpy())
    same(forms, lambda a, b, m: pointwise.greater(a, 1).to_numpy().astype(int))
    same(forms, lambda a, b, m: pointwise.apply_operation(a, b, lambda x, y: x * 2 - y).to_numpy())
    same(forms, lambda a, b, m: pointwise.add(a, b, mask=m, output=b).to_numpy())
    same(forms, lambda a, b, m: pointwise.isin(a, [0, 2]).to_numpy().astype(int))
    same(forms, lambda a, b, m: pointwise.isin(a, [5, *range(100, 120)], most_inline=3).to_numpy().astype(int))
    same(forms, lambda a, b, m: pointwise.copy(a, dtype="uint8", mask=m).to_numpy())
    same(forms, lambda a, b, m: write_masked(a, m, b).to_numpy())
    same(forms, lambda a, b, m: rows(masked(a, m)))


def test_views(forms):
    same(forms, lambda a, b, m: views.transform(a, lambda v: v * 2 + 1).to_numpy())
    same(forms, lambda a, b, m: views.transform(a, lambda v: v * 2 + 1, halo=1, block_shape=(4, 4)).to_numpy())
    same(forms, lambda a, b, m: views.transform_with_coordinates(a, lambda v, y, x: v + y * x).to_numpy())
    same(forms, lambda a, b, m: views.transform_many(lambda x, y: x * 10 + y, a, b).to_numpy())
    same(forms, lambda a, b, m: views.threshold(a, 1).to_numpy().astype(int))
    same(forms, lambda a, b, m: views.normalize(a, "float64", (4, 5)).to_numpy())
    same(forms, lambda a, b, m: views.pad(a, (2, 3), value=9).to_numpy())
    same(forms, lambda a, b, m: views.pad(views.roi(a, (slice(2, 11), slice(3, 18))), (2, 3), mode="edge").to_numpy())
    same(forms, lambda a, b, m: views.expand_dims(a, 0).to_numpy())
    same(forms, lambda a, b, m: rows(select_blocks(a, [0, 3], (4, 5)).df))


def test_labels(forms):
    same(forms, lambda a, b, m: relabel.relabel(a, {0: 7, 1: 3, 2: 2, 5: 9}).to_numpy())
    same(forms, lambda a, b, m: relabel.relabel(a, {0: 7, 1: 3, 2: 2, 5: 9}, mask=m).to_numpy())
    same(forms, lambda a, b, m: relabel.relabel_consecutive(a, 3)[0].to_numpy())
    same(forms, lambda a, b, m: relabel.relabel_consecutive(a, 1, keep_zeros=False)[0].to_numpy())
    same(forms, lambda a, b, m: relabel.size_filter(a, 5, 14).to_numpy())
    same(forms, lambda a, b, m: relabel.segmentation_filter(a, lambda x, i: np.where(x > 1, x, 0), (5, 7)).to_numpy())
    same(forms, lambda a, b, m: components.label(a).to_numpy())
    same(forms, lambda a, b, m: components.label(a, 1, mask=m).to_numpy())
    same(forms, lambda a, b, m: rows(morphology.regionprops(a)))
    same(forms, lambda a, b, m: rows(morphology.morphology(a, m)))
    same(forms, lambda a, b, m: rows(graph.region_adjacency(a)))
    (_, sparse), _, _ = forms
    if sparse.fill == 0:
        with pytest.raises(ValueError):
            relabel.relabel(sparse, {1: 1, 2: 2, 5: 5})


def test_blocks(forms):
    same(forms, lambda a, b, m: stencil.gaussian_smoothing(a, 1.0, block_shape=(4, 7)).to_numpy())
    same(forms, lambda a, b, m: stencil.apply_filter(a, "hessian_of_gaussian_eigenvalues", 1.0, block_shape=(6, 10), mask=m).to_numpy())
    same(forms, lambda a, b, m: rows(stencil.find_local_maxima(a, 1)))
    same(forms, lambda a, b, m: distance.distance_transform(a, 4, block_shape=(4, 7)).to_numpy())
    same(forms, lambda a, b, m: distance.exact_distance_transform(a).to_numpy())
    same(forms, lambda a, b, m: watershed.watershed(a, b, halo=4, block_shape=(6, 10)).to_numpy(), mix=True)
    same(forms, lambda a, b, m: resample.resize(a, (24, 30), 1).to_numpy())
    same(forms, lambda a, b, m: resample.downsample(a, 2).to_numpy())
    same(forms, lambda a, b, m: stitching.stitch_tiled_segmentation(a, (6, 10)).to_numpy())
    points = forms[0][0].spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 4.0), (3, 11.0, 12.0)], "id long, y double, x double")
    same(forms, lambda a, b, m: rows(distance.map_points_to_objects(a, points, 4.0)))


def test_the_readme_example(spark):
    image = np.zeros((4, 4))
    image[0, 0], image[2, 2:] = 1, 1
    truth = np.zeros((4, 4), "int64")
    truth[0, 0], truth[1:, 1:] = 1, 2
    objects = components.label(from_numpy(spark, image), threshold=0.5)
    dense = from_numpy(spark, objects.to_numpy())
    assert contingency.contingency_table(objects, from_numpy(spark, truth)).n_points() == 16
    for f in (evaluation.variation_of_information, evaluation.dice_score):
        assert tuple(f(objects, from_numpy(spark, truth)).first()) == pytest.approx(tuple(f(dense, from_numpy(spark, truth)).first()))
    assert stats.mean(objects) == pytest.approx(dense.to_numpy().mean())
