"""Components, stencils, distances, resampling, objects, graphs and stitching against plain numpy."""

import heapq
import itertools
import math

import numpy as np
import pytest

from voxmill.operators import components, distance, graph, morphology, resample, stencil, stitching, watershed
from voxmill.volume import from_numpy


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(42)


def flood_fill(fg, connectivity=1):
    lab, n = np.zeros(fg.shape, int), 0
    steps = [s for s in itertools.product((-1, 0, 1), repeat=fg.ndim) if 0 < sum(map(abs, s)) <= connectivity]
    for start in zip(*np.nonzero(fg)):
        if lab[start]:
            continue
        n += 1
        lab[start], todo = n, [start]
        while todo:
            p = todo.pop()
            for s in steps:
                q = tuple(i + j for i, j in zip(p, s))
                if all(0 <= i < e for i, e in zip(q, fg.shape)) and fg[q] and not lab[q]:
                    lab[q] = n
                    todo.append(q)
    return lab


@pytest.mark.parametrize("shape,connectivity", [((37, 41), 1), ((20, 23), 2), ((10, 11, 9), 1), ((8, 9, 10), 3), ((50,), 1)])
def test_label(spark, rng, shape, connectivity):
    fg = rng.random(shape) > 0.6
    assert (components.label(from_numpy(spark, fg.astype("uint8")), connectivity=connectivity).to_numpy() == flood_fill(fg, connectivity)).all()


def test_label_of_lines_longer_than_a_run(spark, rng, monkeypatch):
    monkeypatch.setattr(components, "RUN", 8)
    for shape in ((70,), (6, 30)):
        fg = rng.random(shape) > 0.3
        assert (components.label(from_numpy(spark, fg.astype("uint8"))).to_numpy() == flood_fill(fg)).all()


def test_label_threshold_mask_and_errors(spark, rng):
    a = rng.random((30, 30))
    m = np.zeros(a.shape, "uint8")
    m[5:25, 5:25] = 1
    v = from_numpy(spark, a)
    assert (components.label(v, 0.5, mask=from_numpy(spark, m)).to_numpy() == flood_fill((a > 0.5) & (m > 0))).all()
    assert components.label(v, 2.0).to_numpy().max() == 0
    with pytest.raises(ValueError):
        components.label(v, connectivity=3)


def reflect(a, kernel, axis):
    r = len(kernel) // 2
    idx = np.arange(-r, a.shape[axis] + r)
    n = a.shape[axis]
    idx = np.where(idx < 0, -1 - idx, idx)
    idx = np.where(idx >= n, 2 * n - 1 - idx, idx)
    wide = np.take(a, idx, axis)
    return sum(w * np.take(wide, np.arange(k, k + n), axis) for k, w in enumerate(kernel[::-1]))


def smooth(a, sigma, orders):
    for axis, o in enumerate(orders):
        a = reflect(a, stencil.gaussian_kernel(sigma, o), axis)
    return a


@pytest.mark.parametrize("block", [(48, 50), (16, 16), (13, 17)])
def test_filters_do_not_depend_on_blocks(spark, rng, block):
    a = rng.random((48, 50))
    v = from_numpy(spark, a, block)
    gy, gx = smooth(a, 2.0, (1, 0)), smooth(a, 2.0, (0, 1))
    assert np.allclose(stencil.gaussian_smoothing(v, 2.0).to_numpy(), smooth(a, 2.0, (0, 0)))
    assert np.allclose(stencil.gaussian_gradient_magnitude(v, 2.0).to_numpy(), np.hypot(gy, gx))
    assert np.allclose(stencil.laplacian_of_gaussian(v, 2.0).to_numpy(), smooth(a, 2.0, (2, 0)) + smooth(a, 2.0, (0, 2)))
    ev = stencil.apply_filter(v, "structure_tensor_eigenvalues", 2.0, outer_scale=2.0).to_numpy()
    t = [smooth(p, 2.0, (0, 0)) for p in (gy * gy, gy * gx, gx * gx)]
    root = np.sqrt(((t[0] - t[2]) / 2) ** 2 + t[1] ** 2)
    assert ev.shape == (2, 48, 50) and np.allclose(ev, np.stack([(t[0] + t[2]) / 2 + root, (t[0] + t[2]) / 2 - root]))


def test_filter_contract(spark, rng):
    y = np.arange(40.0)[:, None] + np.zeros((1, 30))
    assert np.allclose(stencil.gaussian_gradient_magnitude(from_numpy(spark, y), 1.5).to_numpy()[8:-8], 1)
    assert np.allclose(stencil.laplacian_of_gaussian(from_numpy(spark, y * y), 1.5).to_numpy()[8:-8], 2)
    v = from_numpy(spark, rng.random((8, 8)).astype("float32"))
    assert stencil.gaussian_smoothing(v, 1).dtype == "float32"
    with pytest.raises(ValueError):
        stencil.apply_filter(v, "none", 1)
    with pytest.raises(ValueError):
        stencil.apply_filter(v, "structure_tensor_eigenvalues", 1)
    assert stencil.sigma_to_halo((2.0, 1.0), 1) == (2 * math.ceil(7), 2 * math.ceil(4))
    h = stencil.apply_filter(from_numpy(spark, rng.random((9, 8, 7))), "hessian_of_gaussian_eigenvalues", 1.0, block_shape=(5, 5, 5)).to_numpy()
    assert h.shape == (3, 9, 8, 7) and (h[0] >= h[1]).all() and (h[1] >= h[2]).all()


def brute_edt(fg, step):
    bg = np.argwhere(~fg)
    d = ((np.argwhere(fg)[:, None] - bg[None]) * step) ** 2
    out = np.zeros(fg.shape)
    out[fg] = np.sqrt(d.sum(2).min(1))
    return out


def test_distance_transform(spark, rng):
    fg = rng.random((32, 30)) > 0.15
    v, want = from_numpy(spark, fg.astype("uint8")), brute_edt(fg, (1, 2))
    dist, index = distance.distance_transform(v, 12, (1, 2), return_indices=True, block_shape=(16, 16))
    assert np.allclose(dist.to_numpy(), want) and dist.dtype == "float32" and index.dtype == "int32"
    at = index.to_numpy()
    assert not fg[tuple(at)].any()
    gap = (np.indices(fg.shape) - at) * np.array([1, 2]).reshape(-1, 1, 1)
    assert np.allclose(np.sqrt((gap**2).sum(0)), want)
    assert np.allclose(distance.exact_distance_transform(v, (1, 2)).to_numpy(), want)
    vol = rng.random((7, 8, 9)) > 0.2
    assert np.allclose(distance.exact_distance_transform(from_numpy(spark, vol.astype("uint8"))).to_numpy(), brute_edt(vol, (1, 1, 1)))
    assert np.isinf(distance.distance_transform(from_numpy(spark, np.ones((4, 4), int)), 2).to_numpy()).all()


def test_points_to_objects(spark):
    seg = np.zeros((40, 40), int)
    seg[5:10, 5:10], seg[30:35, 30:35] = 1, 2
    pts = spark.createDataFrame([(0, 7.0, 7.0), (1, 32.0, 32.0), (2, 12.0, 12.0), (3, 0.0, 39.0)], "id long, y double, x double")
    got = {r["id"]: (r["label"], r["distance"]) for r in distance.map_points_to_objects(from_numpy(spark, seg), pts, 18).collect()}
    assert got[0] == (1, 0) and got[1] == (2, 0) and got[2] == (1, pytest.approx(math.sqrt(18))) and got[3] == (0, math.inf)


def test_local_maxima(spark, rng):
    a = smooth(rng.random((50, 48)), 1.5, (0, 0))
    got = {(r["y"], r["x"]) for r in stencil.find_local_maxima(from_numpy(spark, a), 3, 0.5).collect()}
    want = {(y, x) for y in range(3, 47) for x in range(3, 45) if a[y, x] > 0.5 and a[y, x] == a[y - 3 : y + 4, x - 3 : x + 4].max()}
    assert got == want and got


def plain_flood(h, seeds):
    lab, heap, n = seeds.copy(), [], 0
    for p in zip(*np.nonzero(seeds)):
        heapq.heappush(heap, (h[p], n, p))
        n += 1
    while heap:
        level, _, p = heapq.heappop(heap)
        for axis in range(h.ndim):
            for d in (-1, 1):
                q = tuple(v + d * (i == axis) for i, v in enumerate(p))
                if all(0 <= v < e for v, e in zip(q, h.shape)) and not lab[q]:
                    lab[q] = lab[p]
                    heapq.heappush(heap, (max(level, h[q]), n, q))
                    n += 1
    return lab


def test_watershed(spark, rng):
    h = smooth(rng.random((24, 25)), 2.0, (0, 0))
    seeds = np.zeros(h.shape, "uint32")
    seeds[tuple(rng.integers(0, 24, (2, 8)))] = np.arange(1, 9)
    v, s = from_numpy(spark, h), from_numpy(spark, seeds)
    got = watershed.watershed(v, s).to_numpy()
    assert (got > 0).all() and (got[seeds > 0] == seeds[seeds > 0]).all()
    assert (got == plain_flood(h, seeds.astype(int))).mean() > 0.98  # ties may go either way
    with pytest.raises(ValueError):
        watershed.watershed(v, s, block_shape=(12, 12))
    blocked = watershed.watershed(v, s, halo=24, block_shape=(12, 12)).to_numpy()
    assert (blocked == got).all()
    m = np.zeros(h.shape, "uint8")
    m[:12] = 1
    assert (watershed.watershed(v, s, mask=from_numpy(spark, m)).to_numpy()[12:] == 0).all()


def test_morphology_and_regionprops(spark, rng):
    for shape, res in (((24, 30), (2.0, 1.0)), ((8, 10, 12), (2.0, 1.0, 1.5))):
        lab = flood_fill(smooth(rng.random(shape), 1.2, (0,) * len(shape)) > 0.52)
        v = from_numpy(spark, lab)
        rows = {r["label"]: r for r in morphology.regionprops(v, resolution=res).collect()}
        assert set(rows) == set(range(1, lab.max() + 1))
        for k, r in rows.items():
            at = np.argwhere(lab == k)
            assert r["n_voxels"] == len(at) and r["area"] == pytest.approx(len(at) * np.prod(res))
            assert [r[f"bb_min_{a}"] for a in v.axes] == at.min(0).tolist() and [r[f"bb_max_{a}"] for a in v.axes] == (at.max(0) + 1).tolist()
            cov = np.cov((at * res).T, bias=True)
            e = np.sort(np.linalg.eigvalsh(np.trace(cov) * np.eye(len(shape)) - cov))[::-1].clip(0)
            want = (4 * np.sqrt(e[0]), 4 * np.sqrt(e[1])) if len(shape) == 2 else (np.sqrt(10 * max(0, e[0] + e[1] - e[2])), np.sqrt(10 * max(0, -e[0] + e[1] + e[2])))
            assert r["axis_major_length"] == pytest.approx(want[0], abs=1e-6) and r["axis_minor_length"] == pytest.approx(want[1], abs=1e-4)
            com = at.mean(0)
            if lab[tuple(np.rint(com).astype(int))] == k:
                assert [r[f"centroid_{a}"] for a in v.axes] == pytest.approx((com * res).tolist())
    assert morphology.morphology(from_numpy(spark, np.zeros((10, 12), int))).columns == ["label", "size", "com_y", "com_x", "bb_min_y", "bb_min_x", "bb_max_y", "bb_max_x"]
    assert morphology.regionprops(from_numpy(spark, np.zeros((10, 12), int))).count() == 0
    with pytest.raises(ValueError):
        morphology.regionprops(from_numpy(spark, np.ones((3, 3), int)), spark.range(1))
    with pytest.raises(ValueError):
        morphology.morphology(from_numpy(spark, np.ones((3, 3))))


def test_regionprops_of_some_rows_and_to_a_file(spark, tmp_path):
    from voxmill.sources import read_table

    vol = from_numpy(spark, np.array([[1, 1, 0], [0, 4, 4], [7, 0, 9]]))
    assert [r["label"] for r in morphology.regionprops(vol, item_ids=[1, 3]).collect()] == [4, 9]
    out = morphology.regionprops(vol, output_path=str(tmp_path / "p.csv"))
    assert [r["label"] for r in out.collect()] == [1, 4, 7, 9]
    assert sorted((r["label"], r["n_voxels"]) for r in read_table(spark, str(tmp_path / "p.csv")).collect()) == [(1, 2), (4, 2), (7, 1), (9, 1)]


def test_channels_of_a_view(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from voxmill.operators import views

    a = np.arange(24).reshape(3, 2, 4) % 5
    dense = from_numpy(spark, a)
    for vol in (dense, replace(dense, df=dense.df.where("v <> 2"), fill=2, complete=False)):
        out = views.transform(vol, lambda c: c[0] * 10 + c[2] - c[1] + 1, with_channels=True)
        assert out.shape == (2, 4) and (out.to_numpy() == a[0] * 10 + a[2] - a[1] + 1).all()
    with pytest.raises(ValueError):
        views.transform(dense, lambda c: F.lit(1), halo=1, with_channels=True)


def test_centroid_of_a_hollow_object_moves_inside(spark):
    a = np.zeros((6, 24, 24), int)
    a[:, 2:22, 2:8] = a[:, 2:6, 2:22] = a[:, 18:22, 2:22] = 7
    r = morphology.regionprops(from_numpy(spark, a), resolution=(3, 1, 1)).first()
    at = tuple(int(round(r[f"centroid_{x}"] / s)) for x, s in zip("zyx", (3, 1, 1)))
    assert a[at] == 7
    com = np.argwhere(a == 7).mean(0)
    assert a[tuple(np.rint(com).astype(int))] == 0


def test_surface_area(spark):
    a = np.zeros((10, 10, 12), int)
    a[2:6, 2:6, 2:6] = 1
    a[8, 8, 8] = 2
    got = {r["label"]: r["surface_area"] for r in morphology.surface_area(from_numpy(spark, a), (1, 1, 1)).collect()}
    assert got[2] == pytest.approx(8 * math.sqrt(3) / 8)  # an octahedron
    assert got[1] == pytest.approx(6 * 9 + 12 * 3 * math.sqrt(0.5) + 8 * math.sqrt(3) / 8)  # faces, bevelled edges, corners
    table = morphology.surface_areas((1.0, 1.0, 1.0))
    assert len(table) == 256 and table[0] == table[255] == 0 and min(table[1:255]) > 0


def linear(a, pts):
    out = []
    for p in pts:
        low = [min(int(math.floor(c)), n - 2) for c, n in zip(p, a.shape)]
        out.append(sum(a[tuple(l + d for l, d in zip(low, ds))] * np.prod([1 - abs(c - l - d) for c, l, d in zip(p, low, ds)]) for ds in itertools.product((0, 1), repeat=a.ndim)))
    return np.array(out)


def test_resampling(spark, rng):
    a = rng.random((12, 10))
    v = from_numpy(spark, a)
    assert np.allclose(resample.downsample(v, 2).to_numpy(), a[::2, ::2])
    assert resample.downscale_shape((37, 41, 23), 2) == (19, 21, 12) and resample.downscale_shape((37,), 2, False) == (18,)
    up = resample.resize(v, (24, 20), 1).to_numpy()
    pts = [(min(y / 2, 11), min(x / 2, 9)) for y in range(24) for x in range(20)]
    assert np.allclose(up.ravel(), linear(a, pts))
    smooth3 = np.sin(np.arange(20) / 3)[:, None] * np.cos(np.arange(18) / 4)[None]
    for order in (2, 3, 4, 5):
        m = [[1, 0, 0.5], [0, 1, 0.25], [0, 0, 1]]
        got = resample.affine(from_numpy(spark, smooth3), (18, 16), affine_matrix=m, order=order).to_numpy()
        want = np.sin((np.arange(18) + 0.5) / 3)[:, None] * np.cos((np.arange(16) + 0.25) / 4)[None]
        assert np.abs(got - want)[4:-4, 4:-4].max() < 2e-3, order
        same = resample.affine(from_numpy(spark, smooth3), (20, 18), affine_matrix=np.eye(3), order=order).to_numpy()
        assert np.allclose(same, smooth3, atol=1e-6)  # splines interpolate
    turned = resample.affine(v, (10, 12), affine_matrix=[[0, 1, 0], [1, 0, 0], [0, 0, 1]]).to_numpy()
    assert np.allclose(turned, a.T)
    outside = resample.affine(v, (4, 4), translation=[100.0, 0.0], order=1, fill_value=7).to_numpy()
    assert (outside == 7).all()
    flags = from_numpy(spark, a > 0.5)
    assert (resample.downsample(flags, (1, 2)).to_numpy() == (a > 0.5)[:, ::2]).all()
    for bad in ({"affine_matrix": np.eye(3), "scale": [1, 1]}, {}):
        with pytest.raises(ValueError):
            resample.affine(v, (3, 3), **bad)
    with pytest.raises(ValueError):
        resample.downsample(v, 0.5)


def test_affine_matrices():
    assert np.allclose(resample.compute_affine_matrix(scale=[2, 3]), np.diag([2, 3, 1]))
    assert np.allclose(resample.compute_affine_matrix(rotation=[90]), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    want = np.eye(4)
    want[:3, 3] = 1, 2, 3
    assert np.allclose(resample.compute_affine_matrix(translation=[1, 2, 3]), want)
    assert resample.transform_coordinate((1, 2), np.diag([2, 3, 1])) == (2, 6)
    c, s = (lambda d: math.cos(math.radians(d))), (lambda d: math.sin(math.radians(d)))
    first = np.array([[1, 0, 0], [0, c(20), -s(20)], [0, s(20), c(20)]])
    second = np.array([[c(35), 0, s(35)], [0, 1, 0], [-s(35), 0, c(35)]])
    third = np.array([[c(50), -s(50), 0], [s(50), c(50), 0], [0, 0, 1]])
    got = resample.compute_affine_matrix(scale=[1, 2, 3], rotation=[20, 35, 50])
    assert np.allclose(got[:3, :3], third @ second @ first @ np.diag([1, 2, 3])) and np.allclose(got[3], [0, 0, 0, 1])
    assert resample.transform_roi_with_affine((0, 0), (2, 2), np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])) == ([-2, 0], [0, 2])


def cut_cost(edges, label):
    return sum(c for u, v, c in edges if label[u] != label[v])


def test_multicut(spark, rng):
    for _ in range(3):
        n = 6
        edges = [(u, v, float(rng.normal())) for u in range(n) for v in range(u) if rng.random() < 0.6]
        best = min(cut_cost(edges, lab) for lab in itertools.product(range(n), repeat=n))
        nodes = sorted({x for e in edges for x in e[:2]})
        for f in graph.SOLVERS.values():
            got = f(edges)
            assert set(got) == set(nodes) and best - 1e-9 <= cut_cost(edges, got) <= max(0.6 * best, best + 1.5)
    df = spark.createDataFrame([(1, 2, 2.0), (2, 3, -3.0), (3, 4, 1.5), (1, 5, -0.5), (6, 7, 1.0)], "u long, v long, cost double")
    for f in (graph.multicut_gaec, graph.multicut_kernighan_lin, graph.multicut_decomposition):
        assert {r["node"]: r["cluster"] for r in f(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}
    with pytest.raises(ValueError):
        graph.multicut_decomposition(df, "none")


def test_kernighan_lin_moves_groups_and_joins_clusters(rng):
    # two tied pairs in two clusters attract each other, but no single node gains by moving
    edges = [(0, 1, 5.0), (2, 3, 5.0), (0, 2, 1.0), (1, 3, 1.0)]
    assert len(set(graph.kernighan_lin(edges, {0: "a", 1: "a", 2: "b", 3: "b"}).values())) == 1
    # a tied pair belongs to the other cluster
    edges = [(0, 1, 3.0), (2, 3, 5.0), (4, 5, 3.0), (0, 4, -9.0), (1, 2, -2.0), (0, 3, -2.0), (2, 4, 1.0), (3, 5, 1.0)]
    got = graph.kernighan_lin(edges, {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1})
    assert got[0] == got[1] != got[2] == got[3] == got[4] == got[5]
    # a cluster splits in the middle
    edges = [(0, 1, 3.0), (2, 3, 3.0), (0, 2, -1.0), (1, 3, -1.0)]
    got = graph.kernighan_lin(edges, dict.fromkeys(range(4), 0))
    assert got[0] == got[1] != got[2] == got[3]
    for _ in range(20):
        edges = [(u, v, float(rng.normal())) for u in range(30) for v in range(u) if rng.random() < 0.2]
        first = graph.greedy_additive(edges)
        got = graph.kernighan_lin(edges, first)
        assert cut_cost(edges, got) <= cut_cost(edges, first) + 1e-9
        for a, b in itertools.combinations(set(got.values()), 2):  # no union gains
            assert sum(c for u, v, c in edges if {got[u], got[v]} == {a, b}) <= 1e-6


def test_edge_costs(spark):
    rows = [(0.1, 4, True), (0.9, 8, False), (0.5, 2, False)]
    df = spark.createDataFrame(rows, "p double, size long, is_z boolean")
    plain = [math.log((1 - q) / q) for q in (0.998 * p + 0.001 for p, _, _ in rows)]

    def costs(scheme, **kw):
        return [r["cost"] for r in sorted(graph.compute_edge_costs(df, weighting_scheme=scheme, **kw).collect(), key=lambda r: [x[0] for x in rows].index(r["p"]))]

    assert costs(None) == pytest.approx(plain)
    assert costs("all") == pytest.approx([c * s / 8 for c, (_, s, _) in zip(plain, rows)])
    assert costs("xyz") == pytest.approx([plain[0], plain[1], plain[2] / 4])
    assert costs("z") == pytest.approx([plain[0], plain[1] / 4, plain[2] / 4])
    assert costs(None, beta=0.3) == pytest.approx([c + math.log(0.7 / 0.3) for c in plain])
    with pytest.raises(ValueError):
        graph.compute_edge_costs(df.drop("size"), weighting_scheme="all")


def adapted_rand(a, b):
    c = np.unique(np.stack([a.ravel(), b.ravel()]), axis=1, return_counts=True)[1].astype(float)
    sa, sb = (np.unique(x, return_counts=True)[1].astype(float) for x in (a, b))
    p, r = (c**2).sum() / (sa**2).sum(), (c**2).sum() / (sb**2).sum()
    return 1 - 2 * p * r / (p + r)


def test_overlaps_count_relative_to_the_object_behind_the_face(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stitching, "_stitch", lambda seg, overlaps, *_: seen.append({(r["u"], r["v"]): r["fraction"] for r in overlaps.collect()}) or seg)
    a = np.zeros((8, 12), int)
    a[:, :6], a[1:5, 6:] = 1, 2
    a[5:7, 6:] = 3
    a[0, 4:6] = 4  # not behind the face of 2 or 3
    stitching.stitch_tiled_segmentation(from_numpy(spark, a), (8, 6))
    assert seen.pop() == {(1, 2): 1.0, (1, 3): 1.0}  # of the lower object they would be 4 / 7 and 2 / 7
    b = np.zeros((8, 12), int)
    b[2:4, :6], b[:, 6:] = 1, 2
    stitching.stitch_tiled_segmentation(from_numpy(spark, b), (8, 6), overlap=2)
    assert seen.pop() == {(1, 2): 0.25}

    def segment(tile, number):  # the first tile sees one object, the second two of unequal size
        out = np.ones(tile.shape, int)
        if number:
            out[:2] = 2
        return out

    stitching.stitch_segmentation(from_numpy(spark, np.ones((8, 12), "uint8")), segment, (8, 6), 2)
    assert set(seen.pop().values()) == {1.0}


def test_stitching_with_channels(spark):
    rng = np.random.default_rng(5)
    a = smooth(rng.random((40, 40)), 2.0, (0, 0)) > 0.5
    many = np.stack([a, ~a, a * 3], axis=-1).astype("uint8")

    def segment(tile, number):
        assert tile.shape[2] == 3 and (tile[..., 0] + tile[..., 1] == 1).all()
        return flood_fill(tile[..., 0] > 0)

    got, raw = stitching.stitch_segmentation(from_numpy(spark, many), segment, (20, 20), 8, shape=a.shape, return_before_stitching=True)
    assert got.shape == raw.shape == a.shape and got.axes == ("y", "x")
    got = got.to_numpy()
    assert ((got == 0) == ~a).all() and adapted_rand(got, flood_fill(a)) <= 0.05
    with pytest.raises(ValueError):
        stitching.stitch_segmentation(from_numpy(spark, many), segment, (20, 20), 8, shape=(40, 30))


def test_stitching(spark):
    rng = np.random.default_rng(17)
    a = smooth(rng.random((64, 64)), 3.0, (0, 0)) > 0.5
    want = flood_fill(a)

    def segment(tile, number):
        return flood_fill(tile > 0)

    got = stitching.stitch_segmentation(from_numpy(spark, a.astype("uint8")), segment, (32, 32), 8).to_numpy()
    assert ((got == 0) == ~a).all() and adapted_rand(got, want) <= 0.01
    tiled, n = np.zeros(a.shape, int), 0
    for i, j in itertools.product((0, 32), repeat=2):
        part = flood_fill(a[i : i + 32, j : j + 32])
        tiled[i : i + 32, j : j + 32] = np.where(part, part + n, 0)
        n += part.max()
    out = stitching.stitch_tiled_segmentation(from_numpy(spark, tiled), (32, 32)).to_numpy()
    assert ((out == 0) == ~a).all() and adapted_rand(out, want) <= 0.05


def test_region_adjacency(spark):
    a = np.array([[1, 1, 2], [1, 3, 2], [3, 3, 2]])
    assert {tuple(r) for r in graph.region_adjacency(from_numpy(spark, a)).collect()} == {(1, 2, 1), (1, 3, 3), (2, 3, 2)}
