"""Resizing, affine maps and coordinate fields: output voxels look their input voxels up by equi-joins."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators.stencil import map_blocks, per_axis
from voxmill.volume import Volume, grid, spark_type


def downscale_shape(shape: Sequence[int], scale_factor, ceil_mode: bool = True) -> tuple[int, ...]:
    factors = [int(f) for f in per_axis(scale_factor, len(shape))]
    return tuple(s // f + (1 if ceil_mode and s % f else 0) for s, f in zip(shape, factors))


def compute_affine_matrix(scale=None, rotation=None, shear=None, translation=None) -> np.ndarray:
    """Homogeneous matrix of translation, rotation (a list of degrees: one in 2D, three in 3D), shear (2D) and scale."""
    given = [len(v) for v in (scale, shear, translation) if v is not None]
    if rotation is not None:
        given.append(3 if len(rotation) == 3 else given[0] if given else 2)
    if not given:
        raise ValueError("give a scale, rotation, shear or translation")
    n = given[0]
    if n not in (2, 3):
        raise ValueError("affine maps have two or three axes")
    angle = [math.radians(a) for a in (rotation or [0.0] * (1 if n == 2 else 3))]
    m = np.eye(n + 1)
    turn = np.eye(n + 1)
    size = list(scale) if scale is not None else [1.0] * n
    if n == 2:
        lean = math.radians(shear[0]) if shear is not None else 0.0
        t = angle[0]
        turn[:2, :2] = [[size[0] * math.cos(t), -size[1] * math.sin(t + lean)], [size[0] * math.sin(t), size[1] * math.cos(t + lean)]]
        m = turn
    else:
        # the first angle turns about the first axis, and so on, in that order; each turns the axis after its own to the next
        for i, t in enumerate(angle):
            r, a, b = np.eye(4), (i + 1) % 3, (i + 2) % 3
            r[a, a], r[a, b], r[b, a], r[b, b] = math.cos(t), -math.sin(t), math.sin(t), math.cos(t)
            turn = r @ turn
        m = turn @ np.diag([*size, 1.0])
    if translation is not None:
        m[:n, n] = translation
    return m


def transform_coordinate(point: Sequence[float], matrix: np.ndarray) -> tuple[float, ...]:
    return tuple((np.asarray(matrix) @ np.array([*point, 1.0]))[:-1].tolist())


def transform_roi_with_affine(start: Sequence[float], stop: Sequence[float], matrix: np.ndarray) -> tuple[list[float], list[float]]:
    """The box around the mapped corners."""
    pts = np.array([transform_coordinate(c, matrix) for c in itertools.product(*zip(start, stop))])
    return pts.min(0).tolist(), pts.max(0).tolist()


def bspline(x: Column, order: int) -> Column:
    """The centered B-spline of an order at x: a sum of truncated powers."""
    if order == 0:
        return ((x >= -0.5) & (x < 0.5)).cast("double")
    out = F.lit(0.0)
    for k in range(order + 2):
        part = F.greatest(x + ((order + 1) / 2 - k), F.lit(0.0))
        out = out + F.pow(part, F.lit(float(order))) * ((-1) ** k * math.comb(order + 1, k) / math.factorial(order))
    return out


def spline_prefilter(order: int, reach: int = 24) -> np.ndarray:
    """Weights that turn samples into B-spline coefficients: the inverse of the sampled spline, cut at ``reach``."""
    half = order // 2
    b = [sum((-1) ** k * math.comb(order + 1, k) * max(0.0, x + (order + 1) / 2 - k) ** order for k in range(order + 2)) / math.factorial(order) for x in range(-half, half + 1)]
    m = np.zeros((4 * reach + 1,) * 2)
    for i in range(len(m)):
        for d, w in zip(range(-half, half + 1), b):
            if 0 <= i + d < len(m):
                m[i, i + d] = w
    return np.linalg.inv(m)[2 * reach, reach : 3 * reach + 1]


def _coefficients(vol: Volume, order: int) -> Volume:
    w = spline_prefilter(order)

    def run(a, m):
        out = a.astype(float)
        for axis in range(a.ndim):
            pads = [(len(w) // 2,) * 2 if i == axis else (0, 0) for i in range(a.ndim)]
            wide = np.pad(out, pads, mode="reflect" if a.shape[axis] > 1 else "edge")
            view = np.lib.stride_tricks.sliding_window_view(wide, len(w), axis=axis)
            out = view @ w
        return out

    return map_blocks(vol, run, halo=len(w) // 2, dtype="float64")


#: Values in a block of voxels that lie in one row, and points or voxels in a task.
BLOCK, TASK = 4096, 400_000


def _mirror(t: Column, n: int) -> Column:
    """The voxel that lies at index ``t``, beyond the ends 0 and ``n``, too."""
    if n == 0:
        return t * 0
    r = F.pmod(t, F.lit(2 * n))
    return F.when(r > n, 2 * n - r).otherwise(r)


def _images(s: Column, n: int, pad: int) -> Column:
    """Indices from -pad to n + pad at which voxel ``s`` lies."""
    if n <= pad:
        return F.filter(F.sequence(F.lit(-pad).cast("bigint"), F.lit(n + pad).cast("bigint")), lambda t: _mirror(t, n) == s)
    return F.filter(F.array(s, F.when((s > 0) & (s <= pad), -s), F.when((s < n) & (s >= n - pad), 2 * n - s)), lambda t: t.isNotNull())


def sample(vol: Volume, at: DataFrame, keys: Sequence[str], where: dict[str, Column], order: int = 0, fill_value: float = 0, points: int | None = None) -> DataFrame:
    """Values of ``vol`` at real coordinates ``where[axis]`` of each row of ``at``: its ``keys`` and ``v``.

    Order 0 takes floor(c + 1/2), order 1 the two voxels around, orders 2 to 5 the spline's
    support of prefiltered voxels. Coordinates outside the array give ``fill_value``. Voxels are
    packed to blocks, an array with the voxels that follow it as far as taps reach, and each point
    meets the one block that has all its taps: no row per tap. The number of tasks follows
    ``points``, about how many there are (as many as voxels by default).
    """
    if not 0 <= order <= 5:
        raise ValueError("orders are 0 to 5")
    axes, last = vol.axes, {a: n - 1 for a, n in zip(vol.axes, vol.shape)}
    eps = 1e-9
    inside = reduce(lambda p, q: p & q, [(F.col(f"_p_{a}") >= -eps - (0.5 if order == 0 else 0)) & (F.col(f"_p_{a}") <= last[a] + eps + (0.5 - 2 * eps if order == 0 else 0)) for a in axes])
    held = (_coefficients(vol, order) if order > 1 else vol).df.select(*axes, F.col("v").alias("_v"))
    kind = dict(held.dtypes)["_v"]
    span = {a: 1 if order == 0 or (order == 1 and last[a] == 0) else order + 1 for a in axes}
    # taps of points inside start at -pad at the earliest and end at last + pad
    pad = order // 2 + 1 if order > 1 else 0
    side = max(8, round(BLOCK ** (1 / vol.ndim)))
    width = {a: min(side, last[a] + 2 * pad + 1) for a in axes}
    blocks = {a: (last[a] + 2 * pad) // width[a] + 1 for a in axes}
    wide = {a: width[a] + span[a] - 1 for a in axes}
    points = vol.size if points is None else points
    # many points per voxel: blocks are laid out several times, so that no block has to meet them all
    copies = max(1, points // (16 * max(1, vol.size)))
    tasks = max(vol.spark.sparkContext.defaultParallelism, -(-max(points, vol.size * copies) // TASK))

    place, spot = F.lit(0).cast("bigint"), F.lit(0)
    for a in axes:
        if pad:
            held = held.withColumn(a, F.explode(_images(F.col(a), last[a], pad))).withColumn(a, F.col(a) + pad)
        own = F.floor(F.col(a) / width[a])
        if span[a] > 1:
            first = F.greatest(F.floor((F.col(a) - span[a] + 1) / width[a]), F.lit(0).cast("bigint"))
            held = held.withColumn(f"_b_{a}", F.explode(F.sequence(first, F.least(own, F.lit(blocks[a] - 1).cast("bigint")))))
        else:
            held = held.withColumn(f"_b_{a}", own)
        place = place * blocks[a] + F.col(f"_b_{a}")
        spot = spot * wide[a] + (F.col(a) - F.col(f"_b_{a}") * width[a]).cast("int")
    held = held.select(place.alias("_block"), spot.alias("_at"), "_v")
    meet = ["_block"]
    if copies > 1:
        meet, held = ["_block", "_copy"], held.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    blank = F.lit(vol.fill).cast(kind)
    packed = held.repartition(tasks, *meet).groupBy(*meet).agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_l"))
    size = math.prod(wide.values())
    gap = lambda e, i: F.coalesce(F.get("_l", i + 1)["_at"], F.lit(size)) - e["_at"] - 1
    full = F.transform("_l", lambda e: F.coalesce(e["_v"], blank))
    spread = F.flatten(F.concat(F.array(F.array_repeat(blank, F.get("_l", F.lit(0))["_at"])), F.transform("_l", lambda e, i: F.concat(F.array(F.coalesce(e["_v"], blank)), F.array_repeat(blank, gap(e, i))))))
    packed = packed.select(*meet, F.when(F.size("_l") == size, full).otherwise(spread).alias("_vs"))

    rows = at.select(*keys, *[where[a].cast("double").alias(f"_p_{a}") for a in axes])

    def low(a: str) -> Column:
        p = F.col(f"_p_{a}")
        if order == 0:
            return F.least(F.greatest(F.floor(p + 0.5), F.lit(0).cast("bigint")), F.lit(last[a]).cast("bigint"))
        if order == 1:
            return F.least(F.greatest(F.floor(p), F.lit(0).cast("bigint")), F.lit(max(0, last[a] - 1)).cast("bigint"))
        return F.ceil(p - (order + 1) / 2)

    place, some = F.lit(0).cast("bigint"), F.xxhash64(*keys)
    for a in axes:
        place = place * blocks[a] + F.floor((low(a) + pad) / width[a])
    # points outside need no block and go to any
    asked = rows.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_block", F.when(F.col("_in"), place).otherwise(F.pmod(some, F.lit(math.prod(blocks.values())))))
    if copies > 1:
        asked = asked.withColumn("_copy", F.pmod(some, F.lit(copies)).cast("int"))
    both = asked.repartition(tasks, *meet).join(packed.hint("merge"), meet, "left")
    start, weights = F.lit(0), {}
    for a in axes:
        start = start * wide[a] + F.pmod(low(a) + pad, F.lit(width[a])).cast("int")
        for k in range(span[a]):
            d = F.col(f"_p_{a}") - (low(a) + k)
            if order:
                weights[f"_w_{a}_{k}"] = F.greatest(1 - F.abs(d), F.lit(0.0)) if order == 1 else bspline(d, order)
    both = both.withColumns({"_start": start, **weights})
    value = lambda i: F.coalesce(F.get("_vs", F.col("_start") + i), blank)
    if order == 0:
        return both.select(*keys, F.when(F.col("_in"), value(0)).otherwise(F.lit(fill_value)).alias("v"))
    total = None
    for tap in itertools.product(*[range(span[a]) for a in axes]):
        offset, weight = 0, F.lit(1.0)
        for a, k in zip(axes, tap):
            offset, weight = offset * wide[a] + k, weight * F.col(f"_w_{a}_{k}")
        part = weight * value(offset).cast("double")
        total = part if total is None else total + part
    return both.select(*keys, F.when(F.col("_in"), total).otherwise(F.lit(float(fill_value))).alias("v"))


def _cast(vol: Volume, df: DataFrame, shape, dtype=None) -> Volume:
    dtype = np.dtype(dtype or vol.dtype).name
    v = F.rint("v") if np.dtype(dtype).kind in "iu" else F.col("v")
    v = v >= 0.5 if dtype == "bool" else v.cast(spark_type(dtype))
    return replace(vol, df=df.select(*vol.axes, v.alias("v")), shape=tuple(shape), dtype=dtype, block_shape=None, fill=0, complete=False)


def _plain(vol: Volume) -> Volume:
    return vol.with_values(F.col("v").cast("tinyint"), "uint8") if vol.dtype == "bool" else vol


def _blurred(vol: Volume, scale: Sequence[float]) -> Volume:
    """Smoothed along axes that shrink, with sigma (scale - 1) / 2."""
    from voxmill.operators.stencil import convolve_axis, gaussian_kernel

    sigma = [max(0.0, (s - 1) / 2) for s in scale]
    if not any(sigma):
        return vol

    def run(a, m):
        out = a.astype(float)
        for axis, s in enumerate(sigma):
            if s:
                out = convolve_axis(out, gaussian_kernel(s), axis)
        return out

    return map_blocks(vol, run, halo=[math.ceil(3 * s) + 1 if s else 0 for s in sigma], dtype="float64")


def resize(vol: Volume, shape: Sequence[int], order: int = 0, anti_aliasing: bool = False, fill_value: float = 0) -> Volume:
    """Another shape; an output index samples the input at index * (input size / output size)."""
    if vol.ndim not in (2, 3):
        raise ValueError("resampling needs two or three axes")
    scale = [i / o for i, o in zip(vol.shape, shape)]
    src = _blurred(_plain(vol), scale) if anti_aliasing and order else _plain(vol)
    # beyond the last voxel its value goes on
    where = {a: F.least(F.col(a) * float(n) / float(m), F.lit(float(n - 1))) for a, n, m in zip(vol.axes, vol.shape, shape)}
    return replace(_cast(vol, sample(src, grid(vol.spark, shape), vol.axes, where, order, fill_value, math.prod(shape)), shape), complete=True)


def downsample(vol: Volume, scale_factor, order: int = 0, anti_aliasing: bool = False) -> Volume:
    """Shrunk by whole factors, sizes rounded up."""
    factors = per_axis(scale_factor, vol.ndim)
    if any(f < 1 or f != int(f) for f in factors):
        raise ValueError("scale factors are integers of one or more")
    return resize(vol, downscale_shape(vol.shape, scale_factor), order, anti_aliasing)


def affine(vol: Volume, shape: Sequence[int], affine_matrix=None, scale=None, rotation=None, shear=None, translation=None, order: int = 0, fill_value: float = 0, anti_aliasing: bool = False, offset: Sequence[int] | None = None) -> Volume:
    """An affine view: output coordinates (from ``offset``) map through the matrix to input coordinates."""
    parts = any(p is not None for p in (scale, rotation, shear, translation))
    if (affine_matrix is None) == (not parts):
        raise ValueError("give either a matrix or scale, rotation, shear and translation")
    m = np.asarray(affine_matrix if affine_matrix is not None else compute_affine_matrix(scale, rotation, shear, translation), float)
    if m.shape != (vol.ndim + 1,) * 2 or vol.ndim not in (2, 3):
        raise ValueError(f"a matrix of shape {m.shape} does not fit {vol.ndim} axes")
    src = _plain(vol)
    if anti_aliasing:
        src = _blurred(src, np.linalg.norm(m[:-1, :-1], axis=1).tolist())
    begin = offset or [0] * vol.ndim
    where = {}
    for i, a in enumerate(vol.axes):
        c = F.lit(float(m[i, -1]))
        for j, b in enumerate(vol.axes):
            if m[i, j]:
                c = c + F.lit(float(m[i, j])) * (F.col(b) + begin[j])
        where[a] = c
    return replace(_cast(vol, sample(src, grid(vol.spark, shape), vol.axes, where, order, fill_value, math.prod(shape)), shape), complete=True)


def transform_subvolume_affine(vol: Volume, matrix, roi: Sequence[slice], order: int = 0, fill_value: float = 0, sigma=None) -> Volume:
    """The part ``roi`` of the affine view, of the volume smoothed by ``sigma`` (one for all axes or one each) if given."""
    if sigma is not None:
        from voxmill.operators.stencil import gaussian_smoothing

        vol = gaussian_smoothing(_plain(vol), sigma)
    return affine(vol, [s.stop - s.start for s in roi], affine_matrix=matrix, order=order, fill_value=fill_value, offset=[s.start for s in roi])


def transform_subvolume_coordinates(vol: Volume, coordinates: DataFrame, shape: Sequence[int], order: int = 1, fill_value: float = 0) -> Volume:
    """Values at explicit coordinates: a table with output axes and ``at_<axis>`` for each."""
    where = {a: F.col(f"at_{a}") for a in vol.axes}
    return _cast(vol, sample(_plain(vol), coordinates, vol.axes, where, order, fill_value, math.prod(shape)), shape, "float64" if order and np.dtype(vol.dtype).kind != "f" else None)
