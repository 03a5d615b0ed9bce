"""Stencils: voxels are replicated into the halos of blocks, and a kernel sees each block dense."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.volume import Volume, axis_names, block_grid, derive_block_shape, same_shape, side_by_side, spark_type, write_masked


def per_axis(value, ndim: int) -> list[float]:
    if np.ndim(value) == 0:
        return [float(value)] * ndim
    if len(value) != ndim:
        raise ValueError(f"{len(value)} values for {ndim} axes")
    return [float(v) for v in value]


def normalize_halo(halo, ndim: int) -> tuple[int, ...]:
    return tuple(int(h) for h in per_axis(halo, ndim))


def sigma_to_halo(sigma, order: int, ndim: int | None = None) -> tuple[int, ...]:
    """Twice the reach of a gaussian derivative: 2 ceil(3 sigma + order / 2 + 1 / 2) for each axis."""
    return tuple(2 * math.ceil(3.0 * s + 0.5 * order + 0.5) for s in per_axis(sigma, ndim or (np.ndim(sigma) and len(sigma)) or 1))


def explode_halo(vol: Volume, block: Sequence[int], halo: Sequence[int]) -> DataFrame:
    """Voxel rows with ``_block``, once for each block whose box with halo holds them: no join, one shuffle key."""
    df, number = vol.df, F.lit(0).cast("bigint")
    for a, b, h, n in zip(vol.axes, block, halo, block_grid(vol.shape, block)):
        low, high = F.greatest(F.floor((F.col(a) - h) / b), F.lit(0).cast("bigint")), F.least(F.floor((F.col(a) + h) / b), F.lit(n - 1).cast("bigint"))
        df = df.withColumn(f"_b_{a}", F.explode(F.sequence(low, high)) if h else F.floor(F.col(a) / b))
        number = number * n + F.col(f"_b_{a}")
    return df.withColumn("_block", number).drop(*[f"_b_{a}" for a in vol.axes])


def map_blocks(vol: Volume, kernel: Callable, block_shape=None, halo=0, others: Sequence[Volume] = (), mask: Volume | None = None, dtype: str | None = None, channels: Sequence[str] = ("v",), old: Volume | None = None, with_offset: bool = False) -> Volume:
    """``kernel(outer, ...)`` for each block with its halo, of which the inner part is kept.

    The kernel gets the outer block as an array, those of ``others``, the mask's part (all true
    without one) and, if asked for, the outer block's offset. It returns an array of the outer
    shape, or one with a leading axis for several ``channels``. Voxels missing from a table hold
    its ``fill``. Blocks should be four times as wide as the halo, as rows are replicated.
    """
    block = derive_block_shape(vol.shape, block_shape or vol.block_shape)
    halo = normalize_halo(halo, vol.ndim)
    axes, shape, fill, n = vol.axes, vol.shape, vol.fill, block_grid(vol.shape, block)
    dtype = np.dtype(dtype or vol.dtype).name
    joined, complete = side_by_side(vol, *others)
    names = ["v", *[f"_o{i}" for i in range(len(others))]]
    joined = joined.withColumnsRenamed({f"_v{i}": c for i, c in enumerate(names)})
    if mask is not None:
        same_shape(vol, mask)
        inside = mask.objects().df.where(F.col("v").cast("double") != 0).select(*axes, F.lit(True).alias("_m"))
        joined = joined.withColumn("_held", F.lit(True)).join(inside, list(axes), "left" if complete else "full")
        blanks = zip(names, [v.blank for v in (vol, *others)])
        joined = joined.select(*axes, *[F.when(F.col("_held"), F.col(c)).otherwise(b).alias(c) for c, b in blanks], "_m")
        names.append("_m")
    rows = explode_halo(replace(vol, df=joined), block, halo)
    if not complete:  # a block without any row is computed, too
        held = [v.blank.alias(c) for c, v in zip(names, (vol, *others))]
        rows = rows.unionByName(vol.spark.range(math.prod(n)).select(F.col("id").alias("_block"), *held), allowMissingColumns=True)
    in_kinds = [vol.dtype, *[o.dtype for o in others]]
    fills = [fill, *[o.fill for o in others]]
    masked_ = mask is not None
    out_kind = {"bool": "bool", "int8": "int8", "int16": "int16", "uint8": "int16", "int32": "int32", "uint16": "int32", "float32": "float32", "float64": "float64"}.get(dtype, "int64")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.array(np.unravel_index(int(key[0]), n))
        low = np.maximum(at * block - halo, 0)
        high = np.minimum((at + 1) * block + halo, shape)
        if not complete:
            pdf = pdf[pdf[axes[0]].notna()]
        place = tuple((pdf[a].to_numpy(np.int64) - l) for a, l in zip(axes, low))
        parts = []
        for c, kind, f in zip(names, in_kinds, fills):
            arr = np.full(high - low, f, kind)
            arr[place] = pdf[c].to_numpy()
            parts.append(arr)
        inside = np.ones(high - low, bool)
        if masked_:
            inside[:] = False
            inside[place] = pdf["_m"].fillna(False).to_numpy(bool)
        args = [*parts, inside] + ([tuple(int(x) for x in low)] if with_offset else [])
        out = np.asarray(kernel(*args))
        out = out if len(channels) > 1 else out[None]
        inner = tuple(slice(max(0, b * s - l), min((b + 1) * s, e) - l) for b, s, l, e in zip(at, block, low, shape))
        coords = np.indices([s.stop - s.start for s in inner])
        data = {a: (c + s.start + l).ravel() for a, c, s, l in zip(axes, coords, inner, low)}
        for name, channel in zip(channels, out):
            data[name] = channel[inner].astype(out_kind).ravel()
        return pd.DataFrame(data)

    schema = ", ".join(f"{a} bigint" for a in axes) + ", " + ", ".join(f"{c} {spark_type(dtype)}" for c in channels)
    out = rows.groupBy("_block").applyInPandas(run, schema)
    if len(channels) > 1:
        new_axes = axis_names(vol.ndim + 1)
        stacked = out.select(*[F.col(a).alias(f"_{a}") for a in axes], F.posexplode(F.array(*channels)).alias("_c", "v"))
        stacked = stacked.select(F.col("_c").cast("bigint").alias(new_axes[0]), *[F.col(f"_{a}").alias(b) for a, b in zip(axes, new_axes[1:])], "v")
        return Volume(stacked, (len(channels), *shape), dtype, complete=True)
    return write_masked(replace(vol, df=out, dtype=dtype, block_shape=tuple(block), complete=True), mask, old)


# -- gaussian family ------------------------------------------------------------------------


def gaussian_kernel(sigma: float, order: int = 0) -> np.ndarray:
    """Sampled gaussian (sum 1) or its first or second derivative (exact on polynomials of that degree); radius ceil(3 sigma + order / 2)."""
    r = max(1, math.ceil(3.0 * sigma + 0.5 * order))
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    if order == 0:
        return g
    if order == 1:
        d = -x * g
        return d / -(d * x).sum()
    d = (x * x / sigma**2 - 1) * g
    d -= d.mean()
    return d / (0.5 * (d * x * x).sum())


def convolve_axis(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis with mirrored borders (the edge voxel repeats)."""
    r = len(kernel) // 2
    pads = [(r, r) if i == axis else (0, 0) for i in range(a.ndim)]
    wide = np.pad(a, pads, mode="symmetric") if a.shape[axis] else a
    view = np.lib.stride_tricks.sliding_window_view(wide, len(kernel), axis=axis)
    return view @ kernel


def _smooth(a, sigma, orders):
    out = a.astype(float)
    for axis, (s, o) in enumerate(zip(sigma, orders)):
        out = convolve_axis(out, gaussian_kernel(s, o)[::-1], axis)
    return out


def _unit(i, ndim, by=1):
    return [by if k == i else 0 for k in range(ndim)]


def _gradient_magnitude(a, sigma, _):
    return np.sqrt(sum(_smooth(a, sigma, _unit(i, a.ndim)) ** 2 for i in range(a.ndim)))


def _laplacian(a, sigma, _):
    return sum(_smooth(a, sigma, _unit(i, a.ndim, 2)) for i in range(a.ndim))


def _eigenvalues(m: np.ndarray) -> np.ndarray:
    """Channels first, descending."""
    return np.moveaxis(np.linalg.eigvalsh(m)[..., ::-1], -1, 0)


def _hessian(a, sigma, _):
    n = a.ndim
    m = np.empty((*a.shape, n, n))
    for i in range(n):
        for j in range(i, n):
            m[..., i, j] = m[..., j, i] = _smooth(a, sigma, [(k == i) + (k == j) for k in range(n)])
    return _eigenvalues(m)


def _structure(a, sigma, outer):
    n = a.ndim
    g = [_smooth(a, sigma, _unit(i, n)) for i in range(n)]
    m = np.empty((*a.shape, n, n))
    for i in range(n):
        for j in range(i, n):
            m[..., i, j] = m[..., j, i] = _smooth(g[i] * g[j], outer, [0] * n)
    return _eigenvalues(m)


#: Name -> (kernel, derivative order, has a channel per axis).
FILTERS = {
    "gaussian_smoothing": (lambda a, s, _: _smooth(a, s, [0] * a.ndim), 0, False),
    "gaussian_gradient_magnitude": (_gradient_magnitude, 1, False),
    "laplacian_of_gaussian": (_laplacian, 2, False),
    "hessian_of_gaussian_eigenvalues": (_hessian, 2, True),
    "structure_tensor_eigenvalues": (_structure, 1, True),
}


def apply_filter(vol: Volume, filter_name: str, sigma, outer_scale=None, return_channel: int | None = None, block_shape=None, mask: Volume | None = None) -> Volume:
    """A gaussian filter by name; eigenvalue filters have channels first, greatest first, or one ``return_channel``.

    Output is float64 for float64, else float32. Borders mirror. Halos cover all scales, so
    results do not depend on blocks.
    """
    if filter_name not in FILTERS:
        raise ValueError(f"unknown filter {filter_name!r}")
    if filter_name == "structure_tensor_eigenvalues" and outer_scale is None:
        raise ValueError("the structure tensor needs an outer scale")
    kernel, order, many = FILTERS[filter_name]
    n = vol.ndim
    s, outer = per_axis(sigma, n), per_axis(outer_scale or 0, n)
    halo = [max(1, math.ceil(3 * a + order / 2)) + (max(1, math.ceil(3 * b)) if b else 0) for a, b in zip(s, outer)]
    dtype = "float64" if vol.dtype == "float64" else "float32"
    if not many:
        return map_blocks(vol, lambda a, m: kernel(a, s, outer), block_shape, halo, mask=mask, dtype=dtype)
    if return_channel is not None:
        return map_blocks(vol, lambda a, m: kernel(a, s, outer)[return_channel], block_shape, halo, mask=mask, dtype=dtype)
    return map_blocks(vol, lambda a, m: np.where(m, kernel(a, s, outer), 0), block_shape, halo, mask=mask, dtype=dtype, channels=[f"c{i}" for i in range(n)])


def gaussian_smoothing(vol: Volume, sigma, **how) -> Volume:
    return apply_filter(vol, "gaussian_smoothing", sigma, **how)


def gaussian_gradient_magnitude(vol: Volume, sigma, **how) -> Volume:
    return apply_filter(vol, "gaussian_gradient_magnitude", sigma, **how)


def laplacian_of_gaussian(vol: Volume, sigma, **how) -> Volume:
    return apply_filter(vol, "laplacian_of_gaussian", sigma, **how)


# -- local maxima ---------------------------------------------------------------------------


def find_local_maxima(vol: Volume, min_distance: int = 1, threshold_abs: float | None = None, threshold_rel: float | None = None) -> DataFrame:
    """Voxels equal to the maximum of their box of ``min_distance``, over the threshold, away from the border.

    The box maximum is a window per axis, so no stencil is needed. Thresholds are global: the
    minimum of the volume if none is given, or ``threshold_rel`` times its maximum. Of equal
    maxima within a box the first in C order counts.
    """
    from pyspark.sql import Window

    vol = vol.dense()
    axes, d = vol.axes, int(min_distance)
    top = vol.df.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    level = top["a"] if threshold_abs is None else threshold_abs
    if threshold_rel is not None and top["b"] is not None:
        level = max(level, threshold_rel * top["b"])
    df = vol.df.withColumn("_c", vol.linear()).withColumn("_m", F.struct(F.col("v"), (-F.col("_c")).alias("c")))
    for a in axes:
        w = Window.partitionBy(*[x for x in axes if x != a]).orderBy(a).rangeBetween(-d, d)
        df = df.withColumn("_m", F.max("_m").over(w))
    inner = F.lit(True)
    for a, n in zip(axes, vol.shape):
        inner = inner & (F.col(a) >= d) & (F.col(a) < n - d)
    return df.where(inner & (F.col("_m.c") == -F.col("_c")) & (F.col("v") > level)).select(*axes, "v")
