"""Lazy views: each is a DataFrame transformation, evaluated when rows are read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxmill.functions import expr
from voxmill.indexing import normalize_index
from voxmill.operators.stencil import map_blocks
from voxmill.volume import Volume, axis_names, block_id, constant, crop, derive_block_shape, grid, side_by_side, spark_type


def transform(vol: Volume, transformation: Callable, dtype: str | None = None, halo=None, block_shape=None, with_channels: bool = False) -> Volume:
    """``transformation`` of a column, or of array blocks if a ``halo`` (zero will do) is given.

    ``with_channels`` takes the first axis for channels, which the view lacks: the transformation
    gets a list of columns, one for each.
    """
    if with_channels:
        if halo is not None:
            raise ValueError("channels are columns, which have no halo")
        return _over_channels(vol, transformation, dtype)
    if halo is None:
        return vol.with_values(transformation(F.col("v")), dtype)
    return map_blocks(vol, lambda a, m: transformation(a), block_shape, halo, dtype=dtype or vol.dtype)


def _over_channels(vol: Volume, transformation: Callable, dtype: str | None) -> Volume:
    """One aggregate per voxel brings its channels side by side."""
    first, rest = vol.axes[0], axis_names(vol.ndim - 1)
    moved = vol.df.select(F.col(first).alias("_c"), *[F.col(a).alias(b) for a, b in zip(vol.axes[1:], rest)], "v")
    n, dtype = vol.shape[0], np.dtype(dtype or vol.dtype).name
    kind = spark_type(dtype)
    held = [F.max(F.when(F.col("_c") == k, F.struct("v"))).alias(f"_v{k}") for k in range(n)]
    channels = [F.when(F.col(f"_v{k}").isNull(), vol.blank).otherwise(F.col(f"_v{k}.v")) for k in range(n)]
    df = moved.groupBy(*rest).agg(*held).select(*rest, transformation(channels).cast(kind).alias("v"))
    fill = vol.fill if vol.complete else constant(vol.spark, transformation([vol.blank] * n).cast(kind))
    return replace(vol, df=df, shape=vol.shape[1:], dtype=dtype, block_shape=vol.block_shape[1:] if vol.block_shape else None, fill=fill)


def transform_with_coordinates(vol: Volume, transformation: Callable, dtype: str | None = None) -> Volume:
    """``transformation(value, *coordinates)``, all columns."""
    vol = vol.dense()
    return vol.with_values(transformation(F.col("v"), *map(F.col, vol.axes)), dtype)


def transform_many(transformation: Callable, *vols: Volume, apply_to_list: bool = False, dtype: str | None = None) -> Volume:
    """``transformation`` of the columns of volumes of equal shape, joined on coordinates."""
    first, (df, complete) = vols[0], side_by_side(*vols)
    cols = [F.col(f"_v{i}") for i in range(len(vols))]
    value = transformation(cols) if apply_to_list else transformation(*cols)
    dtype = np.dtype(dtype or first.dtype).name
    value = value.cast(spark_type(dtype))
    fill = first.fill if complete else constant(first.spark, value, **{f"_v{i}": v.blank for i, v in enumerate(vols)})
    return replace(first, df=df.select(*first.axes, value.alias("v")), dtype=dtype, fill=fill, complete=complete)


def threshold(vol: Volume, value: float, operator: Callable = expr.greater) -> Volume:
    return vol.with_values(operator(F.col("v"), F.lit(value)), "bool")


def normalize(vol: Volume, dtype: str = "float32", block_shape=None) -> Volume:
    """``(v - min) / (max - min + 1e-6)`` with the least and greatest value of each block, not of the whole."""
    vol, block = vol.dense(), derive_block_shape(vol.shape, block_shape or vol.block_shape)
    v = F.col("v").cast("double")
    ends = vol.df.groupBy(block_id(vol, block).alias("_b")).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    both = vol.df.withColumn("_b", block_id(vol, block)).join(ends, "_b")
    return replace(vol, df=both.select(*vol.axes, ((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-6)).cast(spark_type(dtype)).alias("v")), dtype=dtype)


def roi(vol: Volume, index, squeeze: bool = False) -> Volume:
    """A box of the volume; axes picked by integers go if ``squeeze``."""
    parts = index if isinstance(index, tuple) else (index,)
    for p, n in zip((p for p in parts if p is not Ellipsis), vol.shape):
        if isinstance(p, int) and not -n <= p < n:
            raise IndexError(f"index {p} is out of range for size {n}")
    slices, squeezed = normalize_index(index, vol.shape)
    return crop(vol, slices, squeezed if squeeze else ())


def pad(vol: Volume, pad_width: Sequence[int], mode: str = "constant", value: float = 0) -> Volume:
    """Voxels added on the right of each axis: ``value``, or the edge's own ('edge'), or mirrored ('symmetric', 'reflect')."""
    shape = tuple(n + p for n, p in zip(vol.shape, pad_width))
    names, out = vol.axes, grid(vol.spark, shape)
    source = {}
    for a, n in zip(names, vol.shape):
        c = F.col(a)
        if mode == "edge":
            source[a] = F.least(c, F.lit(n - 1).cast("bigint"))
        elif mode in ("symmetric", "reflect"):
            period = 2 * n if mode == "symmetric" else max(1, 2 * n - 2)
            k = c % period
            source[a] = F.when(k < n, k).otherwise(period - k - (1 if mode == "symmetric" else 0))
        elif mode == "constant":
            source[a] = c
        else:
            raise ValueError(f"unknown mode {mode!r}")
    asked = out.select(*names, *[source[a].alias(f"_s_{a}") for a in names])
    held = vol.df.select(*[F.col(a).alias(f"_s_{a}") for a in names], "v")
    both = asked.join(held, [f"_s_{a}" for a in names], "left")
    inside = reduce(lambda p, q: p & q, [F.col(a) < n for a, n in zip(names, vol.shape)])
    blank = F.lit(value if mode == "constant" else vol.fill)
    v = F.coalesce(F.col("v"), F.when(inside, F.lit(vol.fill)).otherwise(blank).cast(spark_type(vol.dtype)))
    return replace(vol, df=both.select(*names, v.alias("v")), shape=shape, block_shape=None, complete=True)


def expand_dims(vol: Volume, axis: int | Sequence[int] = 0) -> Volume:
    """New axes of length one."""
    wanted = [axis] if isinstance(axis, int) else list(axis)
    n = vol.ndim + len(wanted)
    places = [a + n if a < 0 else a for a in wanted]
    if any(not 0 <= a < n for a in places) or len(set(places)) < len(places):
        raise ValueError(f"axes {wanted} are repeated or out of range")
    old, shape, cols = iter(zip(vol.axes, vol.shape)), [], []
    for i, name in enumerate(axis_names(n)):
        if i in places:
            shape.append(1)
            cols.append(F.lit(0).cast("bigint").alias(name))
        else:
            a, s = next(old)
            shape.append(s)
            cols.append(F.col(a).alias(name))
    return replace(vol, df=vol.df.select(*cols, "v"), shape=tuple(shape), block_shape=None)
