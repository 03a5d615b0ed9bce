"""Distance transforms and nearest objects."""

from __future__ import annotations

import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.stencil import map_blocks, per_axis
from voxmill.volume import Volume, spark_type


def edt(foreground: np.ndarray, sampling) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each voxel to the nearest zero, and that voxel's coordinates; inf and -1 if there is none.

    One pass per axis: along a line, the least of what came before plus the squared offset.
    """
    shape, n = foreground.shape, foreground.ndim
    d2 = np.where(foreground, np.inf, 0.0)
    feature = np.where(foreground, -1, np.arange(foreground.size).reshape(shape))
    for axis in range(n):
        size, step = shape[axis], float(sampling[axis])
        d, f = np.moveaxis(d2, axis, 0), np.moveaxis(feature, axis, 0)
        best, arg = d.copy(), f.copy()
        for k in range(1, size):
            cost = (k * step) ** 2
            if cost >= (best.max() if best.size else 0):
                break
            for to, of in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
                new = d[of] + cost
                closer = new < best[to]
                best[to][closer] = new[closer]
                arg[to][closer] = f[of][closer]
        d2, feature = np.moveaxis(best, 0, axis), np.moveaxis(arg, 0, axis)
    known = feature >= 0
    index = np.stack([np.where(known, c, -1) for c in np.unravel_index(np.where(known, feature, 0), shape)])
    return np.sqrt(d2), index


def distance_transform(vol: Volume, halo, sampling=None, return_distances: bool = True, return_indices: bool = False, block_shape=None):
    """Distance to the nearest background (zero) voxel, exact up to the halo: float32, and int32 global indices, channels first.

    Returns a volume, or (distances, indices). A voxel with no background in reach has
    distance inf and indices -1.
    """
    if vol.ndim not in (2, 3):
        raise ValueError("distance transforms need two or three axes")
    if not (return_distances or return_indices):
        raise ValueError("ask for distances, indices or both")
    step = per_axis(sampling or 1.0, vol.ndim)

    def indices(a, m, low):
        index = edt(a != 0, step)[1]
        return np.where(index >= 0, index + np.array(low).reshape(-1, *[1] * a.ndim), -1)

    dist = map_blocks(vol, lambda a, m: edt(a != 0, step)[0], block_shape, halo, dtype="float32") if return_distances else None
    index = map_blocks(vol, indices, block_shape, halo, dtype="int32", channels=[f"i_{a}" for a in vol.axes], with_offset=True) if return_indices else None
    return (dist, index) if dist is not None and index is not None else dist if dist is not None else index


def _line_pass(axis: str, step: float):
    """Squared distances along one line, given those within the axes before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis)
        d = pdf["v"].to_numpy(float)
        best = d.copy()
        for k in range(1, len(d)):
            cost = (k * step) ** 2
            if cost >= best.max():
                break
            np.minimum(best[k:], d[:-k] + cost, out=best[k:])
            np.minimum(best[:-k], d[k:] + cost, out=best[:-k])
        return pdf.assign(v=best)

    return run


def exact_distance_transform(vol: Volume, sampling=None) -> Volume:
    """Exact distances without a halo: line by line, an axis at a time, one shuffle per axis.

    Each line needs as many rows in one task as the axis is long. No background at all: inf.
    """
    step = per_axis(sampling or 1.0, vol.ndim)
    df = vol.dense().df.select(*vol.axes, F.when(F.col("v").cast("double") != 0, float("inf")).otherwise(0.0).alias("v"))
    for axis, s in zip(vol.axes, step):
        rest = [a for a in vol.axes if a != axis]
        df = (df.groupBy(*rest) if rest else df.groupBy()).applyInPandas(_line_pass(axis, s), df.schema)
    return replace(vol, df=df.select(*vol.axes, F.sqrt("v").cast(spark_type("float32")).alias("v")), dtype="float32", complete=True)


def map_points_to_objects(segmentation: Volume, points: DataFrame, max_distance: float, sampling=None) -> DataFrame:
    """The nearest object (label not 0) of each point and its distance: id, label, distance; 0 and inf beyond ``max_distance``.

    ``points`` has a long ``id`` and a coordinate for each axis. A point meets the voxels of
    neighbouring grid cells by an equi-join; of equal distances the first voxel in C order counts.
    """
    segmentation = segmentation.objects()
    axes, step = segmentation.axes, per_axis(sampling or 1.0, segmentation.ndim)
    width = max(float(max_distance), 1e-9)
    cell = lambda a, s: F.floor(F.col(a).cast("double") * s / width)
    left = points.select("id", *[F.col(a).cast("double").alias(f"p_{a}") for a in axes])
    asked = left
    for a, s in zip(axes, step):
        near = F.floor(F.col(f"p_{a}") * s / width)
        asked = asked.withColumn(f"k_{a}", F.explode(F.sequence(near - 1, near + 1)))
    voxels = segmentation.df.where("v <> 0").select(F.col("v").cast("bigint").alias("label"), *axes, segmentation.linear().alias("_c"), *[cell(a, s).alias(f"k_{a}") for a, s in zip(axes, step)])
    d2 = F.lit(0.0)
    for a, s in zip(axes, step):
        gap = (F.col(f"p_{a}") - F.col(a)) * s
        d2 = d2 + gap * gap
    met = asked.join(voxels, [f"k_{a}" for a in axes]).withColumn("d2", d2).where(F.col("d2") <= float(max_distance) ** 2)
    best = met.groupBy("id").agg(F.min(F.struct("d2", "_c", "label")).alias("b"))
    out = points.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("b.label", F.lit(0).cast("bigint")).alias("label"), F.coalesce(F.sqrt("b.d2"), F.lit(float("inf"))).cast("float").alias("distance"))


def neighbours(ndim: int, connectivity: int = 1) -> list[tuple[int, ...]]:
    return [s for s in itertools.product((-1, 0, 1), repeat=ndim) if 0 < sum(map(abs, s)) <= connectivity]
