"""Stitching of tiled segmentations by multicut over the graph of touching and overlapping labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.graph import multicut_decomposition, probabilities_to_costs, region_adjacency
from voxmill.operators.relabel import relabel
from voxmill.operators.stencil import explode_halo, normalize_halo
from voxmill.plans.durable import materialize, with_prefix
from voxmill.volume import Volume, axis_names, block_grid


def _clusters(seg: Volume, overlaps: DataFrame, beta: float, with_background: bool) -> DataFrame:
    """(node, cluster) of labels that belong together: edges of touching labels default to 0.9, measured ones to 1 - overlap; with a background its edges to 0.99."""
    rag = region_adjacency(seg).select("u", "v")
    measured = overlaps.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "fraction").groupBy("u", "v").agg(F.max("fraction").alias("fraction"))
    edges = rag.join(measured, ["u", "v"], "left").withColumn("p", F.coalesce(1 - F.col("fraction"), F.lit(0.9)))
    if with_background:
        edges = edges.withColumn("p", F.when((F.col("u") == 0) | (F.col("v") == 0), 0.99).otherwise(F.col("p")))
    return multicut_decomposition(edges.select("u", "v", probabilities_to_costs(F.col("p"), beta).alias("cost")))


def _stitch(seg: Volume, overlaps: DataFrame, beta: float, with_background: bool, start: int | None = None) -> Volume:
    """Labels of ``seg`` joined; with ``start`` made consecutive from there, in the table of labels, so that voxels are only read once more."""
    clusters = _clusters(seg, overlaps, beta, with_background)
    value = F.coalesce("cluster", "v")
    value = (F.when(F.col("v") == 0, F.lit(0)).otherwise(value) if with_background else value).cast("bigint")
    if start is None:
        both = seg.df.join(clusters, F.col("v") == F.col("node"), "left")
        return replace(seg, df=both.select(*seg.axes, value.alias("v")), dtype="uint64")
    labels = seg.df.select("v").distinct().join(clusters, F.col("v") == F.col("node"), "left")
    labels = materialize(labels.select(F.col("v").alias("label"), value.alias("joined")), "stitch_labels")
    ranks = with_prefix(labels.select("joined").distinct(), ["joined"], [], "stitch_ranks")
    new = F.col("row_index") + start
    new = (F.when(F.col("joined") == 0, F.lit(0)).otherwise(new) if with_background else new).cast("bigint")
    return relabel(seg, materialize(labels.join(ranks, "joined").select(F.col("label").alias("old"), new.alias("new")), "stitch_map"))


def stitch_tiled_segmentation(segmentation: Volume, tile_shape: Sequence[int], overlap: int = 1, with_background: bool = True, beta: float = 0.5) -> Volume:
    """Join objects over the faces of tiles whose ids are unique.

    Slabs ``overlap`` thick on both sides of a face are compared voxel by voxel at that
    offset; an overlap counts relative to the size that the object behind the face has in its
    slab. A last tile thinner than ``overlap`` is not measured.
    """
    parts, segmentation = None, segmentation.dense()
    for a, t, n in zip(segmentation.axes, tile_shape, segmentation.shape):
        x = F.col(a)
        face = F.floor((x + overlap) / t)  # number of the face that a voxel lies before
        low = segmentation.df.where((x % t >= t - overlap) & (face * t + overlap <= n)).withColumn("_f", face)
        # the slab before the face is laid on the one behind it
        high = segmentation.df.where((x % t < overlap) & (x >= t)).withColumn("_f", F.floor(x / t))
        left = low.select(*[F.col(b) if b != a else (x - F.col("_f") * t + overlap).alias(a) for b in segmentation.axes], "_f", F.col("v").alias("u"))
        right = high.select(*[F.col(b) if b != a else (x - F.col("_f") * t).alias(a) for b in segmentation.axes], "_f", F.col("v").alias("w"))
        tile = F.concat_ws(",", *[F.floor(F.col(b) / s) for b, s in zip(segmentation.axes, tile_shape) if b != a], F.col("_f")) if segmentation.ndim > 1 else F.col("_f").cast("string")
        both = left.join(right, [*segmentation.axes, "_f"]).withColumn("_t", tile)
        pairs = both.groupBy("_t", "u", F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        sizes = both.groupBy("_t", F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("s"))
        e = pairs.join(sizes, ["_t", "v"]).select("u", "v", (F.col("n") / F.col("s")).alias("fraction"))
        parts = e if parts is None else parts.unionByName(e)
    if with_background:
        parts = parts.where("u <> 0 AND v <> 0")
    return _stitch(segmentation, parts, beta, with_background)


def stitch_segmentation(vol: Volume, segmentation_function: Callable, tile_shape: Sequence[int], tile_overlap, beta: float = 0.5, with_background: bool = True, return_before_stitching: bool = False, shape: Sequence[int] | None = None):
    """Segment haloed tiles by ``segmentation_function(tile, tile_id)`` and join objects where the halos overlap.

    Axes of ``vol`` beyond those of ``shape`` are channels: tiles have all of them, the segmentation
    has none. Tiles keep their halos, so overlaps are a self-join of tile rows on coordinates; one
    counts relative to the size that the object of the later tile has where both tiles lie. Ids
    are made unique by the tile's number and consecutive in the end.
    """
    vol, given = vol.dense(), vol.axes
    shape = tuple(vol.shape if shape is None else shape)
    if vol.shape[: len(shape)] != shape:
        raise ValueError(f"shape {shape} does not fit {vol.shape}")
    channels, axes = vol.shape[len(shape) :], axis_names(len(shape))
    halo = normalize_halo(tile_overlap, len(shape))
    tiles = block_grid(shape, tile_shape)
    span = math.prod(t + 2 * h for t, h in zip(tile_shape, halo))
    if math.prod(tiles) * span >= 1 << 63:
        raise ValueError("tile ids do not fit 63 bits")
    tile = tuple(tile_shape)
    fill, dtype = vol.fill, vol.dtype

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        at = np.array(np.unravel_index(number, tiles))
        low, high = np.maximum(at * tile - halo, 0), np.minimum((at + 1) * tile + halo, shape)
        arr = np.full([*(high - low), *channels], fill, dtype)
        arr[tuple(pdf[a].to_numpy(np.int64) - l for a, l in zip(given, [*low, *[0] * len(channels)]))] = pdf["v"].to_numpy()
        seg = np.asarray(segmentation_function(arr, number)).astype(np.int64)
        seg = np.where(seg != 0, seg + number * span, 0) if with_background else seg + number * span
        coords = np.indices(seg.shape)
        inner = np.ones(seg.shape, bool)
        for c, l, b, t in zip(coords, low, at, tile):
            inner &= (c + l >= b * t) & (c + l < (b + 1) * t)
        return pd.DataFrame({"tile": number, **{a: (c + l).ravel() for a, c, l in zip(axes, coords, low)}, "v": seg.ravel(), "inner": inner.ravel()})

    rows = explode_halo(vol, (*tile, *channels), (*halo, *[0] * len(channels)))
    tiled = materialize(rows.groupBy("_block").applyInPandas(run, "tile bigint, " + ", ".join(f"{a} bigint" for a in axes) + ", v bigint, inner boolean"), "stitch_tiles")
    raw = replace(vol, df=tiled.where("inner").select(*axes, "v"), shape=shape, dtype="uint64", fill=0, block_shape=tile)
    # only voxels near a face lie in several tiles
    shared = F.lit(False)
    for a, t, h, n in zip(axes, tile, halo, tiles):
        low, high = F.greatest(F.floor((F.col(a) - h) / t), F.lit(0)), F.least(F.floor((F.col(a) + h) / t), F.lit(n - 1))
        shared = shared | (low < high)
    near = tiled.where(shared)
    left = near.select("tile", *axes, F.col("v").alias("u"))
    right = near.select(F.col("tile").alias("tile2"), *axes, "v")
    both = left.join(right, list(axes)).where("tile < tile2")
    if with_background:
        both = both.where("v <> 0")
    pairs = both.groupBy("tile", "tile2", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = both.groupBy("tile", "tile2", "v").agg(F.count(F.lit(1)).alias("s"))
    overlaps = pairs.join(sizes, ["tile", "tile2", "v"]).select("u", "v", (F.col("n") / F.col("s")).alias("fraction"))
    overlaps = overlaps.where("u <> 0") if with_background else overlaps
    done = _stitch(raw, overlaps, beta, with_background, 0 if with_background else 1)
    return (done, raw) if return_before_stitching else done

