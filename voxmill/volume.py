"""Volumes: n-dimensional arrays as voxel tables, one row per voxel.

A volume is a DataFrame with a long column per axis and a value column ``v``. Voxels may be
missing from the table (a sparse volume): they hold ``fill``, and every operator counts them.
Where it is known that none is missing (``complete``), operators skip what that costs. All
coordinates are zero-based.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: numpy dtype -> Spark type that holds all its values (uint64 must stay below 2**63).
SPARK_TYPES = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "bigint", "float32": "float", "float64": "double"}


def axis_names(ndim: int) -> tuple[str, ...]:
    return {2: ("y", "x"), 3: ("z", "y", "x")}.get(ndim) or tuple(f"axis{i}" for i in range(ndim))


def spark_type(dtype) -> str:
    name = np.dtype(dtype).name
    if name not in SPARK_TYPES:
        raise ValueError(f"no Spark type for dtype {name}")
    return SPARK_TYPES[name]


@dataclass(frozen=True)
class Volume:
    """A voxel table with its shape, element type and default block shape."""

    df: DataFrame
    shape: tuple[int, ...]
    dtype: str = "float64"
    block_shape: tuple[int, ...] | None = None
    fill: float = 0
    complete: bool = False

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> tuple[str, ...]:
        return axis_names(self.ndim)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_values(self, value: Column, dtype=None) -> Volume:
        """``value``, an expression of ``v``, for each voxel, those missing included."""
        dtype = np.dtype(dtype or self.dtype).name
        value = value.cast(spark_type(dtype))
        fill = self.fill if self.complete else constant(self.spark, value, v=self.blank)
        return replace(self, df=self.df.select(*self.axes, value.alias("v")), dtype=dtype, fill=fill)

    @property
    def blank(self) -> Column:
        """What missing voxels hold."""
        return F.lit(self.fill).cast(spark_type(self.dtype))

    def missing(self) -> int:
        """How many voxels the table lacks."""
        return 0 if self.complete else self.size - self.df.count()

    def objects(self) -> Volume:
        """The same for operators on voxels that are not zero: made dense only if missing voxels are none of these."""
        return self if self.complete or self.fill == 0 else self.dense()

    def linear(self) -> Column:
        """C-order index of a voxel."""
        out = F.lit(0).cast("bigint")
        for a, n in zip(self.axes, self.shape):
            out = out * n + F.col(a)
        return out

    def dense(self) -> Volume:
        """The same with a row for every voxel."""
        if self.complete:
            return self
        full = grid(self.spark, self.shape)
        held = self.df.withColumn("_held", F.lit(True))
        got = full.join(held, list(self.axes), "left").select(*self.axes, F.when(F.col("_held"), F.col("v")).otherwise(self.blank).alias("v"))
        return replace(self, df=got, complete=True)

    def to_numpy(self) -> np.ndarray:
        """The whole array on the driver: for results that fit there."""
        out = np.full(self.shape, self.fill, self.dtype)
        pdf = self.df.select(*self.axes, "v").toPandas()
        if len(pdf):
            out[tuple(pdf[a].to_numpy(int) for a in self.axes)] = pdf["v"].to_numpy()
        return out

    def __getitem__(self, index) -> Volume:
        from voxmill.indexing import normalize_index

        slices, squeezed = normalize_index(index, self.shape)
        return crop(self, slices, squeezed)


def constant(spark: SparkSession, value: Column, **columns: Column):
    """What an expression of ``columns``, all constant, comes to."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).select(value.alias("_")).first()[0]


def side_by_side(*vols: Volume) -> tuple[DataFrame, bool]:
    """Volumes of equal shape joined on coordinates, values as ``_v0``, ``_v1`` ..., and whether all voxels are there.

    Complete volumes meet by an inner join. Else a voxel is in the result if any has it, and
    those that lack it give their ``fill``; voxels that all lack are still missing.
    """
    same_shape(*vols)
    axes, first = list(vols[0].axes), vols[0]
    if all(v.complete for v in vols):
        df = first.df.select(*axes, F.col("v").alias("_v0"))
        for i, v in enumerate(vols[1:], 1):
            df = df.join(v.df.select(*axes, F.col("v").alias(f"_v{i}")), axes)
        return df, True
    df = first.df.select(*axes, F.col("v").alias("_v0"), F.lit(True).alias("_in0"))
    for i, v in enumerate(vols[1:], 1):
        df = df.join(v.df.select(*axes, F.col("v").alias(f"_v{i}"), F.lit(True).alias(f"_in{i}")), axes, "full")
    held = [F.when(F.col(f"_in{i}"), F.col(f"_v{i}")).otherwise(v.blank).alias(f"_v{i}") for i, v in enumerate(vols)]
    return df.select(*axes, *held), any(v.complete for v in vols)


def crop(vol: Volume, slices: Sequence[slice], squeezed: Sequence[int] = ()) -> Volume:
    """Voxels inside a box, with coordinates from its corner; ``squeezed`` axes of length one go."""
    keep = [i for i in range(vol.ndim) if i not in squeezed]
    inside = [(F.col(a) >= s.start) & (F.col(a) < s.stop) for a, s in zip(vol.axes, slices)]
    names = axis_names(len(keep))
    cols = [(F.col(vol.axes[i]) - slices[i].start).alias(n) for i, n in zip(keep, names)]
    shape = tuple(max(0, slices[i].stop - slices[i].start) for i in keep)
    df = vol.df.where(reduce(and_, inside)).select(*cols, "v")
    return replace(vol, df=df, shape=shape, block_shape=tuple(vol.block_shape[i] for i in keep) if vol.block_shape else None)


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All coordinates of a shape, generated on the executors."""
    axes, n = axis_names(len(shape)), math.prod(shape)
    cols, rest = [], F.col("id")
    for a, s in reversed(list(zip(axes, shape))):
        cols.append((rest % max(s, 1)).cast("bigint").alias(a))
        rest = F.floor(rest / max(s, 1))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // 1_000_000))
    return spark.range(0, n, 1, tasks).select(*reversed(cols))


def from_numpy(spark: SparkSession, array, block_shape=None) -> Volume:
    """A volume of a numpy array; the schema is explicit, as inference would widen types."""
    array = np.asarray(array)
    if array.dtype == np.uint64 and array.size and array.max() >= 1 << 63:
        raise ValueError("ids of 2**63 and more have no Spark type")
    axes = axis_names(array.ndim)
    data = {a: c.ravel() for a, c in zip(axes, np.indices(array.shape, dtype=np.int64))}
    kind = spark_type(array.dtype)
    data["v"] = array.ravel().astype({"smallint": "int16", "int": "int32", "bigint": "int64", "tinyint": "int8"}.get(kind, array.dtype))
    df = spark.createDataFrame(pd.DataFrame(data), ", ".join(f"{a} bigint" for a in axes) + f", v {kind}")
    return Volume(df, array.shape, array.dtype.name, tuple(block_shape) if block_shape else None, complete=True)


_CONVERTERS: list[tuple[Callable, Callable]] = []


def register_source(predicate: Callable, converter: Callable) -> None:
    """Let ``as_volume`` take what ``predicate(obj)`` accepts, by ``converter(spark, obj)``; the latest goes first."""
    _CONVERTERS.insert(0, (predicate, converter))


def as_volume(obj, spark: SparkSession | None = None) -> Volume:
    """Volumes pass through; arrays and whatever is registered or has shape and dtype are converted. Paths are refused."""
    if isinstance(obj, Volume):
        return obj
    if isinstance(obj, (str, bytes)):
        raise TypeError("a path is no volume; use voxmill.sources.open_volume")
    spark = spark or SparkSession.getActiveSession()
    for predicate, converter in _CONVERTERS:
        if predicate(obj):
            return converter(spark, obj)
    if hasattr(obj, "shape") and hasattr(obj, "dtype"):
        return from_numpy(spark, obj[...] if not isinstance(obj, np.ndarray) else obj, getattr(obj, "chunks", None))
    raise TypeError(f"{type(obj).__name__} is no volume")


def same_shape(*vols: Volume) -> None:
    if len({v.shape for v in vols}) > 1:
        raise ValueError(f"shapes differ: {[v.shape for v in vols]}")


# -- blocks ---------------------------------------------------------------------------------


def derive_block_shape(shape: Sequence[int], block_shape=None, chunks=None) -> tuple[int, ...]:
    """The given block shape, else the chunks, else 128 (3D) or 1024 a side; never beyond the shape."""
    side = {2: 1024, 3: 128}.get(len(shape), 65_536 if len(shape) == 1 else 64)
    chosen = block_shape or chunks or (side,) * len(shape)
    if len(chosen) != len(shape):
        raise ValueError(f"block shape {chosen} does not fit shape {tuple(shape)}")
    return tuple(max(1, min(b, s)) for b, s in zip(chosen, shape))


def block_grid(shape: Sequence[int], block: Sequence[int]) -> tuple[int, ...]:
    return tuple(-(-s // b) for s, b in zip(shape, block))


def block_id(vol: Volume, block: Sequence[int]) -> Column:
    """C-order number of the block that a voxel lies in."""
    out = F.lit(0).cast("bigint")
    for a, b, n in zip(vol.axes, block, block_grid(vol.shape, block)):
        out = out * n + F.floor(F.col(a) / b)
    return out


def select_blocks(vol: Volume, block_ids: Sequence[int], block_shape=None) -> Volume:
    """Only the voxels of some blocks; what is left counts as all there is."""
    vol = vol.dense()
    block = derive_block_shape(vol.shape, block_shape or vol.block_shape)
    return replace(vol, df=vol.df.where(block_id(vol, block).isin([int(i) for i in block_ids])))


def masked(vol: Volume, mask: Volume) -> DataFrame:
    """Rows of ``vol`` where the mask is not zero, one for each voxel there."""
    same_shape(vol, mask)
    inside = mask.objects().df.where(F.col("v").cast("double") != 0).select(*vol.axes)
    if vol.complete:
        return vol.df.join(inside, list(vol.axes), "left_semi")
    held = inside.join(vol.df.withColumn("_held", F.lit(True)), list(vol.axes), "left")
    return held.select(*vol.axes, F.when(F.col("_held"), F.col("v")).otherwise(vol.blank).alias("v"))


def write_masked(new: Volume, mask: Volume | None, old: Volume | None = None) -> Volume:
    """``new`` inside the mask; outside the old values, or zero."""
    if mask is None:
        return new
    same_shape(new, mask)
    new, kind = new.dense(), spark_type(new.dtype)
    inside = mask.objects().df.where(F.col("v").cast("double") != 0).select(*new.axes, F.lit(True).alias("_in"))
    both = new.df.join(inside, list(new.axes), "left")
    if old is not None:
        both = both.join(old.df.select(*new.axes, F.col("v").alias("_old")), list(new.axes), "left")
    kept = F.coalesce(F.col("_old").cast(kind), F.lit(old.fill).cast(kind)) if old is not None else F.lit(0).cast(kind)
    return replace(new, df=both.select(*new.axes, F.when(F.col("_in"), F.col("v")).otherwise(kept).alias("v")))
