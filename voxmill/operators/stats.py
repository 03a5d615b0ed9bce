"""Reductions: each is one partial and one final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.volume import Volume, masked


def _rows(vol: Volume, mask: Volume | None) -> DataFrame:
    return vol.df if mask is None else masked(vol, mask)


def _nan_safe(agg, v):
    return F.when(F.max(F.isnan(v)), F.lit(float("nan"))).otherwise(agg(v))


def summary(vol: Volume, mask: Volume | None = None) -> DataFrame:
    """One row: n, min, max, mean, std (population) in double. NaN passes through; no voxels give n = 0 and nulls.

    Voxels that the table lacks are counted, not made: their number and ``fill`` are enough.
    """
    v = F.col("v").cast("double")
    held = _rows(vol, mask).agg(F.count("v").alias("n"), _nan_safe(F.min, v).alias("min"), _nan_safe(F.max, v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(F.lit(1)).alias("rows"))
    if vol.complete or mask is not None:
        return held.drop("rows")
    fill, more = vol.blank.cast("double"), F.lit(vol.size) - F.col("rows")
    n = F.col("n") + more
    mean = (F.col("mean") * F.col("n") + fill * more) / n
    spread = F.col("n") * (F.pow("std", F.lit(2.0)) + F.pow(F.col("mean") - mean, F.lit(2.0))) + more * F.pow(fill - mean, F.lit(2.0))

    def mixed(name: str, both: Column) -> Column:
        return F.when(more == 0, F.col(name)).when(F.col("n") == 0, F.lit(0.0) if name == "std" else fill).otherwise(both).alias(name)

    ends = [mixed(k, F.when(F.isnan(k), F.col(k)).otherwise(f(F.col(k), fill))) for k, f in (("min", F.least), ("max", F.greatest))]
    return held.select(n.alias("n"), *ends, mixed("mean", mean), mixed("std", F.sqrt(spread / n)))


def _value(vol: Volume, mask: Volume | None, *names: str):
    row = summary(vol, mask).select("n", *names).first()
    if row["n"] == 0:
        raise ValueError("no voxel is inside the mask")
    return tuple(row[n] for n in names) if len(names) > 1 else row[names[0]]


def max(vol: Volume, mask: Volume | None = None) -> float:  # noqa: A001
    return _value(vol, mask, "max")


def min(vol: Volume, mask: Volume | None = None) -> float:  # noqa: A001
    return _value(vol, mask, "min")


def min_and_max(vol: Volume, mask: Volume | None = None) -> tuple[float, float]:
    return _value(vol, mask, "min", "max")


def mean_and_std(vol: Volume, mask: Volume | None = None) -> tuple[float, float]:
    return _value(vol, mask, "mean", "std")


def mean(vol: Volume, mask: Volume | None = None) -> float:
    return _value(vol, mask, "mean")


def std(vol: Volume, mask: Volume | None = None) -> float:
    return _value(vol, mask, "std")


def unique(vol: Volume, return_counts: bool = False, mask: Volume | None = None) -> DataFrame:
    """Distinct values in ascending order as ``v``, with ``count`` if asked for. NaNs are one value."""
    out = _rows(vol, mask).groupBy("v").agg(F.count(F.lit(1)).alias("count"))
    if not vol.complete and mask is None:
        rest = out.agg((F.lit(vol.size) - F.coalesce(F.sum("count"), F.lit(0))).alias("count")).where("count > 0").select(vol.blank.alias("v"), "count")
        out = out.unionByName(rest).groupBy("v").agg(F.sum("count").alias("count"))
    out = out.orderBy("v")
    return out if return_counts else out.select("v")
