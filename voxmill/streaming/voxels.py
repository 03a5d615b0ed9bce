"""Reductions over voxels that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_summary(voxels: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, min, max, mean, std of ``v`` so far, or per window of a time column with a watermark for late rows."""
    v = F.col("v").cast("double")
    keys = [] if time is None else [F.window(time, window)]
    rows = voxels if time is None else voxels.withWatermark(time, late)
    return rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def stream_label_counts(voxels: DataFrame) -> DataFrame:
    """Voxels per label so far."""
    return voxels.groupBy(F.col("v").alias("label")).agg(F.count(F.lit(1)).alias("count"))
