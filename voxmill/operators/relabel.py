"""Relabeling and filters by label."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.plans.durable import materialize, with_prefix
from voxmill.volume import Volume, write_masked


def _integers(vol: Volume) -> None:
    if np.dtype(vol.dtype).kind not in "iu":
        raise ValueError("labels are integers")


def relabel(vol: Volume, labeling, mask: Volume | None = None, dtype: str | None = None) -> Volume:
    """Replace ids by ``labeling``: a dict, a dense integer array (new id at the old one's place) or a DataFrame (old, new).

    An id without an entry raises an error when the rows are read. The lookup is a left join
    that Spark broadcasts if the table is small. Voxels outside the mask stay as they are.
    """
    _integers(vol)
    if isinstance(labeling, DataFrame):
        table = labeling.select(F.col("old").cast("bigint").alias("old"), F.col("new").cast("bigint").alias("new"))
    elif isinstance(labeling, dict):
        table = vol.spark.createDataFrame([(int(k), int(v)) for k, v in labeling.items()], "old bigint, new bigint")
    else:
        dense = np.asarray(labeling)
        if dense.ndim != 1 or dense.dtype.kind not in "iu":
            raise ValueError("a dense labeling is a 1-D array of integers")
        table = vol.spark.createDataFrame(list(enumerate(map(int, dense))), "old bigint, new bigint")
    fill = vol.fill
    if mask is None and vol.missing():
        held = table.where(F.col("old") == int(vol.fill)).first()
        if held is None:
            raise ValueError(f"no entry for id {int(vol.fill)}")
        fill = held["new"]
    elif mask is not None:
        vol = vol.dense()
    both = vol.df.join(table, vol.df["v"] == table["old"], "left")
    missing = F.raise_error(F.concat(F.lit("no entry for id "), F.col("v").cast("string"))).cast("bigint")
    if mask is None:
        value = F.when(F.col("new").isNull(), missing).otherwise(F.col("new"))
        return replace(vol, df=both.select(*vol.axes, value.alias("v")), dtype=dtype or "uint64", fill=fill)
    inside = mask.objects().df.where(F.col("v").cast("double") != 0).select(*vol.axes, F.lit(True).alias("_in"))
    both = both.join(inside, list(vol.axes), "left")
    value = F.when(F.col("_in").isNull(), F.col("v").cast("bigint")).when(F.col("new").isNull(), missing).otherwise(F.col("new"))
    return replace(vol, df=both.select(*vol.axes, value.alias("v")), dtype=dtype or "uint64")


def consecutive_mapping(vol: Volume, start_label: int = 0, keep_zeros: bool = True) -> DataFrame:
    """(old, new): distinct ids in ascending order from ``start_label``; 0 stays 0 if ``keep_zeros``, yet takes a rank."""
    ids = vol.df.select(F.col("v").cast("bigint").alias("old")).distinct()
    if vol.missing():
        ids = ids.union(vol.spark.range(1).select(vol.blank.cast("bigint"))).distinct()
    ranked = with_prefix(ids, ["old"], [], "relabel")
    new = F.col("row_index") + start_label
    return ranked.select("old", (F.when(F.col("old") == 0, F.lit(0).cast("bigint")).otherwise(new) if keep_zeros else new).alias("new"))


def relabel_consecutive(vol: Volume, start_label: int = 0, keep_zeros: bool = True) -> tuple[Volume, int, DataFrame]:
    """(volume, greatest id, mapping) with ids made consecutive."""
    _integers(vol)
    mapping = materialize(consecutive_mapping(vol, start_label, keep_zeros), "relabel_map")
    top = mapping.agg(F.max("new")).first()[0]
    return relabel(vol, mapping), int(top or 0), mapping


def size_filter(vol: Volume, min_size: int | None = None, max_size: int | None = None, relabel: bool = True, mask: Volume | None = None) -> Volume:  # noqa: A002
    """Set ids with fewer than ``min_size`` or more than ``max_size`` voxels to 0; number the others 1..K by id if ``relabel``."""
    _integers(vol)
    if min_size is None and max_size is None:
        raise ValueError("give min_size, max_size or both")
    vol = vol.objects()
    sizes = vol.df.groupBy(F.col("v").cast("bigint").alias("old")).agg(F.count(F.lit(1)).alias("n"))
    good = F.lit(True)
    if min_size is not None:
        good = good & (F.col("n") >= min_size)
    if max_size is not None:
        good = good & (F.col("n") <= max_size)
    kept = sizes.where(good & (F.col("old") != 0)).select("old")
    table = with_prefix(kept, ["old"], [], "size_filter").select("old", (F.col("row_index") + 1).alias("new")) if relabel else kept.select("old", F.col("old").alias("new"))
    both = vol.df.join(table, vol.df["v"] == table["old"], "left")
    return write_masked(replace(vol, df=both.select(*vol.axes, F.coalesce("new", F.lit(0).cast("bigint")).alias("v")), dtype="uint64"), mask, vol)


def segmentation_filter(vol: Volume, filter_function: Callable, block_shape=None, relabel: str | bool | None = None, mask: Volume | None = None) -> Volume:  # noqa: A002
    """``filter_function(block, block_mask)`` on each block of labels, then consecutive ids if ``relabel``."""
    from voxmill.operators.stencil import map_blocks

    _integers(vol)
    out = map_blocks(vol, lambda block, inside: filter_function(block, inside), block_shape=block_shape, mask=mask, dtype=vol.dtype)
    return relabel_consecutive(out)[0] if relabel else out
