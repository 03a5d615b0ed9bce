"""Resumable runs over blocks or items: finished ones are partitions of a table, the rest is what is left."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.volume import Volume, block_grid, derive_block_shape, spark_type


class BlockExecutionError(RuntimeError):
    """Some blocks failed; ``failed_block_ids`` names them, all others are done and kept."""

    def __init__(self, failed: Sequence[int], message: str):
        super().__init__(message)
        self.failed_block_ids = sorted(failed)


def _ids(spark: SparkSession, n_items: int, item_ids: Sequence[int] | DataFrame | None) -> DataFrame:
    if isinstance(item_ids, DataFrame):
        return item_ids.select(F.col(item_ids.columns[0]).cast("bigint").alias("item"))
    return spark.range(n_items).select(F.col("id").alias("item")) if item_ids is None else spark.createDataFrame([(int(i),) for i in item_ids], "item bigint")


def map_items(spark: SparkSession, function: Callable, n_items: int, schema: str, item_ids: Sequence[int] | DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Rows of ``function(i) -> DataFrame`` for items 0 to n - 1 or those given, with ``item`` and ``error`` (null if all went well)."""
    ids = _ids(spark, n_items, item_ids)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            for i in pdf["item"]:
                try:
                    out = function(int(i))
                    yield out.assign(item=int(i), error=None)[["item", *names, "error"]]
                except Exception:  # told to the caller with the item's number
                    yield pd.DataFrame([[int(i), *[None] * len(names), traceback.format_exc()[-2000:]]], columns=["item", *names, "error"])

    dealt = ids.repartition(tasks, "item") if tasks else ids.repartition("item")
    return dealt.mapInPandas(run, f"item bigint, {schema}, error string")


class BlockLedger:
    """A table at ``path``, partitioned by item, that a run fills and a later run completes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def done(self) -> DataFrame:
        """Items that are in the table."""
        if not self._exists():
            return self.spark.createDataFrame([], "item bigint")
        return self.spark.read.parquet(self.path).select(F.col("item").cast("bigint").alias("item")).distinct()

    def results(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _keep(self, out: DataFrame, cleanup: Callable | None) -> None:
        """Add what succeeded; raise for the rest, of which only numbers and messages reach the driver."""
        from voxmill.plans.durable import materialize

        out = materialize(out, "ledger")
        out.where("error IS NULL").drop("error").write.mode("append").partitionBy("item").parquet(self.path)
        bad = out.where("error IS NOT NULL").select("item", "error")
        failed = bad.collect()
        if failed:
            raise BlockExecutionError([r["item"] for r in failed], f"{len(failed)} blocks failed; the first: {failed[0]['error']}")
        if cleanup:
            cleanup(self.path)

    def run(self, function: Callable, n_items: int, schema: str, item_ids: Sequence[int] | DataFrame | None = None, cleanup: Callable | None = None) -> DataFrame:
        """Run what is not done yet, keep what succeeds, and raise ``BlockExecutionError`` for the rest."""
        todo = _ids(self.spark, n_items, item_ids).join(self.done(), "item", "left_anti")
        self._keep(map_items(self.spark, function, n_items, schema, todo), cleanup)
        return self.results()

    def run_blocks(self, vol: Volume, function: Callable, block_shape=None, halo=0, dtype: str | None = None, block_ids: Sequence[int] | DataFrame | None = None, cleanup: Callable | None = None) -> Volume:
        """``function(outer block, number) -> array of its shape`` on blocks with a halo that are not done yet; inner parts are kept.

        A block that fails is named by ``BlockExecutionError`` and computed again by the next run.
        """
        from voxmill.operators.stencil import explode_halo, normalize_halo

        vol, block, halo = vol.dense(), derive_block_shape(vol.shape, block_shape or vol.block_shape), normalize_halo(halo, vol.ndim)
        axes, shape, n, was = vol.axes, vol.shape, block_grid(vol.shape, block), vol.dtype
        dtype = np.dtype(dtype or was).name
        kind = {"smallint": "int16", "int": "int32", "bigint": "int64", "tinyint": "int8"}.get(spark_type(dtype), dtype)

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            number = int(key[0])
            at = np.array(np.unravel_index(number, n))
            low, high = np.maximum(at * block - halo, 0), np.minimum((at + 1) * block + halo, shape)
            outer = np.zeros(high - low, was)
            outer[tuple(pdf[a].to_numpy(np.int64) - k for a, k in zip(axes, low))] = pdf["v"].to_numpy()
            try:
                inner = tuple(slice(b * s - k, min((b + 1) * s, e) - k) for b, s, k, e in zip(at, block, low, shape))
                out = np.asarray(function(outer, number))[inner]
            except Exception:  # told to the caller with the block's number
                return pd.DataFrame([[number, *[None] * (vol_ndim + 1), traceback.format_exc()[-2000:]]], columns=["item", *axes, "v", "error"])
            coords = np.indices(out.shape)
            return pd.DataFrame({"item": number, **{a: (c + s.start + k).ravel() for a, c, s, k in zip(axes, coords, inner, low)}, "v": out.astype(kind).ravel(), "error": None})

        vol_ndim = vol.ndim
        todo = _ids(self.spark, int(np.prod(n)), block_ids).join(self.done(), "item", "left_anti")
        rows = explode_halo(vol, block, halo).withColumnRenamed("_block", "item").join(todo, "item", "left_semi")
        schema = "item bigint, " + ", ".join(f"{a} bigint" for a in axes) + f", v {spark_type(dtype)}, error string"
        self._keep(rows.groupBy("item").applyInPandas(run, schema), cleanup)
        return Volume(self.results().select(*axes, "v"), shape, dtype, block)
