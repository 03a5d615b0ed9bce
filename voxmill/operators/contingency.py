"""Contingency tables of two label volumes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.volume import Volume, masked, same_shape, side_by_side


@dataclass(frozen=True)
class ContingencyTable:
    """``pairs``: label_a, label_b, count. Marginals are sums over it."""

    pairs: DataFrame

    @property
    def sizes_a(self) -> DataFrame:
        return self.pairs.groupBy(F.col("label_a").alias("label")).agg(F.sum("count").alias("size"))

    @property
    def sizes_b(self) -> DataFrame:
        return self.pairs.groupBy(F.col("label_b").alias("label")).agg(F.sum("count").alias("size"))

    def n_points(self) -> int:
        return self.pairs.agg(F.sum("count")).first()[0] or 0

    def as_dicts(self) -> tuple[dict, dict]:
        """Both marginals on the driver."""
        return tuple({r["label"]: r["size"] for r in s.collect()} for s in (self.sizes_a, self.sizes_b))

    def drop_ignore(self, ignore_a: Iterable[int] | None = None, ignore_b: Iterable[int] | None = None) -> ContingencyTable:
        """Without pairs of which either label is ignored; marginals follow."""
        out = self.pairs
        for col, labels in (("label_a", ignore_a), ("label_b", ignore_b)):
            if labels is not None and len(list(labels)):
                out = out.where(~F.col(col).isin([int(v) for v in labels]))
        return ContingencyTable(out)

    def with_marginals(self) -> DataFrame:
        """Pairs with size_a and size_b: two joins on aggregates, which a label of any size pre-aggregates."""
        a, b = self.sizes_a.select(F.col("label").alias("label_a"), F.col("size").alias("size_a")), self.sizes_b.select(F.col("label").alias("label_b"), F.col("size").alias("size_b"))
        return self.pairs.join(a, "label_a").join(b, "label_b")


def contingency_table(seg_a: Volume, seg_b: Volume, mask: Volume | None = None) -> ContingencyTable:
    """Voxels for each pair of labels; background counts like any label, also where no row holds it. Integers only."""
    same_shape(seg_a, seg_b)
    for v in (seg_a, seg_b):
        if np.dtype(v.dtype).kind not in "iu":
            raise ValueError("labels are integers")
    if mask is not None:
        both = masked(seg_a, mask).withColumnRenamed("v", "label_a").join(seg_b.df.select(*seg_b.axes, F.col("v").alias("label_b"), F.lit(True).alias("_in")), list(seg_a.axes), "inner" if seg_b.complete else "left")
        return from_labels(both.withColumn("label_b", F.when(F.col("_in"), F.col("label_b")).otherwise(seg_b.blank)), "label_a", "label_b")
    both, complete = side_by_side(seg_a, seg_b)
    table = from_labels(both, "_v0", "_v1")
    if complete:
        return table
    # what neither table has is one pair; it follows from the number of all voxels
    rest = table.pairs.agg((F.lit(seg_a.size) - F.coalesce(F.sum("count"), F.lit(0))).alias("count")).where("count > 0")
    rest = rest.select(seg_a.blank.cast("bigint").alias("label_a"), seg_b.blank.cast("bigint").alias("label_b"), "count")
    return ContingencyTable(table.pairs.unionByName(rest).groupBy("label_a", "label_b").agg(F.sum("count").alias("count")))


def from_labels(df: DataFrame, a: str, b: str) -> ContingencyTable:
    """The table of two label columns that already lie side by side: one aggregate, no join."""
    return ContingencyTable(df.groupBy(F.col(a).cast("bigint").alias("label_a"), F.col(b).cast("bigint").alias("label_b")).agg(F.count(F.lit(1)).alias("count")))
