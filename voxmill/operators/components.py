"""Connected components of graphs and of foreground voxels."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.plans.durable import connected_components, materialize, with_prefix
from voxmill.volume import Volume, masked

__all__ = ["connected_components", "label", "label_roots"]


#: Runs end at multiples of this length, so that no window holds more, however long a line is.
RUN = 65_536


def _runs(fg: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Foreground voxels with the start of their run along the last axis."""
    x = F.col(axes[-1])
    w = Window.partitionBy(*axes[:-1], F.floor(x / RUN)).orderBy(axes[-1])
    fresh = F.coalesce(F.lag(x).over(w) != x - 1, F.lit(True))
    start = F.last(F.when(fresh, x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return fg.select(*axes, start.alias("start"))


def label_roots(vol: Volume, threshold: float | None = None, connectivity: int | None = None, mask: Volume | None = None) -> DataFrame:
    """Foreground voxels with ``root``, the least C-order index of their component.

    Voxels join to runs along the last axis by a window first; edges between runs of
    neighbouring lines come from equi-joins at fixed offsets, and components are found over
    runs. ``connectivity`` is the number of axes in which neighbours may differ, 1 by default.
    """
    if connectivity is not None and not 1 <= connectivity <= vol.ndim:
        raise ValueError(f"connectivity is from 1 to {vol.ndim}")
    if vol.fill != 0 if threshold is None else vol.fill > threshold:
        vol = vol.dense()
    rows = vol.df if mask is None else masked(vol, mask)
    fg = rows.where(F.col("v").cast("double") != 0 if threshold is None else F.col("v") > threshold)
    axes = vol.axes
    start_index = F.lit(0).cast("bigint")
    for a, n in zip((*axes[:-1], "start"), vol.shape):
        start_index = start_index * n + F.col(a)
    cells = materialize(_runs(fg, axes).select(*axes, start_index.alias("run")), "label_runs")
    edges = None
    for step in itertools.product((-1, 0, 1), repeat=vol.ndim):
        lead = next((s for s in step if s), 0)
        if lead != 1 or sum(map(abs, step)) > (connectivity or 1):
            continue  # one of two opposite steps
        along = not any(step[:-1])  # within lines only the ends of runs can meet
        if along and vol.shape[-1] <= RUN:
            continue
        rows = cells.where(F.col(axes[-1]) % RUN == RUN - 1) if along else cells
        moved = rows.select(*[(F.col(a) + s).alias(a) for a, s in zip(axes, step)], F.col("run").alias("u"))
        e = moved.join(cells, list(axes)).select("u", F.col("run").alias("v"))
        edges = e if edges is None else edges.unionByName(e)
    if edges is None:
        return cells.withColumnRenamed("run", "root")
    roots = connected_components(edges)
    out = cells.join(roots, cells["run"] == roots["node"], "left")
    return out.select(*axes, F.coalesce("root", "run").alias("root"))


def label(vol: Volume, threshold: float | None = None, connectivity: int | None = None, mask: Volume | None = None) -> Volume:
    """Components numbered 1..N in the order of their first voxels; the background is left out (0)."""
    rooted = materialize(label_roots(vol, threshold, connectivity, mask), "label_roots")
    numbers = with_prefix(rooted.select("root").distinct(), ["root"], [], "label_numbers").select("root", (F.col("row_index") + 1).alias("v"))
    return replace(vol, df=rooted.join(numbers, "root").select(*vol.axes, "v"), dtype="uint64", fill=0, complete=False)
