"""Segmentation metrics, all from a contingency table unless noted; each is a one-row DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators.contingency import ContingencyTable, contingency_table
from voxmill.volume import Volume, masked, same_shape, side_by_side

D = "double"


def build_table(seg: Volume, gt: Volume, ignore_seg: Iterable[int] | None = None, ignore_gt: Iterable[int] | None = None, mask: Volume | None = None) -> ContingencyTable:
    return contingency_table(seg, gt, mask).drop_ignore(ignore_seg, ignore_gt)


def _log(c: Column, log2: bool) -> Column:
    return F.log2(c) if log2 else F.log(c)


def _entropy(sizes: DataFrame, name: str, log2: bool) -> DataFrame:
    """Entropy of a size table by sums alone: log n - sum(s log s) / n."""
    s = F.col("size").cast(D)
    n = F.sum(s)
    return sizes.agg((_log(n, log2) - F.sum(s * _log(s, log2)) / n).alias(name))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Side by side; each is a single aggregate row, joined on a constant key."""
    out = frames[0].withColumn("_k", F.lit(1))
    for f in frames[1:]:
        out = out.join(F.broadcast(f.withColumn("_k", F.lit(1))), "_k")
    return out.drop("_k")


def vi_scores(table: ContingencyTable, use_log2: bool = True) -> DataFrame:
    """vi_split = H(a) - I and vi_merge = H(b) - I, where I = H(a) + H(b) - H(a, b). Empty: 0, 0."""
    h = _one_row(_entropy(table.sizes_a, "ha", use_log2), _entropy(table.sizes_b, "hb", use_log2), _entropy(table.pairs.withColumnRenamed("count", "size"), "hab", use_log2))
    zero = lambda c: F.coalesce(F.greatest(c, F.lit(0.0)), F.lit(0.0))
    return h.select(zero(F.col("hab") - F.col("hb")).alias("vi_split"), zero(F.col("hab") - F.col("ha")).alias("vi_merge"))


def variation_of_information(seg: Volume, gt: Volume, use_log2: bool = True, **how) -> DataFrame:
    return vi_scores(build_table(seg, gt, **how), use_log2)


def object_vi_scores(table: ContingencyTable, use_log2: bool = True) -> DataFrame:
    """Per label of b: vi_merge from shares of the label's own size, vi_split against sizes of a."""
    m = table.with_marginals()
    share = F.col("count").cast(D) / F.col("size_b")
    split = -share * _log(F.col("count").cast(D) / F.col("size_a"), use_log2)
    merge = -share * _log(share, use_log2)
    return m.groupBy(F.col("label_b").alias("label")).agg(F.sum(split).alias("vi_split"), F.sum(merge).alias("vi_merge"))


def object_vi(seg: Volume, gt: Volume, use_log2: bool = True, **how) -> DataFrame:
    return object_vi_scores(build_table(seg, gt, **how), use_log2)


def _squares(sizes: DataFrame, col: str, name: str) -> DataFrame:
    wide = F.col(col).cast("decimal(19,0)")
    return sizes.agg(F.sum(wide * wide).cast("decimal(38,0)").alias(name), F.sum(F.col(col)).alias(name + "_n"))


def rand_scores(table: ContingencyTable) -> DataFrame:
    """adapted_rand_error = 1 - 2pr / (p + r) and rand_index; squares are summed exactly. Empty: 0, 1."""
    s = _one_row(_squares(table.pairs, "count", "c2"), _squares(table.sizes_a, "size", "a2"), _squares(table.sizes_b, "size", "b2"))
    c2, a2, b2, n = (F.col(x).cast(D) for x in ("c2", "a2", "b2", "c2_n"))
    p, r = c2 / a2, c2 / b2
    diff = (F.col("a2") + F.col("b2") - 2 * F.col("c2")).cast(D)
    return s.select(F.coalesce(1 - 2 * p * r / (p + r), F.lit(0.0)).alias("adapted_rand_error"), F.coalesce(1 - diff / (n * n), F.lit(1.0)).alias("rand_index"))


def rand_index(seg: Volume, gt: Volume, **how) -> DataFrame:
    return rand_scores(build_table(seg, gt, **how))


def cremi_scores(table: ContingencyTable, use_log2: bool = True) -> DataFrame:
    """vi_split, vi_merge, adapted_rand_error and cremi = sqrt(are * (split + merge))."""
    both = _one_row(vi_scores(table, use_log2), rand_scores(table))
    return both.select("vi_split", "vi_merge", "adapted_rand_error", F.sqrt(F.greatest(F.col("adapted_rand_error"), F.lit(0.0)) * (F.col("vi_split") + F.col("vi_merge"))).alias("cremi"))


def cremi_score(seg: Volume, gt: Volume, use_log2: bool = True, **how) -> DataFrame:
    return cremi_scores(build_table(seg, gt, **how), use_log2)


# -- matching -------------------------------------------------------------------------------

CRITERIA = {
    "iou": lambda c, a, b: c / (a + b - c),
    "iot": lambda c, a, b: c / a,
    "iop": lambda c, a, b: c / b,
}


def pair_scores(table: ContingencyTable, criterion: str = "iou", ignore_label: int | None = 0) -> DataFrame:
    """label_a, label_b, score of all pairs that overlap; the ignored label counts in sizes only."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}")
    score = CRITERIA[criterion](*(F.col(c).cast(D) for c in ("count", "size_a", "size_b")))
    out = table.with_marginals().select("label_a", "label_b", score.alias("score"))
    return out if ignore_label is None else out.where((F.col("label_a") != ignore_label) & (F.col("label_b") != ignore_label))


def _hopcroft_karp(edges: list[tuple]) -> list[tuple]:
    """A matching of most edges of a bipartite graph, by augmenting paths from breadth-first layers."""
    adj: dict = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    left: dict = {}
    right: dict = {}
    while True:
        depth, queue, found = {a: 0 for a in adj if a not in left}, [a for a in adj if a not in left], False
        for a in queue:
            for b in adj[a]:
                n = right.get(b)
                if n is None:
                    found = True
                elif n not in depth:
                    depth[n] = depth[a] + 1
                    queue.append(n)
        if not found:
            return list(left.items())
        for start in [a for a in adj if a not in left]:
            stack, path = [(start, iter(adj[start]))], []
            while stack:
                a, it = stack[-1]
                for b in it:
                    n = right.get(b)
                    if n is None:
                        path.append((a, b))
                        for x, y in path:
                            left[x], right[y] = y, x
                        stack = []
                        break
                    if depth.get(n) == depth[a] + 1:
                        path.append((a, b))
                        stack.append((n, iter(adj[n])))
                        break
                else:
                    depth.pop(a, None)
                    stack.pop()
                    if path:
                        path.pop()


def matched_pairs(edges: DataFrame) -> DataFrame:
    """A maximum matching of ``edges(a, b)`` (long ids of two sides): components first, then each by itself.

    An edge that shares neither end with another is its own component and matched; most are, and only the rest needs
    components. Those are solved many to a group, as a group costs more than a small component.
    """
    from voxmill.operators.components import connected_components
    from voxmill.plans.durable import in_groups, materialize

    tagged = materialize(edges.select("a", "b", (F.col("a") * 2).alias("u"), (F.col("b") * 2 + 1).alias("v")).distinct(), "match_edges")
    of = lambda c, n: tagged.groupBy(c).agg(F.count(F.lit(1)).alias(n))
    counted = materialize(tagged.join(of("a", "n_a"), "a").join(of("b", "n_b"), "b").withColumn("lone", (F.col("n_a") == 1) & (F.col("n_b") == 1)), "match_counts")
    rest = counted.where(~F.col("lone"))
    roots = connected_components(rest.select("u", "v"))
    placed = rest.join(roots, F.col("u") == F.col("node")).select("root", "a", "b")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_hopcroft_karp(list(zip(pdf["a"].tolist(), pdf["b"].tolist()))), columns=["a", "b"], dtype="int64")

    return counted.where("lone").select("a", "b").unionByName(in_groups(placed, "root", ["a", "b"], solve, "a long, b long"))


def _rates(tp: Column, n_a: Column, n_b: Column) -> list[Column]:
    fp, fn = n_a - tp, n_b - tp
    safe = lambda x, y: F.when(tp > 0, F.try_divide(x.cast(D), y.cast(D))).otherwise(0.0)
    return [safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(tp, tp + fp + fn).alias("segmentation_accuracy"), safe(2 * tp, 2 * tp + fp + fn).alias("f1")]


def _counts(table: ContingencyTable, ignore_label: int | None) -> DataFrame:
    """One row: objects on either side."""
    real = lambda c: table.pairs.where(F.col(c) != ignore_label) if ignore_label is not None else table.pairs
    return _one_row(real("label_a").agg(F.count_distinct("label_a").alias("n_a")), real("label_b").agg(F.count_distinct("label_b").alias("n_b")))


def matching_scores(table: ContingencyTable, threshold: float = 0.5, criterion: str = "iou", ignore_label: int | None = 0) -> DataFrame:
    """precision, recall, segmentation_accuracy, f1 of a one-to-one matching with most pairs at or over ``threshold``.

    Only the number of matched pairs counts, so a maximum matching of the thresholded graph
    gives what an optimal assignment would. Over one half, scores by intersection over union
    leave each object one partner at most, and the matching is a plain count.
    """
    good = pair_scores(table, criterion, ignore_label).where(F.col("score") >= threshold)
    if criterion == "iou" and threshold > 0.5:
        tp = good.agg(F.count(F.lit(1)).alias("tp"))
    else:
        tp = matched_pairs(good.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).agg(F.count(F.lit(1)).alias("tp"))
    return _one_row(tp, _counts(table, ignore_label)).select(*_rates(F.col("tp"), F.col("n_a"), F.col("n_b")))


def matching(seg: Volume, gt: Volume, threshold: float = 0.5, criterion: str = "iou", ignore_label: int | None = 0, mask: Volume | None = None) -> DataFrame:
    return matching_scores(build_table(seg, gt, mask=mask), threshold, criterion, ignore_label)


def mean_segmentation_accuracy_scores(table: ContingencyTable, thresholds: Iterable[float] | None = None, ignore_label: int | None = 0) -> DataFrame:
    """Mean accuracy over IoU thresholds (0.5, 0.55 ... 0.95 by default), and each of them.

    Over one half an object has one partner at most; at 0.5 exactly two pairs can tie, which
    the maximum matching settles. All thresholds above share one pass.
    """
    levels = [float(t) for t in (np.arange(0.5, 1.0, 0.05) if thresholds is None else thresholds)]
    scores = pair_scores(table, "iou", ignore_label)
    high = [t for t in levels if t > 0.5]
    sums = scores.agg(*[F.coalesce(F.sum((F.col("score") >= t).cast("long")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(levels)])
    base = _one_row(sums, _counts(table, ignore_label))
    if len(high) < len(levels):
        low = [i for i, t in enumerate(levels) if t <= 0.5]
        for i in low:
            edges = scores.where(F.col("score") >= levels[i]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
            base = _one_row(base.drop(f"t{i}"), matched_pairs(edges).agg(F.count(F.lit(1)).alias(f"t{i}")))
    each = [_rates(F.col(f"t{i}"), F.col("n_a"), F.col("n_b"))[2] for i in range(len(levels))]
    out = base.select(*[c.alias(f"accuracy_{t:.2f}") for c, t in zip(each, levels)])
    total = sum((F.col(f"`{c}`") for c in out.columns), F.lit(0.0)) / max(1, len(levels))
    return out.select(total.alias("mean_accuracy"), *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in out.columns])


def mean_segmentation_accuracy(seg: Volume, gt: Volume, thresholds=None, ignore_label: int | None = 0, mask: Volume | None = None) -> DataFrame:
    return mean_segmentation_accuracy_scores(build_table(seg, gt, mask=mask), thresholds, ignore_label)


# -- dice -----------------------------------------------------------------------------------


def best_dice_scores(table: ContingencyTable, ignore_label: int | None = 0) -> DataFrame:
    """Symmetric best dice: the lesser of both sides' mean over objects of the best dice; no partner scores 0."""
    m = table.with_marginals().withColumn("dice", 2.0 * F.col("count") / (F.col("size_a") + F.col("size_b")))

    def side(own: str, other: str, name: str) -> DataFrame:
        rows = m if ignore_label is None else m.where(F.col(own) != ignore_label)
        dice = F.col("dice") if ignore_label is None else F.when(F.col(other) != ignore_label, F.col("dice")).otherwise(0.0)
        return rows.groupBy(own).agg(F.max(dice).alias("best")).agg(F.coalesce(F.avg("best"), F.lit(0.0)).alias(name))

    both = _one_row(side("label_a", "label_b", "da"), side("label_b", "label_a", "db"))
    return both.select(F.least("da", "db").alias("symmetric_best_dice"))


def symmetric_best_dice_score(seg: Volume, gt: Volume, ignore_label: int | None = 0, mask: Volume | None = None) -> DataFrame:
    return best_dice_scores(build_table(seg, gt, mask=mask), ignore_label)


def dice_score(seg: Volume, gt: Volume, threshold_seg: float | None = 0, threshold_gt: float | None = 0, mask: Volume | None = None) -> DataFrame:
    """``2 sum(ab) / (sum(a) + sum(b) + 1e-7)`` over voxels; a threshold of None keeps values as they are. Nothing in the mask: 0."""
    same_shape(seg, gt)
    if mask is not None:
        seg, gt = (replace(v, df=masked(v, mask), complete=True) for v in (seg, gt))
    value = lambda c, t: c.cast(D) if t is None else (c > t).cast(D)
    both, complete = side_by_side(seg, gt)
    a, b = value(F.col("_v0"), threshold_seg), value(F.col("_v1"), threshold_gt)
    sums = both.agg(F.sum(a * b).alias("ab"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.count(F.lit(1)).alias("n"))
    if not complete:  # voxels that neither table has
        a, b, n = value(seg.blank, threshold_seg), value(gt.blank, threshold_gt), F.lit(seg.size) - F.col("n")
        sums = sums.select(*[(F.coalesce(k, F.lit(0.0)) + c * n).alias(k) for k, c in (("ab", a * b), ("a", a), ("b", b))])
    return sums.select(F.coalesce(2 * F.col("ab") / (F.col("a") + F.col("b") + 1e-7), F.lit(0.0)).alias("dice"))


# -- points ---------------------------------------------------------------------------------


def coordinate_matching(a: DataFrame, b: DataFrame, distance_threshold: float, resolution=None) -> DataFrame:
    """Scores of a one-to-one matching of points at most ``distance_threshold`` apart.

    ``a`` and ``b`` have a long ``id`` and coordinates in all other columns. Points meet by an
    equi-join on grid cells as wide as the threshold, not by comparing all with all.
    """
    axes = [c for c in a.columns if c != "id"]
    step = [1.0] * len(axes) if resolution is None else [float(r) for r in (resolution if np.ndim(resolution) else [resolution] * len(axes))]
    width = max(float(distance_threshold), 1e-9)
    place = lambda df, p: df.select(F.col("id").alias(p), *[(F.col(c).cast(D) * s).alias(f"{p}_{c}") for c, s in zip(axes, step)])
    pa_, pb_ = place(a, "a"), place(b, "b")
    cell = lambda p, c: F.floor(F.col(f"{p}_{c}") / width)
    left = pa_
    for c in axes:
        left = left.withColumn(f"k_{c}", F.explode(F.sequence(cell("a", c) - 1, cell("a", c) + 1)))
    right = pb_.withColumns({f"k_{c}": cell("b", c) for c in axes})
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in axes), F.lit(0.0))
    edges = left.join(right, [f"k_{c}" for c in axes]).where(d2 <= float(distance_threshold) ** 2).select("a", "b")
    tp = matched_pairs(edges).agg(F.count(F.lit(1)).alias("tp"))
    sizes = _one_row(a.agg(F.count(F.lit(1)).alias("n_a")), b.agg(F.count(F.lit(1)).alias("n_b")))
    return _one_row(tp, sizes).select(*_rates(F.col("tp"), F.col("n_a"), F.col("n_b")))


def centroid_matching(seg: Volume, gt: Volume, distance_threshold: float, resolution=None, ignore_label: int | None = 0) -> DataFrame:
    """``coordinate_matching`` of the objects' centers of mass; label 0 is never an object."""
    from voxmill.operators.morphology import morphology

    def points(vol: Volume) -> DataFrame:
        m = morphology(vol)
        m = m if ignore_label is None else m.where(F.col("label") != ignore_label)
        return m.select(F.col("label").alias("id"), *[f"com_{x}" for x in vol.axes])

    return coordinate_matching(points(seg), points(gt), distance_threshold, resolution)
