"""Minimax contiguous sharding of documents with equal texts kept together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._common import drop_tables, materialize, text_bytes, with_prefix


class _Knots:
    """What the driver knows of the prefix sums: per interval the least and greatest, and how many."""

    def __init__(self, first, last, count):
        order = np.argsort(first)
        self.first, self.last, self.count = (np.asarray(x, dtype="int64")[order] for x in (first, last, count))

    def floor(self, x: int, hopeful: bool) -> int:
        """A bound on the greatest prefix sum <= x: from above if ``hopeful``, else from below."""
        i = int(np.searchsorted(self.first, x, "right")) - 1
        if i < 0:
            return 0
        if x >= self.last[i]:
            return int(self.last[i])
        return min(x, int(self.last[i]) - 1) if hopeful and self.count[i] > 2 else int(self.first[i])

    def greedy(self, capacity: int, shards: int, total: int, hopeful: bool, at: int = 0) -> list[int] | None:
        """Ends of the shards that a greedy fill from ``at`` makes, or None if it needs more than there are."""
        ends: list[int] = []
        while at < total:
            if len(ends) == shards:
                return None
            nxt = self.floor(at + capacity, hopeful)
            if nxt <= at:
                return None
            ends.append(nxt)
            at = nxt
        return ends

    def level(self, capacity: int, shards: int, total: int) -> list[int]:
        """Cuts under ``capacity`` that stay near the mean of what is left, where a greedy fill can still end in time."""
        cuts, at = [], 0
        for left in range(shards - 1, 0, -1):
            reach = self.floor(at + capacity, False)
            want = min(reach, self.floor(at + -(-(total - at) // (left + 1)), False))
            if want <= at or self.greedy(capacity, left, total, False, want) is None:
                want = reach
            if want >= total:
                break
            cuts.append(want)
            at = want
        return cuts

    def smallest(self, shards: int, total: int, hopeful: bool) -> int:
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, total, hopeful):
                high = mid
            else:
                low = mid + 1
        return low


def _records(ends: DataFrame, ranges: list[tuple[int, int]], knots: int) -> list[np.ndarray]:
    """Least, greatest and number of the values ``v`` in equal intervals of ``ranges`` (both ends included)."""
    width = max(1, -(-sum(hi - lo + 1 for lo, hi in ranges) // knots))
    bucket, base = None, 0
    for lo, hi in ranges:
        inside, number = F.col("v").between(lo, hi), F.floor((F.col("v") - lo) / width) + base
        bucket = F.when(inside, number) if bucket is None else bucket.when(inside, number)
        base += -(-(hi - lo + 1) // width)
    got = ends.select("v", bucket.alias("k")).where("k is not null").groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"))
    pdf = got.select("a", "b", "n").toPandas()
    return [pdf[c].to_numpy("int64") for c in ("a", "b", "n")]


def minimax_cuts(ends: DataFrame, total: int, shards: int, knots: int = 65_536) -> list[int]:
    """Prefix sums at which to cut so that the largest shard is as small as can be.

    ``ends(v)`` holds the inclusive prefix sum of each atomic group in order. The capacity is
    found by binary search with a greedy check. The check looks prefix sums up in at most
    ``knots`` intervals of which the driver holds ends; where these leave the answer open,
    the few intervals that matter are read again more finely, until the bounds meet. The
    result is exact.
    """
    if total == 0:
        return []
    first, last, count = _records(ends, [(1, total)], knots)
    while True:
        k = _Knots(first, last, count)
        low, high = k.smallest(shards, total, True), k.smallest(shards, total, False)
        if low == high:
            return k.level(high, shards, total)
        sure, hope = k.greedy(low, shards * 64, total, False) or [], k.greedy(high, shards, total, True)
        vague = np.zeros(len(k.first), bool)
        for j, top in enumerate(hope):
            bottom = sure[j] if j < len(sure) else 0
            vague |= (k.last >= bottom) & (k.first <= top)
        vague &= k.count > 2
        ranges = []
        for lo, hi in zip(k.first[vague].tolist(), k.last[vague].tolist()):
            ranges.append((lo, hi))
        ranges = _joined(ranges)
        a, b, n = _records(ends, ranges, knots)
        gone = np.zeros(len(k.first), bool)
        for lo, hi in ranges:
            gone |= (k.first >= lo) & (k.last <= hi)
        first, last, count = (np.concatenate([x[~gone], y]) for x, y in ((k.first, a), (k.last, b), (k.count, n)))


def _joined(ranges: list[tuple[int, int]], most: int = 128) -> list[tuple[int, int]]:
    """Fewer ranges that cover the given ones: the smallest gaps are closed first."""
    if len(ranges) <= most:
        return ranges
    gaps = np.array([b[0] - a[1] for a, b in zip(ranges, ranges[1:])])
    split = np.sort(np.argsort(-gaps)[: most - 1])
    out, at = [], 0
    for i in [*split.tolist(), len(ranges) - 1]:
        out.append((ranges[at][0], ranges[i][1]))
        at = i + 1
    return out


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, knots: int = 65_536) -> DataFrame:
    """Put documents into contiguous shards of near equal bytes; equal texts share a shard.

    Groups of equal texts are atomic and ordered by their least doc_id. The largest shard is
    the smallest that this order allows. A group larger than the mean fills a shard alone.

    Returns doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, law ('bytes'), shard,
    slot (0.. in each shard) and grown_shard (null). A null text counts as an empty one, and
    both form one group. A text longer than a shard's share fills one alone. Groups whose least
    doc_ids tie are ordered by their digests. A null doc_id sorts first. Repeated rows get a slot each. An empty
    table gives an empty result; surplus shards stay empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    raw = text_bytes("text")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"))
    narrow = materialize(narrow, "shard_docs")
    groups = narrow.groupBy("digest").agg(F.min("doc_id").alias("gmin"), F.sum("size").alias("gsize"), F.count(F.lit(1)).alias("gdocs"))
    placed = materialize(with_prefix(groups, ["gmin", "digest"], ["gsize"], "shard_groups"), "shard_prefix")
    total = placed.agg(F.sum("gsize")).first()[0] or 0
    cuts = minimax_cuts(placed.select((F.col("pre_gsize") + F.col("gsize")).alias("v")), total, shards, knots)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("pre_gsize") >= c).cast("int")
    placed = placed.select("digest", "gmin", "gdocs", number.alias("shard"))
    firsts, at = {}, 0
    for r in sorted(placed.groupBy("shard").agg(F.sum("gdocs").alias("n")).collect()):
        firsts[r["shard"]] = at
        at += r["n"]
    both = narrow.join(placed.select("digest", "gmin", "shard"), "digest")
    ranked = with_prefix(both, ["shard", "gmin", "digest", "doc_id"], [], "shard_rank")
    drop_tables(spark, narrow)
    first = F.lit(0)
    for s, n in firsts.items():
        first = F.when(F.col("shard") == s, n).otherwise(first)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_index") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
