"""Mixing sources to target weights by fixed-length blocks and index permutations."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._common import forget, materialize, scratch, unused, with_prefix, with_row_key

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text start and end."""
    gap = np.concatenate([[True], _SPACE[np.frombuffer(text, np.uint8)], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def _count_words(batches):
    forget()
    for b in batches:
        n = [len(t.split()) for t in pc.fill_null(b.column(0).cast(pa.binary()), b"").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*b.schema.names[1:], "size"])


def level(sources: DataFrame, weight, most: float = 3.0) -> float:
    """x such that the targets ``least(most * size, x * weight)`` add up to the sum of all sizes.

    Sources above ``most`` sizes stop there, and what they leave is shared again by weight
    until none is above; each pass is one aggregate over ``sources``.
    """
    x, stopped = 0.0, -1
    while True:
        over = F.lit(x) * weight > most * F.col("size")
        r = sources.agg(F.sum("size").alias("all"), F.sum(F.when(over, most * F.col("size"))).alias("fixed"), F.sum(F.when(~over, weight)).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if not r["free"] or r["n"] == stopped:
            return x
        x, stopped = (r["all"] - (r["fixed"] or 0.0)) / r["free"], r["n"]


def shard_sizes(total: int, shards: int) -> np.ndarray:
    return np.diff(np.linspace(0, total, shards + 1).round().astype(np.int64))


def draw_counts(quotas, sizes, seed: int) -> np.ndarray:
    """Multinomial counts of each source for output shards (rows) of ``sizes``; columns sum to the quotas.

    Shard by shard the chances are what remains of each quota, so the draws correct
    themselves; what a draw takes beyond a quota goes to the sources with most left.
    """
    left = np.array(quotas, dtype=np.int64)
    rng, out = np.random.default_rng(seed), np.zeros((len(sizes), len(left)), np.int64)
    for k, n in enumerate(sizes):
        if n == 0:
            continue
        got = np.minimum(rng.multinomial(n, left / left.sum()), left)
        while (lack := int(n - got.sum())) > 0:
            room = left - got
            got += np.minimum(room, -(-lack * room // max(1, room.sum())))
            for i in np.argsort(-got):
                if (extra := int(got.sum() - n)) <= 0:
                    break
                got[i] -= min(extra, int(got[i]))
        out[k] = got
        left -= got
    return out


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Place of index x in a pseudorandom permutation of 0..n-1 that ``key`` picks, row by row.

    A balanced Feistel network on the next even number of bits; results beyond n walk on.
    """
    x, n, key = (np.asarray(v, np.uint64) for v in (x, n, key))
    bits = np.frexp(np.maximum(n, 2).astype(np.float64) - 1)[1].astype(np.uint64)
    half = np.maximum((bits + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.ones(len(x), bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            f = (b ^ (k >> np.uint64(r))) * np.uint64(0x9E3779B97F4A7C15) + k * np.uint64(2 * r + 1)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & m)
        out[todo] = (a << h) | b
        todo = out >= n
    return out.astype(np.int64)


def _key(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    z = np.uint64(seed) + source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(27))


def _map_slots(seed: int):
    def run(batches):
        for b in batches:
            shard, source, n, j = (b.column(i).to_numpy() for i in range(4))
            epoch = j // np.maximum(n, 1)
            block = permute(j - epoch * n, n, _key(seed, source, epoch))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(block, pa.int64()), pa.array(epoch, pa.int64())], names=["out_shard", "src", "block", "epoch"])

    return run


class Mixture(NamedTuple):
    """``sources``: src, source, size, begin (words of all sources before), target, blocks, quota. ``docs``: rid,
    doc_id, src, size, pre (words of its source before it). ``slots``: out_shard, src, block, epoch."""

    sources: DataFrame
    docs: DataFrame
    slots: DataFrame


def _draw_groups(seed: int):
    """Draws of groups of sources for all shards, whose sizes within the group are given. Rows come sorted by (g, src)."""

    def drawn(rows):
        _, src, blocks, quota, sizes = zip(*rows)
        draws = draw_counts(quota, np.array(sizes[0], np.int64), seed + 1 + rows[0][0])
        first = np.cumsum(draws, axis=0) - draws
        shard, i = np.nonzero(draws)
        cols = (shard.astype(np.int32), np.array(src, np.int64)[i], np.array(blocks, np.int64)[i], first[shard, i], draws[shard, i])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["out_shard", "src", "n", "first", "count"])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if held and held[0][0] != row[0]:
                    yield drawn(held)
                    held = []
                held.append(row)
        if held:
            yield drawn(held)

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 64, shards: int = 64, seed: int = 20, group: int = 4096, row: tuple[str, str] | None = None) -> Mixture:
    """Plan a mixture as long as the corpus, by source weights, in blocks of ``block`` words.

    The words of a source, document after document by doc_id, form its blocks (the last may be
    short). Each output shard draws multinomial source counts; slot j of a source maps to a
    block through a pseudorandom permutation of the block indices, another one for each pass.
    Quotas are targets in blocks, rounded, and no block is taken more than ``most`` times.

    Sources are sorted by code point, null last, and weighted in turn. Their plan is a table,
    however many they are: a shard first draws counts for groups of ``group`` sources (on the
    driver, a row per group), then each group draws those of its sources. ``row`` names two
    columns that identify rows; else positions do.
    """
    spark = docs.sparkSession
    keep = [F.col(row[0]).alias("row_f"), F.col(row[1]).alias("row_r")] if row else []
    narrow = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tie"), *keep)
    with scratch(spark):
        counted = materialize(narrow.mapInArrow(_count_words, "doc_id long, source string, tie long" + ", row_f long, row_r long" * bool(row) + ", size long"), "mix_docs")
        found = counted.groupBy("source").agg(F.sum("size").alias("size")).select(F.col("source").isNull().alias("last"), "source", "size")
        found = materialize(with_prefix(found, ["last", "source"], ["size"], "mix_sources").select(F.col("row_index").alias("src"), "source", "size", F.col("pre_size").alias("begin")), "mix_sources")
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int"))
        blocks, target = F.ceil(F.col("size") / block), F.least(most * F.col("size"), F.lit(level(found, weight, most)) * weight)
        sources = found.select("*", target.alias("target"), blocks.cast("long").alias("blocks"))
        quota = F.when(F.col("size") > 0, F.least(F.floor(most * F.col("blocks")), F.round(F.col("target") * F.col("blocks") / F.col("size")))).otherwise(0)
        sources = materialize(sources.withColumn("quota", quota.cast("long")), "mix_plan", keep=True)

        placed = counted.join(sources.select("src", F.col("source").alias("name"), "begin"), counted["source"].eqNullSafe(F.col("name"))).drop("name", "source")
        ordered = with_prefix(placed, ["src", "doc_id", "tie", "size"] + ["row_f", "row_r"] * bool(row), ["size"], "mix_order")
        rid = F.struct("row_f", "row_r") if row else F.col("row_index")
        of = materialize(ordered.select(rid.alias("rid"), "doc_id", "src", "size", (F.col("pre_size") - F.col("begin")).alias("pre")), "mix_places", keep=True)

    groups = [(r["g"], r["q"]) for r in sources.groupBy(F.floor(F.col("src") / group).alias("g")).agg(F.sum("quota").alias("q")).orderBy("g").collect()]
    sizes = draw_counts([q for _, q in groups], shard_sizes(sum(q for _, q in groups), shards), seed) if groups else np.zeros((shards, 0), np.int64)
    shares = spark.createDataFrame([(g, sizes[:, i].tolist()) for i, (g, _) in enumerate(groups)], "g long, sizes array<long>")
    # `group` rows at most in each group
    plan = sources.withColumn("g", F.floor(F.col("src") / group)).join(shares, "g").select("g", "src", "blocks", "quota", "sizes")
    plan = plan.repartition("g").sortWithinPartitions("g", "src").mapInArrow(_draw_groups(seed), "out_shard int, src long, n long, first long, count long")
    piece = 16_384
    parts = plan.select("out_shard", "src", "n", "first", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(piece).cast("long"))).alias("p"))
    # rows here are few but become blocks: a fixed number of tasks, which AQE leaves alone
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "out_shard", "src", "p")
    each = parts.select("out_shard", "src", "n", F.explode(F.sequence(F.col("first") + F.col("p"), F.col("first") + F.least(F.col("p") + piece, F.col("count")) - 1)).alias("j"))
    slots = each.mapInArrow(_map_slots(seed), "out_shard int, src long, block long, epoch long")
    return Mixture(sources, of, slots)


def taken_blocks(m: Mixture, block: int = 64) -> DataFrame:
    """One row per document and block it lies in: rid, doc_id, src, size, first, words, times (0: not drawn)."""
    times = m.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.when(F.col("size") > 0, F.floor((F.col("pre") + F.col("size") - 1) / block))
    spread = m.docs.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("pre") / block), last))).alias("block"))
    low, high = F.greatest("pre", F.col("block") * block), F.least(F.col("pre") + F.col("size"), (F.col("block") + 1) * block)
    # both sides grow with the corpus, which Spark cannot see through the explode of a small plan
    joined = spread.join(times.hint("merge"), ["src", "block"], "left")
    return joined.select("rid", "doc_id", "src", "size", (low - F.col("pre")).alias("first"), (high - low).alias("words"), F.coalesce("times", F.lit(0)).alias("times"))


def taken_words(docs: DataFrame, block: int = 64, **how) -> DataFrame:
    """Words that the mixture takes from each document, repeats counted.

    Returns doc_id, size (words), source_size, target (of its source) and taken. A null text has
    no words; a very long one lies in many blocks. A null source is a source, the last. Documents
    of one doc_id come in the order of a hash of their texts; repeated rows are documents of
    their own. A rerun over the same rows takes the same words. An empty table gives an empty
    result; other columns are ignored.
    """
    m = mix(docs, block=block, **how)
    sums = taken_blocks(m, block).groupBy("rid", "doc_id", "src", "size").agg(F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).alias("taken"))
    return sums.join(m.sources.select("src", F.col("size").alias("source_size"), "target"), "src").select("doc_id", "size", "source_size", "target", "taken")


def _copies(columns: list[str], text_at: int, chars_at: int | None):
    """Copy c of a document holds, in order, its blocks that were drawn c times or more."""

    def run(batches):
        forget()
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            rows, texts, lists = [], [], b.column(len(columns))
            at = lists.offsets.to_numpy()
            at, (first, words, times) = at - at[0], (c.to_numpy() for c in lists.flatten().flatten())
            for k in range(b.num_rows):
                t = b.column(text_at)[k].cast(pa.binary()).as_py()
                begin, end = word_bounds(t)
                part = slice(at[k], at[k + 1])
                order = np.argsort(first[part])
                low, n, drawn = first[part][order], words[part][order], times[part][order]
                for c in range(1, int(drawn.max()) + 1):
                    i, j = low[drawn >= c], (low + n)[drawn >= c]
                    apart = np.concatenate([[True], i[1:] != j[:-1]])
                    i, j = i[apart], j[np.append(apart[1:], True)]
                    texts.append(b" ".join(t[begin[x] : end[y - 1]] for x, y in zip(i, j)).decode())
                    rows.append(k)
            cols = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(columns))]
            cols[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                cols[chars_at] = pa.array(list(map(len, texts)), pa.int64()).cast(cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return run


def mixed_documents(docs: DataFrame, block: int = 64, **how) -> DataFrame:
    """The mixture as documents: each drawn ``times`` over, blocks left out where not drawn.

    Columns are those of ``docs``, whatever their names; text (and n_chars, if there) are those of
    the copy. White space inside runs of blocks stays as it is. Documents of which nothing is
    drawn go, and so do null and empty texts, which have no words. A null source is one more
    source. Repeated rows are documents of their own. An empty table gives an empty result.
    Texts are read twice and shuffled once, in the join with their blocks.
    """
    rows, file, row = with_row_key(docs, "mix_text")
    with scratch(docs.sparkSession):
        parts = taken_blocks(mix(rows, block=block, row=(file, row), **how), block).where("times > 0")
        lists = parts.groupBy("rid").agg(F.collect_list(F.struct("first", "words", "times")).alias("parts"))
        lists = materialize(lists, "mix_parts", keep=True)
    held = unused(docs.columns, "mix_parts")[0]
    both = rows.join(lists.hint("merge"), (rows[file] == lists["rid"]["row_f"]) & (rows[row] == lists["rid"]["row_r"])).select(*[rows[c] for c in docs.columns], lists["parts"].alias(held))
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return both.mapInArrow(_copies(docs.columns, docs.columns.index("text"), chars), docs.schema)
