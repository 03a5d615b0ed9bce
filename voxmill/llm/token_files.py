"""Token ids in grammar-compressed shard files.

File format: Parquet, one row per segment of a shard, columns as in SEGMENT. ``symbols``,
``rules`` and ``lengths`` are little-endian arrays: symbols are unsigned 16-bit, ids below
``first`` stand for themselves, symbol ``first + r`` for the pair ``rules[2r : 2r + 2]``, whose
expansion has ``lengths[r]`` ids (32-bit). Document i of a segment is the symbols from
``offsets[i]`` to ``offsets[i + 1]``: pairs never cross documents, so one document is decoded
by itself. Rules only name ids and earlier rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm._common import table_path
from voxmill.llm.bpe import ByteBpe, cached, slices, tokenizer_path

SEGMENT = "shard int, segment int, token_start long, n_tokens long, first int, doc_ids array<bigint>, offsets binary, doc_tokens binary, rules binary, lengths binary, symbols binary"
_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` that start at ``begin`` with lengths ``size``, one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return pool[:0]
    return pool[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]


#: Multipliers of two hash tables of 2^18 places for pairs of symbols.
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519))


def _place(pairs: np.ndarray, multiplier: np.uint32) -> np.ndarray:
    return (pairs * multiplier) >> np.uint32(14)


class _PairTable:
    """Symbols of pairs. Of pairs that meet in a place the first one stays and the next goes to the second table; a pair that finds no place is left out."""

    def __init__(self, pairs: np.ndarray, base: int):
        self.tables, chosen = [], []
        for m in _MULTIPLIERS:
            _, lead = np.unique(_place(pairs, m), return_index=True)
            lead.sort()
            mine = pairs[lead]
            keys, symbols = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.uint16)
            keys[0] = 1  # an empty place holds a key of another place
            keys[_place(mine, m)], symbols[_place(mine, m)] = mine, np.arange(base, base + len(mine))
            base += len(mine)
            self.tables.append((m, keys, symbols))
            chosen.append(mine)
            pairs = np.delete(pairs, lead)
            if not len(pairs):
                break
        self.pairs, self.complete = np.concatenate(chosen), not len(pairs)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``keys`` are pairs of the table, and their symbols."""
        hit, symbol = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint16)
        for m, held, symbols in self.tables:
            place = _place(keys, m)
            here = np.flatnonzero(held[place] == keys)
            hit[here], symbol[here] = True, symbols[place[here]]
        at = np.flatnonzero(hit)
        return at, symbol[at]


def compress(ids: np.ndarray, offsets: np.ndarray, first: int, least: int = 8, most: int = 4096):
    """Re-Pair over documents that ``offsets`` bound: (symbols, offsets, rules).

    Each round counts pairs inside documents, makes a nonterminal of each of the commonest
    (``least`` times or more, ``most`` a round, up to 16 bits), and replaces them from left to
    right. It ends when no pair is frequent or no symbol is left. A pair that was replaced is
    gone, and counts of other old pairs only fall: once all frequent pairs of a round have
    symbols, the next round only counts pairs with a new one.
    """
    seq, offsets, rules, total, fresh = ids.astype(np.uint16), offsets.astype(np.int64), [], 0, 0
    while len(seq) > 1 and (free := (1 << 16) - first - total) > 0:
        new = seq >= fresh
        open_ = new[:-1] | new[1:]
        ends = offsets[1:-1]
        open_[ends[(ends > 0) & (ends < len(seq))] - 1] = False
        at = np.flatnonzero(open_)
        keys = (seq[at].astype(np.uint32) << np.uint32(16)) | seq[at + 1]
        ranked = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(ranked)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        ordered = often[np.argsort(-counts[often], kind="stable")][: min(most, free)]
        table = _PairTable(ranked[starts[ordered]], first + total)
        here, symbol = table.find(keys)
        where = at[here]
        # of pairs that overlap in a run, every other one counts
        lead = np.concatenate([[True], where[1:] != where[:-1] + 1])
        run = np.maximum.accumulate(np.where(lead, np.arange(len(where)), 0))
        taken = (np.arange(len(where)) - run) % 2 == 0
        where, symbol = where[taken], symbol[taken]
        seq[where] = symbol
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        offsets = offsets - np.searchsorted(where, offsets)
        seq = seq[keep]
        rules.append(np.stack([table.pairs >> np.uint32(16), table.pairs & np.uint32(0xFFFF)], 1).astype(np.uint16))
        fresh = first + total if table.complete and len(ordered) == len(often) else 0
        total += len(table.pairs)
    return seq, offsets, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)


def _levels(rules: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Ranges of rules of which none names another one of its range."""
    out, done = [], 0
    while done < len(rules):
        ready = rules[done:].max(1) < first + done
        stop = len(rules) if ready.all() else done + int(np.argmin(ready))
        out.append((done, stop))
        done = stop
    return out


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule expands to."""
    size = np.ones(first + len(rules), np.int64)
    for low, high in _levels(rules, first):
        size[first + low : first + high] = size[rules[low:high]].sum(1)
    return size[first:]


def expand_rules(rules: np.ndarray, first: int, lengths: np.ndarray):
    """(pool, begin, size) of each symbol's expansion; ids below ``first`` are their own.

    A round's nonterminals stand ``least`` times side by side in the segment at least, so the
    pool is at most rounds / least times as long as the segment.
    """
    size = np.concatenate([np.ones(first, np.int64), lengths])
    ends = np.cumsum(size)
    begin, pool = ends - size, np.empty(int(ends[-1]) if len(ends) else 0, np.uint16)
    pool[:first] = np.arange(first)
    for low, high in _levels(rules, first):
        both = rules[low:high].ravel()
        pool[begin[first + low] : ends[first + high - 1]] = gather(pool, begin[both], size[both])
    return pool, begin, size


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray, every: bool = False):
    """Ids of some symbols of a segment, and how many each stands for; unless ``every``, only the rules that they name are expanded."""
    if not every and len(rules):
        named = np.zeros(first + len(rules), bool)
        named[symbols] = True
        for low, high in reversed(_levels(rules, first)):
            named[rules[low:high][named[first + low : first + high]].ravel()] = True
        named[:first] = True
        number, held = np.cumsum(named) - 1, named[first:]
        rules, symbols, lengths = number[rules[held]], number[symbols], lengths[held]
    pool, begin, size = expand_rules(rules, first, lengths)
    return gather(pool, begin[symbols], size[symbols]), size[symbols]


def decompress(symbols: np.ndarray, offsets: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray, docs: slice = slice(None)):
    """Ids and offsets of the documents in a slice of a segment."""
    low, high = offsets[:-1][docs], offsets[1:][docs]
    if not len(low):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    ids, size = expand(symbols[low[0] : high[-1]], rules, first, lengths, len(low) == len(offsets) - 1)
    ends = np.concatenate([[0], np.cumsum(size)])
    return ids, np.concatenate([[0], ends[high - low[0]]])


def decode_range(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one document's symbols: the stored lengths tell which symbols hold them."""
    ends = np.cumsum(np.concatenate([np.ones(first, np.int64), lengths])[symbols])
    start, stop = max(start, 0), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, np.uint16)
    i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    before = int(ends[i - 1]) if i else 0
    return expand(symbols[i:j], rules, first, lengths)[0][start - before : stop - before]


def _writer(end_id: int, segment_tokens: int, path: str | None, vocabulary: str):
    def run(batches):
        bpe = cached(ByteBpe, path or tokenizer_path(vocabulary))
        first = bpe.tok.get_vocab_size(with_added_tokens=True)
        shard, number, total = TaskContext.get().partitionId(), 0, 0
        docs, parts, sizes, held = [], [], [], 0

        def close():
            nonlocal number, total, held
            ids, n = np.concatenate(parts), np.array(sizes, np.int64)
            symbols, offsets, rules = compress(ids, np.concatenate([[0], np.cumsum(n)]), first)
            lengths = rule_lengths(rules, first)
            row = (shard, number, total, len(ids), first, list(docs), offsets.astype("<u4").tobytes(), n.astype("<u4").tobytes(), rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes())
            number, total = number + 1, total + len(ids)
            held = 0
            for kept in (docs, parts, sizes):
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)

        end = np.array([end_id], np.uint16)
        for b in batches:
            texts = b.column(1)
            for i, j in slices(texts):
                values, at = bpe.encode(texts[i:j])
                for k, doc in enumerate(b.column(0)[i:j].to_pylist()):
                    docs.append(doc)
                    parts += [values[at[k] : at[k + 1]], end]
                    sizes.append(int(at[k + 1] - at[k]) + 1)
                    held += sizes[-1]
                    if held >= segment_tokens:  # passed by one text at most, as texts are not split
                        yield close()
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, end_id: int = 0, vocabulary: str = "byte_bpe_50k.json", path: str | None = None, shard_docs: int = 8192, most_shards: int = 65_536, segment_tokens: int = 1 << 20) -> None:
    """Encode whole texts, end each with ``end_id``, and write shards in ascending doc_id order.

    Shards are ranges of (doc_id, hash of the text), so even one doc_id, or none, of a third of
    the rows is spread; a task streams its shard in order, holds one segment of about
    ``segment_tokens`` ids at a time (or one longer text), and Spark commits its files whole, so
    a lost executor costs a rerun of its tasks alone. A null text is empty. A null doc_id comes
    first. Rows with one doc_id stay side by side in the order of their texts' hashes, repeated
    rows each have their place, and an empty table makes no segment. Other columns are ignored.
    """
    n = min(most_shards, max(1, -(-docs.count() // shard_docs)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    dealt.mapInArrow(_writer(end_id, segment_tokens, path, vocabulary), SEGMENT).write.parquet(folder)


def _arrays(r: dict):
    """symbols, offsets, rules, first and lengths of a segment."""
    return np.frombuffer(r["symbols"], "<u2"), np.frombuffer(r["offsets"], "<u4").astype(np.int64), np.frombuffer(r["rules"], "<u2").reshape(-1, 2), r["first"], np.frombuffer(r["lengths"], "<u4").astype(np.int64)


def _reader(batches):
    for b in batches:
        for r in b.to_pylist():
            ids, at = decompress(*_arrays(r))
            wide, low = ids.astype("<u4"), r["token_start"] + r["before"]
            step = 512
            for k in range(0, len(at) - 1, step):
                cut = at[k : k + step + 1]
                flat = pa.py_buffer(wide[cut[0] : cut[-1]].tobytes())
                where = pa.py_buffer(((cut - cut[0]) * 4).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"][k : k + step], pa.int64()), pa.array(low + cut[:-1]), pa.array(np.diff(cut)), pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, where, flat])],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files in ``folder``: doc_id, start (ids of all documents before), n_tokens, ids.

    ``ids`` are unsigned little-endian 32-bit. Segments are decoded in parallel; the only
    state that spans them is one total per shard.
    """
    files = spark.read.parquet(folder)
    totals = sorted(files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = [], 0
    for r in totals:
        before.append((r["shard"], at))
        at += r["n"]
    table = spark.createDataFrame(before, "shard int, before long")
    # one row per shard, at most most_shards
    joined = files.join(F.broadcast(table), "shard").select("token_start", "before", "first", "doc_ids", "offsets", "rules", "lengths", "symbols")
    return joined.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int], start: int = 0, stop: int | None = None) -> DataFrame:
    """Some documents of the files: doc_id, n_tokens, and their ids from ``start`` to ``stop`` (end id included).

    Only segments that name a document are read on, and of these only the symbols that hold the
    ids, by the stored expansion lengths. A document that is there twice gives two rows.
    """
    wanted = set(doc_ids)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                symbols, offsets, rules, first, lengths = _arrays(r)
                size = np.frombuffer(r["doc_tokens"], "<u4")
                for i, doc in enumerate(r["doc_ids"]):
                    if doc in wanted:
                        n = int(size[i])
                        ids = decode_range(symbols[offsets[i] : offsets[i + 1]], rules, first, lengths, start, n if stop is None else stop)
                        rows.append((doc, n, ids.astype("<u4").tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_tokens", "ids"])

    files = spark.read.parquet(folder)
    named = files.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, sorted(wanted))).cast("array<bigint>")))
    return named.select("first", "doc_ids", "offsets", "doc_tokens", "rules", "lengths", "symbols").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, **how) -> DataFrame:
    """Write token files to the shared folder, read them back, and check-sum each document."""
    spark = docs.sparkSession
    folder = table_path(spark, "tokens")
    write_token_files(docs, folder, **how)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
