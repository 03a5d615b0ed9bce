"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.bpe import ByteBpe, Limits, cached, slices, tokenizer_path


def balance(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None):
    """Place rest pieces shorter than ``capacity``: rows (piece, from, length, sequence).

    The fewest sequences that can hold all tokens are open from the start. Pieces go in by
    descending length, each to the sequence of least attention cost
    ``sum(linear * n + quadratic * n * n)`` that has room for it. A piece for which no
    sequence has room is cut over those with most room, so that less than one sequence of
    padding remains in all.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    n = -(-int(lengths.sum()) // capacity)
    room, cost, out = np.full(n, capacity), np.zeros(n), []
    for i in np.argsort(-lengths, kind="stable"):
        left, at = int(lengths[i]), 0
        fits = np.where(room >= left, cost, np.inf)
        s = int(np.argmin(fits)) if n else 0
        while left:
            if room[s] < left or not np.isfinite(fits[s]):
                s = int(np.argmax(room))
            take = min(left, int(room[s]))
            out.append((int(i), at, take, s))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            at, left = at + take, left - take
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _packer(capacity: int, pool: int, end_id: int, path: str | None, vocabulary: str, linear: float, quadratic: float | None, limits: Limits, slice_bytes: int):
    def run(batches):
        bpe = cached(ByteBpe, path or tokenizer_path(vocabulary), limits)
        end = np.array([end_id], "<u4")
        state = {"sequence": TaskContext.get().partitionId() << 40}
        rests: list[tuple] = []

        def settle(rows: list[tuple]):
            used: dict[int, int] = {}
            lengths = np.array([len(r[2]) for r in rests], "int64")
            for i, at, n, s in balance(lengths, capacity, linear, quadratic):
                doc, start, ids, total = rests[i]
                rows.append((doc, start + at, n, ids[at : at + n].tobytes(), total, state["sequence"] + s, used.get(s, 0)))
                used[s] = used.get(s, 0) + n
            state["sequence"] += len(used)
            rests.clear()

        def batch(rows):
            cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)

        for b in batches:
            for i, j in slices(b.column(1), slice_bytes):
                rows: list[tuple] = []
                docs = b.column(0)[i:j].to_pylist()
                values, at = bpe.encode(b.column(1)[i:j])
                for k, doc in enumerate(docs):
                    ids = np.concatenate([values[at[k] : at[k + 1]].astype("<u4"), end])
                    total, full = len(ids), len(ids) // capacity * capacity
                    for start in range(0, full, capacity):
                        rows.append((doc, start, capacity, ids[start : start + capacity].tobytes(), total, state["sequence"], 0))
                        state["sequence"] += 1
                    if full < total:
                        rests.append((doc, full, ids[full:], total))
                    if len(rests) >= pool:
                        settle(rows)
                yield batch(rows)
        rows = []
        settle(rows)
        yield batch(rows)

    return run


def pack_documents(docs: DataFrame, capacity: int = 1024, pool: int = 2048, end_id: int = 0, vocabulary: str = "byte_bpe_50k.json", path: str | None = None, linear: float = 1.0, quadratic: float | None = None, limits: Limits = Limits(), slice_bytes: int = 2_000_000) -> DataFrame:
    """Cut tokenized documents into pieces and pack these into sequences of ``capacity`` tokens.

    Each task encodes its documents, closes a sequence for every full ``capacity`` tokens of
    one, and packs the rests of ``pool`` documents at a time by ``balance``. Nothing is
    shuffled, memory is bounded by the pool, and a rerun of a task gives the same pieces.
    ``limits`` and ``slice_bytes`` bound the encoder's caches and the text it takes at a time.

    Returns one row per piece: doc_id, start, length, ids (unsigned little-endian 32-bit),
    doc_tokens (with ``end_id`` after the text), sequence_id, offset. A null or empty text is
    its end id alone; a very long one fills sequences of its own and is encoded alone. Of equally
    long rests the first in the task goes first, to the first of equally loaded sequences. Repeated rows are packed one by one, also with a null doc_id. An empty
    table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_packer(capacity, pool, end_id, path, vocabulary, linear, quadratic, limits, slice_bytes), SCHEMA)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
