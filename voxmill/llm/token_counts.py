"""Token counts by a broadcast table of frequent chunks and worker caches."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.bpe import WordCounter, cached, cut, slices, tokenizer_path

_SUMMARY = "part int, words array<string>, counts array<long>"


def _summary(seen: Counter, most: int):
    """The commonest entries as one row."""
    top = seen.most_common(most)
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))],
        names=["part", "words", "counts"],
    )


def _add(seen: Counter, words: list, counts: list, most: int) -> Counter:
    seen.update(dict(zip(words, counts)))
    return Counter(dict(seen.most_common(most // 2))) if len(seen) > most else seen


def _tally(each: int, most: int, special: list[str]):
    """Per task one row: its commonest pieces; the counter never holds more than ``most`` and a slice's commonest."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            texts = pc.fill_null(b.column(0), "")
            for i, j in slices(texts):
                found = pc.value_counts(cut(texts[i:j], special)[0])
                n = found.field("counts")
                top = pc.array_sort_indices(n, order="descending")[: 4 * each]
                seen = _add(seen, found.field("values").take(top).to_pylist(), n.take(top).to_pylist(), most)
        yield _summary(seen, each)

    return run


def _merge(most: int):
    """One row for all rows of a task, ``most`` entries long."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for words, counts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen = _add(seen, words, counts, 4 * most)
        yield _summary(seen, most)

    return run


def frequent_pieces(docs: DataFrame, special: list[str], most: int = 32_768, each: int = 2_048, longest: int = 64) -> list[str]:
    """The ``most`` commonest pieces of all texts, as far as each task's ``each`` commonest show.

    A task sends one row with a bounded list; lists are merged in a tree of two levels, and the
    driver gets 16 at most. No pre-token is ever a row or a key of a shuffle.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_tally(each, 32 * each, special), _SUMMARY)
    rows = rows.repartition("part").mapInArrow(_merge(most), _SUMMARY)
    seen: Counter = Counter()
    for r in rows.repartition(16, "part").mapInArrow(_merge(most), _SUMMARY).toLocalIterator():
        seen = _add(seen, r["words"], r["counts"], 4 * most)
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if len(w.encode()) <= longest][:most]


def _counting(table, key: str, path: str | None, vocabulary: str):
    def run(batches):
        counter = cached(WordCounter, path or tokenizer_path(vocabulary), table.value, key=key)
        for b in batches:
            texts = b.column(1)
            n = [int(x) for i, j in slices(texts) for x in counter.count(texts[i:j])]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, limit: int = 2048, vocabulary: str = "word_bpe_49k.json", path: str | None = None, most: int = 32_768) -> DataFrame:
    """Bytes and tokens of each whole text, and whether the tokens pass ``limit``.

    Two tiers, both on the map side: a broadcast table with the lengths of the ``most``
    commonest pieces of the corpus, and bounded worker caches that encode what it lacks
    once. No pre-token is shuffled. Counts equal the library's own on the whole text.

    A null or empty text has 0 bytes and 0 tokens; a very long one is taken whole, alone in its
    slice. Rows, repeated or not, are counted one by one, whatever their doc_id; which pieces of
    equal frequency the table holds never changes a count. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    counter = WordCounter(path or tokenizer_path(vocabulary))
    words = frequent_pieces(docs, counter.special, most)
    sizes = counter.learn(pa.array(words, pa.string()))[0].tolist()
    # at most `most` strings of 64 bytes or less
    table = spark.sparkContext.broadcast((words, sizes))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = narrow.mapInArrow(_counting(table, uuid.uuid4().hex, path, vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
