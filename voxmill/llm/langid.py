"""Language identification by n-gram presence kernels, Nystrom landmarks and ridge regression."""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm._common import materialize, scratch, unused, worker_cache

#: Bytes as the kernel sees them: ASCII letters in lower case, bytes of other letters as they are, all else a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(text: bytes) -> np.ndarray:
    """Folded bytes between two spaces, runs of spaces as one; capital Latin-1 letters in lower case."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    out = _FOLD[raw]
    capital = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3) & (raw[1:] != 0x97)
    out[1:][capital] += 0x20
    space = out == 32
    return out[~(space & np.concatenate([[False], space[:-1]]))]


def grams(text: bytes, longest: int = 3) -> list[np.ndarray]:
    """Codes of all 1- to ``longest``-grams of a folded text, with repeats: one array per length."""
    b = fold(text).astype(np.uint32)
    out, code = [], b
    for n in range(1, longest + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        out.append(code)
    return out


class Model(NamedTuple):
    """``table[n - 1]`` maps an n-gram's code to its place in the spectrum, or -1."""

    labels: list[str]
    table: list[np.ndarray]
    spectrum: int
    landmarks: np.ndarray
    weights: np.ndarray


def _table(codes: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    out, base = [], 0
    for n, c in enumerate(codes, 1):
        t = np.full(1 << (8 * n), -1, np.int16)
        t[c] = np.arange(base, base + len(c), dtype=np.int16)
        out.append(t)
        base += len(c)
    return out, base


def presence(texts: list[bytes], table: list[np.ndarray], spectrum: int) -> np.ndarray:
    """Rows of presence (1 or 0) over the spectrum, divided by their norm: the kernel is a product of two."""
    p = np.zeros((len(texts), spectrum + 1), np.float32)
    for i, t in enumerate(texts):
        for lut, code in zip(table, grams(t, len(table))):
            p[i, lut[code]] = 1.0  # place -1, the last column, takes what is outside
    p = p[:, :spectrum]
    norm = np.sqrt(p.sum(1, keepdims=True))
    return p / np.maximum(norm, 1)


def code_sets(text: bytes, longest: int = 3) -> np.ndarray:
    """All n-grams that a text has, in order: length in the top byte, code below."""
    return np.concatenate([np.unique(c).astype(np.uint32) | np.uint32(n << 24) for n, c in enumerate(grams(text, longest), 1)])


def fit(bits: np.ndarray, labels: list[str], spectrum: list[int], landmarks: int = 256, longest: int = 3, ridge: float = 1e-3) -> Model:
    """One-versus-rest kernel ridge regression on Nystrom features of normalized presence kernels.

    ``bits`` has a row for each training text: which n-grams of ``spectrum`` (sorted, as in
    ``code_sets``) it has, packed. Landmarks are spread over the labels in turn, in the order of the rows.
    """
    names = sorted(set(labels))
    codes = [np.array([c & 0xFFFFFF for c in spectrum if c >> 24 == n], np.int64) for n in range(1, longest + 1)]
    table, size = _table(codes)

    def kernels(rows):
        x = np.unpackbits(bits[rows], axis=1, count=size).astype(np.float64)
        return x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)

    y = np.array([names.index(v) for v in labels], int)
    turn = np.zeros(len(y), int)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    marks = kernels(np.lexsort((y, turn))[:landmarks])
    value, vector = np.linalg.eigh(marks @ marks.T)
    value, vector = value[value > 1e-6], vector[:, value > 1e-6]
    root = vector / np.sqrt(value)
    features = np.vstack([kernels(slice(i, i + 1024)) @ marks.T @ root for i in range(0, len(y), 1024)])
    features = np.hstack([features, np.ones((len(y), 1))])
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]  # each language counts alike
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (features * weight[:, None]).T @ features
    beta = np.linalg.solve(gram + ridge * np.eye(len(gram)), (features * weight[:, None]).T @ target)
    full = np.vstack([root @ beta[:-1], beta[-1:]])
    return Model(names, table, size, marks.T.astype(np.float32), full.astype(np.float32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text; 'und' and 0 if it has no letter."""
    k = presence(texts, model.table, model.spectrum) @ model.landmarks
    f = np.hstack([k, np.ones((len(k), 1), np.float32)]) @ model.weights
    best = f.argmax(1)
    e = np.exp(4 * (f - f.max(1, keepdims=True)))
    score = (e / e.sum(1, keepdims=True)).max(1)
    known = [has_letter(t.decode()) for t in texts]
    return [model.labels[b] if ok else "und" for b, ok in zip(best.tolist(), known)], [float(s) if ok else 0.0 for s, ok in zip(score.tolist(), known)]


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, per_label: int = 400, most_labels: int = 1000, most_rows: int = 20_000) -> DataFrame | None:
    """At most ``per_label`` labelled texts of each of the commonest ``most_labels`` labels (``most_rows`` in all), by a hash of doc_id.

    Only rows outside the held-out fold count. Ranks within a label are taken over rows whose
    hash is under a bound that about twice ``per_label`` of them pass, never over a whole label.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out()).withColumn("_h", F.xxhash64("doc_id").bitwiseAND(0x7FFFFFFFFFFFFFFF))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).collect()
    if not sizes:
        return None
    per_label = min(per_label, max(1, most_rows // len(sizes)))
    bound = F.lit(-1)
    for r in sizes:
        share = min(1.0, (2.0 * per_label + 50) / r["count"])
        bound = F.when(F.col("lang") == r["lang"], min(int(share * 2.0**63), 2**63 - 1)).otherwise(bound)
    near = rows.where(F.col("_h") <= bound)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text"))
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label).select("lang", "k", "text")


def _sets(longest: int):
    def run(batches):
        for b in batches:
            codes = [code_sets(t, longest).tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], names=["lang", "k", "codes"])

    return run


def _shared_counts(batches):
    """How many texts of a batch have each n-gram."""
    for b in batches:
        if b.num_rows:
            code, n = np.unique(np.concatenate([np.frombuffer(c, np.uint32) for c in b.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])


def _bits(spectrum: list[int]):
    place = np.array(spectrum, np.uint32)

    def run(batches):
        for b in batches:
            rows = [np.packbits(np.isin(place, np.frombuffer(c, np.uint32), assume_unique=True)).tobytes() for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["lang", "k", "bits"])

    return run


def learn(docs: DataFrame, per_label: int = 400, landmarks: int = 256, spectrum: int = 12_000, longest: int = 3) -> Model | None:
    """A model from the labelled rows outside the held-out fold (see ``training_rows``), or None without any.

    The spectrum holds the n-grams that most training texts share. No text leaves its task: the
    driver gets ``spectrum`` codes and as many bits for each training text.
    """
    if spectrum >= 1 << 15:
        raise ValueError("a spectrum holds fewer than 32768 n-grams")
    rows = training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), per_label)
    if rows is None:
        return None
    with scratch(docs.sparkSession):
        sets = materialize(rows.mapInArrow(_sets(longest), "lang string, k int, codes binary"), "language")
        counts = sets.select("codes").mapInArrow(_shared_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        best = sorted(r["code"] for r in counts.orderBy(F.desc("n"), "code").limit(spectrum).collect())
        train = sets.mapInArrow(_bits(best), "lang string, k int, bits binary").orderBy("lang", "k").collect()
    bits = np.frombuffer(b"".join(r["bits"] for r in train), np.uint8).reshape(len(train), -1)
    return fit(bits, [r["lang"] for r in train], best, landmarks, longest)


def _unpacked(parts) -> Model:
    names, codes, marks, weights = parts
    table, size = _table(codes)
    return Model(names, table, size, marks, weights)


def _scoring(shared, key: str, at: int, names: list[str]):
    def run(batches):
        model = worker_cache(("language", key), lambda: _unpacked(shared.value))
        for b in batches:
            texts = pc.fill_null(b.column(at).cast(pa.binary()), b"")
            langs, scores = [], []
            for i in range(0, len(texts), 128):
                lang, score = predict(model, texts[i : i + 128].to_pylist())
                langs += lang
                scores += score
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])

    return run


def identify_rows(docs: DataFrame, **how) -> tuple[DataFrame, str, str]:
    """``docs`` with the predicted language and its score, learned from its own labelled rows, and the names of both.

    Labels, source and doc_id are no inputs of a prediction. The broadcast model is bounded by
    the landmarks and the spectrum. Scores are products of batches with the landmarks.
    """
    spark, names = docs.sparkSession, unused(docs.columns, "lang_pred", "lang_score")
    model = learn(docs, **how)
    if model is None:
        return docs.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)}), *names
    codes = [np.flatnonzero(t >= 0) for t in model.table]
    shared = spark.sparkContext.broadcast((model.labels, codes, model.landmarks, model.weights))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(_scoring(shared, uuid.uuid4().hex, docs.columns.index("text"), names), schema), *names


def identify(docs: DataFrame, **how) -> DataFrame:
    """Predicted language of every whole text: doc_id, held_out, lang_pred, score from 0 to 1.

    A text that is null or has no letter is 'und' with score 0, and so are all if there is
    nothing to learn from. A very long text is read whole, but counts by which n-grams it has.
    Of equal class scores the first label in order wins. A null doc_id hashes as an empty
    string. Repeated rows are scored one by one. An empty table gives an empty result; other
    columns are ignored.
    """
    scored, pred, score = identify_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"), **how)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"))


def documents_with_language(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text is in a language: not 'und' (see ``identify``)."""
    scored, pred, _ = identify_rows(docs, **how)
    return scored.where(F.col(pred) != "und").select(*docs.columns)
