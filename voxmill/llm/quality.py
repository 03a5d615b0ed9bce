"""Quality rules with host verdicts from shrunken failure rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SYMBOL, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def _repeated(words: list[bytes]) -> int:
    """Words that lie in some 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen: dict = {}
    number = [seen.setdefault(w, len(seen)) for w in windows]
    if len(seen) == len(windows):
        return 0
    ids = np.array(number)
    hit = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def _duplicates(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _measure(batches):
    for b in batches:
        texts = pc.fill_null(b.column(1).cast(pa.binary()), b"")
        rows = []
        for t in texts.to_pylist():
            raw = np.frombuffer(t, np.uint8)
            words = t.split()
            chars = int(((raw & 0xC0) != 0x80).sum() - _SPACE[raw].sum())
            rows.append((len(words), chars, int(_SYMBOL[raw].sum()), _duplicates(t), _repeated(words)))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def document_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts over each whole text and the verdict of the document rules alone."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    m = narrow.mapInArrow(_measure, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return m.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def host_verdicts(rules: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """``(host, n, failed, rate, host_failed)``: failure rates shrunk by an empirical beta prior.

    The prior's mean is the pooled rate m = sum(failed) / sum(n); its strength s comes from
    moments over hosts: with V = sum(n * (r - m)^2) / sum(n) and W = m (1 - m) the sampling
    part is W * hosts / sum(n), so that s = W / max(V - W * hosts / sum(n), W / 1000) - 1, at
    least 1. The shrunken rate is (failed + s * m) / (n + s); above ``max_rate`` a host fails.
    """
    stats = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    t = stats.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), (F.sum("failed") / F.sum("n")).alias("m"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q")).first()
    m = t["m"] or 0.0
    w, s = m * (1 - m), 1.0
    if w > 0:
        s = max(w / max(t["q"] / t["docs"] - m * m - w * t["hosts"] / t["docs"], w / 1000) - 1, 1.0)
    rate = (F.col("failed") + s * m) / (F.col("n") + s)
    return stats.select("host", "n", "failed", rate.alias("rate"), (rate > max_rate).alias("host_failed"))


def apply_quality(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.5) -> DataFrame:
    """Document rules, host verdicts, and whether each document is kept.

    A document goes if a rule fails it or if its host fails; hosts that are clean on the whole
    cost no clean document. Rule failures are counted per host with a map-side combine, so a
    host with a third of all rows is one row per task; verdicts come back by a join on host
    that Spark may broadcast (by size) or split when skewed.

    Returns doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. A null or empty text has no words and fails; a very long one is counted
    whole. A rate of exactly ``max_rate`` passes, as do counts on a rule's bound. Documents with a null host form a
    host of their own. Repeated rows are judged one by one. An empty table gives an empty
    result; other columns are ignored.
    """
    from voxmill.llm._common import materialize

    rules = materialize(document_rules(docs, host, min_words, max_repeat_percent), "quality")
    bad = host_verdicts(rules, max_rate).select(F.col("host").alias("_h"), "host_failed")
    out = rules.join(bad, rules["host"].eqNullSafe(bad["_h"]), "left")
    return out.select(*rules.columns, (~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))).alias("kept"))


#: The same in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
lin AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
r AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lin.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid LEFT JOIN lin ON w.rid = lin.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT))::DOUBLE AS failed FROM b GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS docs, count(*)::DOUBLE AS hosts, sum(failed) / sum(n) AS m, sum(failed * failed / n) AS q FROM h),
p AS (SELECT m, CASE WHEN m * (1 - m) > 0 THEN greatest(m * (1 - m) / greatest(q / docs - m * m - m * (1 - m) * hosts / docs, m * (1 - m) / 1000) - 1, 1.0) ELSE 1.0 END AS s FROM t),
k AS (SELECT source, (failed + s * m) / (n + s) > 0.5 AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source
"""
