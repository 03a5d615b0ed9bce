"""The pipeline's stages one by one on the odd table, and its contract."""

from pyspark.sql import functions as F

#: Names that stages use inside, now or in an earlier form.
CLASHES = ("_dup_row", "_pii_row", "_mix_row", "_lang_pred", "_lang_score", "lang_pred", "lang_score", "row_file", "row_number", "row_file_", "pii_key", "pii_rid", "pii_spans", "mix_parts", "fp", "f", "r", "d", "rid", "size", "text_", "row_index", "parts", "_metadata")


def test_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline as c

    assert 4 <= len(c.STAGES) <= 5
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"clash {n}").alias(n) for n in CLASHES])
    plain.write.parquet(f"{tmp_path}/in")
    frames, counts = [plain, spark.read.parquet(f"{tmp_path}/in")], []
    now = frames[1]
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(now.count())
        if k < len(c.STAGES) - 1:
            assert now.columns == plain.columns
            assert now.where(" or ".join(f"`{n}` is null or `{n}` <> 'clash {n}'" for n in CLASHES)).count() == 0
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    assert not kept & {500, 501, 502, 504} and set(range(240)) <= kept
    copies = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/1").where("doc_id >= 300 and doc_id < 400").collect()]
    assert copies == []  # document 0 stands for them
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[4] > 0
    assert spark.read.parquet(f"{tmp_path}/2").where("n_chars <> length(text)").count() == 0


def test_stages_take_any_frame(spark, docs):
    """Rows that are no plain scan of files are told apart as well, and null texts stay as they are."""
    import corpus_pipeline as c

    odd = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = odd.unionByName(odd.where("doc_id in (1, 500)")).orderBy("lang")
    stages = dict(c.STAGES)
    texts = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in df.collect())
    assert texts(stages["PII"](spark, odd, "")) == texts(odd)
    assert len(texts(stages["SimHash near-dedup"](spark, odd, ""))) == len(texts(stages["SimHash near-dedup"](spark, odd.dropDuplicates(), "")))
    mixed = texts(stages["mixing"](spark, odd, ""))
    assert mixed and not any(t[2] or not t[3].split() for t in mixed)


def test_empty(spark, no_docs, tmp_path):
    import corpus_pipeline as c

    now = no_docs
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.count() == 0


def test_run(spark, docs, tmp_path):
    import corpus_pipeline as c

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    by_hand = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, by_hand, "").write.parquet(f"{tmp_path}/{k}")
        by_hand = spark.read.parquet(f"{tmp_path}/{k}")
    total = lambda df: sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert total(c.run(spark, str(tmp_path))) == total(by_hand)
