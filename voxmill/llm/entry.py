"""Queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark, sf_dir):
    from voxmill.llm.sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir))


def op2_packing(spark, sf_dir):
    from voxmill.llm.packing import pack_documents, with_crc

    return with_crc(pack_documents(_docs(spark, sf_dir)))


def op3_pii(spark, sf_dir):
    from voxmill.llm.pii import find_personal_data, span_digest

    return span_digest(find_personal_data(_docs(spark, sf_dir)))


def op4_token_files(spark, sf_dir):
    from voxmill.llm.token_files import token_file_digest

    return token_file_digest(_docs(spark, sf_dir))


def op5_quality(spark, sf_dir):
    from voxmill.llm.quality import apply_quality

    return apply_quality(_docs(spark, sf_dir)).drop("host")


def op6_mixing(spark, sf_dir):
    from voxmill.llm.mixing import taken_words

    return taken_words(_docs(spark, sf_dir))


def op7_language(spark, sf_dir):
    from voxmill.llm.langid import identify

    return identify(_docs(spark, sf_dir))


def op8_simhash(spark, sf_dir):
    from voxmill.llm.simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op9_embeddings(spark, sf_dir):
    from voxmill.llm.embed_dedup import link_embeddings

    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_token_counts(spark, sf_dir):
    from voxmill.llm.token_counts import count_tokens

    return count_tokens(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_packing, op3_pii, op4_token_files, op5_quality, op6_mixing, op7_language, op8_simhash, op9_embeddings, op10_token_counts)}


def oracles() -> dict[str, str]:
    from voxmill.llm import embed_dedup, quality

    return {"op5_quality": quality.SQL, "op9_embeddings": embed_dedup.SQL}


ORACLES: dict[str, str] = oracles()
