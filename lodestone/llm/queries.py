"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, language_id, linededup, merkle, mixing, oracles, packing, secrets, sharding, spotsigs
from lodestone.llm._shared import documents_of, scratch_path
from lodestone.llm.minhash import near_duplicates


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents_of(spark, sf_dir), weights=(5, 2, 1), share=1.5, cap=2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals whole documents to written shards and reads those back: where each row is, and what arrived there."""
    shards = [f"shard-{k:03d}" for k in range(64)]
    placed = sharding.place(documents_of(spark, sf_dir).select("doc_id", "text"), shards)
    path = scratch_path(spark, "shards")
    sharding.write_shards(placed, path)
    back = spark.read.schema(placed.schema).parquet(path)
    return back.select("doc_id", "slot", "shard", "shard_name", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents_of(spark, sf_dir).select("doc_id", "text"), least_words=50)
    return found.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents_of(spark, sf_dir), vocabulary(), window=4096, end_id=2, with_ids=False)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents_of(spark, sf_dir), shingle=2, percent=80)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents_of(spark, sf_dir), scope=256)


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of ``pages`` in which some records rotted and some were lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rotten = F.when(F.col("page_id") % 50 == 7, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = merkle.manifest(pages.withColumn("html", rotten)).where("page_id % 211 != 3")
    return merkle.audit(merkle.manifest(pages), replica)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(documents_of(spark, sf_dir))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_sharding": op2_sharding,
        "op3_line_dedup": op3_line_dedup,
        "op4_packing": op4_packing,
        "op5_minhash": op5_minhash,
        "op6_secrets": op6_secrets,
        "op7_merkle": op7_merkle,
        "op8_spotsigs": op8_spotsigs,
        "op9_ann": op9_ann,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others are held against brute force in the tests."""
    return {"op3_line_dedup": oracles.OP3, "op5_minhash": oracles.OP5, "op6_secrets": oracles.OP6, "op7_merkle": oracles.OP7}
