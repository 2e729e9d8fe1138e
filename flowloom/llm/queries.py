"""Registered queries of the training-data operators: each reads its whole table and returns the whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.chat_format import chat_digest, format_chats, text_parts
from flowloom.llm.decontaminate import find_contamination
from flowloom.llm.hard_negatives import hard_negatives
from flowloom.llm.minhash_join import near_duplicates
from flowloom.llm.quality_net import fit_on_labels, held_out, score_quality
from flowloom.llm.quality_rules import apply_rules
from flowloom.llm.secret_scan import scan_secrets
from flowloom.llm.sentencepiece_bpe import encode_texts
from flowloom.llm.sharding import assign_shards
from flowloom.llm.substring_dedup import remove_repeats
from flowloom.llm.token_counts import count_tokens
from flowloom.llm.url_filter import judge_urls
from flowloom.llm.vectors import finite_vectors
from flowloom.llm.whitening import whiten_embeddings

QUERIES = {}
#: Bytes of a shard: small, so that the small test tables too need several.
SHARD_BYTES = 1 << 20
# The rules of the query.
URL_RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS r(host, path, verdict)"


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every executor has the same installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs, net, ["doc_id"])
    return scored.select("doc_id", held_out(scored.doc_id).alias("held_out"), "score", "predicted")


@_query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"), ["doc_id"])


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).drop("text")


@_query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])


@_query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(_table(spark, sf_dir, "documents"), ["doc_id"])


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {URL_RULES}"))


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = given.unionByName(control)
    return chat_digest(format_chats(rows.withColumn("parts", text_parts(F.col("text")))))


@_query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finite_vectors(_table(spark, sf_dir, "embeddings"), "embedding").where("label IS NOT NULL")
    rows = rows.select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vec"),
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
