"""One query per operator, each over the whole ``documents`` table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, license_scan, line_dedup, line_quality, manifest, merkle, mixing,
               ngram_join, oracle, pii, quality, sharding, spelling, toxicity)
from .common import documents, written

N_SHARDS = 8
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"))
    return sharding.shard(rows, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    drawn = mixing.draw(rows, N_SHARDS)
    return drawn.select("row.doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies",
                        F.transform("chunks", lambda c: F.floor(c / F.col("chunks_per_shard"))
                                    .cast("int")).alias("shards"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    # the tree of the corpus: source / language / groups of 64 ids / document
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"),
                       F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs, path)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(documents(spark, sf_dir), labels)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonyms(docs).select(
        "doc_id", "text", F.size("found").cast("long").alias("n_found"),
        F.array_join(F.transform("found", lambda x: x["kind"]), ",").alias("kinds"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return ngram_join.jaccard_components(docs, 3, 90, 100).select(
        "doc_id", "n_shingles", "component_id", "class_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    measured = written(quality.measure(docs, public_tokenizers.path(PIECES)).drop("text"),
                       "quality")
    return quality.judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode(docs, path, pattern).drop("text")
    return bpe.decode(coded, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality.score(documents(spark, sf_dir), labels)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir).select("doc_id", "text"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_sharding, op2_mixing, op3_license_scan, op4_toxicity, op5_quality, op6_pseudonyms,
        op7_merkle, op8_ngram_join, op9_line_dedup, op10_byte_bpe,
        op11_line_quality, op12_spelling, op13_manifest)}

# Hash-driven draws, tokenizers, trained models and graph closures are no SQL; tests/llm
# compares the other queries with brute-force versions.
ORACLE: dict[str, str] = oracle.ORACLE
