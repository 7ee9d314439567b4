"""The operators as queries over the supplied tables, and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rankmill.llm import (
    chat,
    decontaminate,
    jaccard,
    linededup,
    lmscore,
    manifest,
    packing,
    quality,
    resample,
    sharding,
    sql,
    substring,
    tokenfiles,
    toxicity,
)
from rankmill.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(text) -> object:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_chat_format(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as chains of replies, formatted and read back."""
    marker = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame(
        [(-1, 0, "user", marker), (-1, 1, "assistant", marker)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    nodes = chat.chain(rows, "conv_id", ["turn", "role", "text"])
    segments = chat.format_paths(nodes, "conv_id", "node", "parent")
    return chat.read_back(segments, ["conv_id", "leaf"]).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


def op3_lm_score(spark: SparkSession, d: str) -> DataFrame:
    """Documents labelled good are the target, all others the background."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    documents = table(spark, d, "documents").select("doc_id", "text")
    return lmscore.cross_entropy_difference(documents, target_col=None, targets=good)


def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256_hex(F.array_join(ids, ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    documents = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(documents, labels.where(~held_out))
    return toxicity.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )


def op6_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(documents, shingle=3, similarity=(90, 100)).select(
        "doc_id", "n_shingles", "component_id"
    )


def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, d, "documents").select("doc_id", "text")))


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    records = table(spark, d, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    sharded = sharding.shard_records(records, "doc_id", [1.0] * SHARDS, ["text_crc32", "size"])
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return cleaned.select(
        "doc_id",
        "n_words",
        "n_removed",
        sha256_hex(F.col("text")).alias("kept_sha256"),
        F.array_join(spans, ",").alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").where("quality in (0, 1)").select("doc_id", F.col("quality").alias("label"))
    return quality.apply_rules(documents, quality.fit(documents, labels))


def op11_token_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents written as token files, and read back from them."""
    path = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(table(spark, d, "documents"), path)
    read = tokenfiles.with_checksums(tokenfiles.document_index(spark, path), path)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_importance_resample(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document or so, by a checksum of its id, is folded with one more in ``n_chars``."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    instead = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]
    return manifest.manifest(table(spark, d, "documents"), fields, "lang", ["doc_id"], tampered, instead)


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)


def all_queries() -> dict[str, Query]:
    found = [
        op1_chat_format,
        op2_line_dedup,
        op3_lm_score,
        op4_decontaminate,
        op5_toxicity,
        op6_ngram_jaccard,
        op7_packing,
        op8_sharding,
        op9_substring_dedup,
        op10_quality_rules,
        op11_token_files,
        op12_importance_resample,
        op13_merkle_manifest,
        pipeline,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": sql.LINE_DEDUP,
        "op4_decontaminate": sql.DECONTAMINATE,
        "op6_ngram_jaccard": sql.NGRAM_JACCARD,
        "op9_substring_dedup": sql.SUBSTRING_DEDUP,
        "op12_importance_resample": sql.importance_resample(),
        "op13_merkle_manifest": sql.merkle_manifest(),
    }
