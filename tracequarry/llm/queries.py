"""The numbered queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .alignment import align_tokenizers
from .byte_bpe import round_trip_digests
from .chat_tools import REPLY_SCHEMA, calls_and_results, link_tool_calls
from .collocations import collocations
from .common import table
from .fingerprint import fingerprints
from .id_codec import read_ids, write_ids
from .line_dedup import dedup_passages
from .minhash import near_duplicates
from .neighbours import nearest_neighbours
from .packing import pack
from .quality_model import classify_quality
from .quality_rules import quality_rules
from .toxicity import ToxicityModel, learn_toxicity, score_toxicity


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "line_dedup.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no URL: their source is the host, and the language within it the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = table(spark, sf_dir, "labels")
    found = classify_quality(docs, labels.where(~held_out(F.col("doc_id"))))
    return found.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))


def op4_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(spark, write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for evaluation."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def toxicity_model(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return learn_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "toxicity.*")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_and_results(table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, REPLY_SCHEMA)
    return linked.withColumn("violations", F.array_join("violations", "; "))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality_rules(docs, keep=["doc_id"]).select("doc_id", "quality.*")
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_id_blocks": op4_id_blocks,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprint": op6_fingerprint,
    "op7_tool_calls": op7_tool_calls,
    "op8_minhash": op8_minhash,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_neighbours": op11_neighbours,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {"op7_tool_calls": sql.TOOL_CALLS, "op10_quality_rules": sql.quality_rules_sql(), "op12_collocations": sql.COLLOCATIONS}
