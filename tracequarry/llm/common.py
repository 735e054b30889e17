"""What the training-data operators share: reading tables, scratch tables, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.scratch import delete_at_end, forget, scratch_root, written

__all__ = ["NOT_SPACE", "SPACE", "delete_at_end", "forget", "labelled_texts", "scratch_root", "small", "table", "words", "written"]

#: Whitespace that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most `rows` rows, which is counted first up to that bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (doc_id, and labels; each doc_id once, to be broadcast) with text: of rows of docs that share a doc_id the text
    with the least hash, so that there are no more rows than chosen ones."""
    labels = [c for c in chosen.columns if c != "doc_id"]
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"), *labels)).alias("_r")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(least)
    return found.select("doc_id", "_r.text", *[f"_r.{c}" for c in labels])


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), lambda w: w != "")
