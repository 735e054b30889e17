"""From raw documents to packed sequences: quality rules, toxicity, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and gives the columns of documents; the
last gives the pieces of the packed sequences. run() writes each stage to the shared folder and reads it again, so a lost
executor costs the running stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm.common import table, written
from tracequarry.llm.line_dedup import drop_repeated_lines
from tracequarry.llm.minhash import drop_near_duplicates
from tracequarry.llm.packing import pack
from tracequarry.llm.quality_rules import reject_low_quality
from tracequarry.llm.queries import toxicity_model
from tracequarry.llm.toxicity import reject_toxic

#: SQL can express neither the learned weights nor the packing plan; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_low_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, toxicity_model(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
