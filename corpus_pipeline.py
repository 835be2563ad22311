"""Training-data pipeline: quality, language, exact copies, near copies, packing.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder, rereads it for the next one and removes all intermediate tables but that one. All stages but the last return
the columns of documents, also of tables with further columns, whatever their names. An empty table goes through every stage.
Very long texts are judged, compared and packed whole by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import exact_dedup, lang_id, minhash, packing, quality
from statloom.llm.common import drop_written, folders, shared_table, table, written
from statloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null, empty and blank-only junk texts go; repeated rows are judged each."""
    return quality.accepted_rows(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with some confidence. Texts that are null or without a letter go."""
    return lang_id.confident_rows(docs, lang_id.learn(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null counting as empty, one row: that with the largest id, null ids last."""
    return exact_dedup.distinct_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id. Rows with a null id stay; so do all rows of an id that stays."""
    name = "kept"
    while name in docs.columns:
        name += "_"
    kept = minhash.near_dedup(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_semi")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens; every token of every document lies in one. A null or empty text is its end mark."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Quality, language, near copies and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, before | folders(docs))
    return docs
