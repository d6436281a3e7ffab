"""A corpus from raw documents to packed sequences, in stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents, under any
names those may have. Each judges every row by itself: rows with a null doc_id or one that repeats are rows like others.
Null and empty texts score as an empty window, have no copies, lose nothing, hold no benchmark item and are packed as the
end id alone; very long texts are read whole. Of rows equal in doc_id and text one stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import decontamination, near_duplicates, packing, sentence_spans, toxicity
from factorlake.llm.queries import tokenizer_path
from factorlake.llm.shared import Scratch, remove, swept, table

TOXIC_FROM = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    columns = docs.columns
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col(scored.columns[-1]) < TOXIC_FROM).select(*columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id; one of rows that are equal."""
    return near_duplicates.without_copies(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of passages that stand earlier in the corpus go; a document that had no others goes whole."""
    columns = docs.columns
    cut = sentence_spans.without_repeats(docs)
    removed, total = cut.columns[-1], cut.columns[-2]
    left = cut.filter((F.col(removed) == 0) | (F.col(removed) < F.col(total)))
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold part of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learnt models and edit distances are no SQL; tests hold the run against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES:
        path = scratch.path(name)
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
