"""A corpus pipeline over the documents table: clean, single, masked texts packed into sequences.

Each stage takes documents and returns documents (the last one pieces of
sequences); a stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.llm import packing, private, queries, repeats, similar, toxicity
from contactmill.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return repeats.keep_good_texts(docs, "text")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labels of documents still here, does not reject."""
    model = toxicity.fit_toxicity(as_sources(docs), queries.toxic_labels(spark, sf_dir))
    return toxicity.drop_toxic(docs, model, "text")


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return similar.keep_first_of_similar(docs, "doc_id", "text")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` is that of the new text."""
    return private.mask_private_data(docs, "text").withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, with their token ids."""
    pieces = packing.pack_sources(as_sources(docs), queries.vocabulary("word_bpe_49k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


def as_sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))


STAGES = [("quality rules", quality), ("toxicity", not_toxic), ("near duplicates", single), ("private data", masked), ("packing", packed)]

# Suffix arrays, a learned grammar and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
