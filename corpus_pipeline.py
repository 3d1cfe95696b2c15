"""The corpus pipeline: documents through five operators of :mod:`rowloom.llm`, each over all that the one before
kept. Every stage but the last returns the columns of documents, and each begins with the executors' heaps emptied of
what was before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.bpe import encode_documents
from rowloom.llm.common import table, trimmed_executors, written
from rowloom.llm.exact_dedup import drop_exact_copies
from rowloom.llm.mixing import mixed
from rowloom.llm.near_dedup import drop_near_copies
from rowloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic."""
    trimmed_executors(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest id."""
    trimmed_executors(spark)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document of the smallest id."""
    trimmed_executors(spark)
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each time a document is taken, the one at a source's cut with
    its first words alone."""
    trimmed_executors(spark)
    return mixed(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its token ids."""
    trimmed_executors(spark)
    ids = encode_documents(docs.select("doc_id", "source", "text"))
    return ids.select("doc_id", "source", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
#: The models and the sketches have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
