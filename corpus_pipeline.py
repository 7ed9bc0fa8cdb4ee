"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import jaccard, leakage, packing, quality, secrets
from scenelake.llm.common import cut, small_batches, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chance of the top grade, good and not toxic, is under one half."""
    small_batches(spark)
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")), levels=3)
    return quality.keep(docs, model, tail=0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class linked by Jaccard similarity 0.8 of five-word shingles."""
    small_batches(spark)
    return jaccard.dedupe(docs, width=5, num=8, den=10)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    small_batches(spark)
    return leakage.clean(docs, table(spark, sf_dir, "benchmark"))


def unsecret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay, n_chars is that of the new text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer=TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", unleaked),
    ("secrets", unsecret),
    ("packing", packed),
]

#: Trained models and approximate text statistics decide, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the result is the last stage's."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
