"""Cleans a corpus: each stage takes what its predecessor kept, written as Parquet and read again.

STAGES lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the last
return the columns of ``documents``.  Defined cases are those of the operators: rows without text are
no duplicates, hold no passage and encode to no tokens; they are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.llm import bpe, decontam, jaccard, pii, toxicity
from polyview.llm.common import table
from polyview.session import cut

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this corpus's labels, flags by the cut of their language go."""
    model = toxicity.train_all(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(~F.col("flagged")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.75 or more hold together, the lowest doc_id stays."""
    return jaccard.one_per_class(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data turns into its kind in brackets; ``n_chars`` follows the text."""
    masked = pii.redact(docs, pii.train(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.char_length("text").cast(kind)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", lossless.alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("bpe", tokenize),
]

ORACLE_SQL = None  # a trained classifier and a trained field decide; tests compare with brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
