"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what the next one reads.

Quality rules drop what they reject; one document of each group of near copies stays; secrets are replaced in the texts;
sources are mixed to their target weights, a document standing as often as the mix takes it; the mix is encoded. Null
texts fail the quality rules, so later stages see none; null sources are a source of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import minhash, mixing, quality, secrets, sentencepieces
from rasterloom.llm.queries import TOKENIZER
from rasterloom.llm.shared import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; n_chars follows the text."""
    model = secrets.train(secrets.synthetic_findings(spark))
    clean = secrets.redact(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw_documents(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", source_mixing),
    ("SentencePiece", sentencepiece_encoding),
]

#: No SQL for DuckDB: minhash classes, the forest and the encoder are beyond it. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs
