"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, fingerprints, langid, licenses, minhash, mixing, negatives, nndescent, pii, quality, secrets, sentencepieces, warc
from .oracles import ORACLE_SQL as ORACLE_SQL
from .shared import cut, scratch_path, table

#: Where the tokenizer's files are.
TOKENIZER = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=3, threshold=85)


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.predict(docs, model)
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = cut(warc.write_archives(pages, scratch_path(spark, "warc")), "manifest")
    read = warc.read_archives(manifest.select("path", "bytes"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.synthetic_findings(spark))
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "start", "end", F.length("value").cast("long").alias("length"), "probability", "is_secret")


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0, positives=5, negatives=3, least=50, most=95)


@query
def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op11."""
    return op11_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


@query
def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op1."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


@query
def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op3."""
    return op3_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")
