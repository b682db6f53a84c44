"""From raw documents to packed token sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written and read again as the next one's docs.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prefspark.llm import langid, line_dedup, ngram_join, packing, secrets
from prefspark.llm.common import documents, stored, unused, vocabulary

#: Documents of whose n-grams less than this share belongs to their language are rejected.
LEAST_SHARE = 0.3

#: No SQL: the secrets' random forest and the token ids cannot be expressed in it.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no learned language, go; null and empty texts with them."""
    filters = langid.learn(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    return langid.accepted(docs, filters, LEAST_SHARE)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; so do documents of which no word is left."""
    return _with_length(line_dedup.with_clean_lines(docs)).where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the least doc_id stays, once, with all texts it has; rows without doc_id all stay."""
    classes = ngram_join.near_duplicates(docs)
    kept_id = unused(docs, "kept_id")
    kept = stored(classes.where("doc_id = class_id").select(F.col("doc_id").alias(kept_id)).distinct(), "kept")
    chosen = docs.join(kept, F.col("doc_id") == F.col(kept_id), "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.unionByName(docs.where("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    # Numbered once and stored, so that a span meets the row it was found in, with or without doc_id.
    row = unused(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = secrets.scan_secrets(rows, id_col=row).where("is_secret").select("doc_id", "start", "length")
    return _with_length(secrets.redact(rows, stored(found, "secrets"), id_col=row).drop(row))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
