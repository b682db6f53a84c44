"""Shared pieces: input columns, stored intermediates, word splitting."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prefspark.session import scratch_path

#: ASCII white space that ends a word: blank and 0x09 to 0x0D (what bytes.split() splits on).
BLANKS = " \t\n\x0b\x0c\r"


def vocabulary() -> str:
    """The byte-level BPE vocabulary file that the registered queries use."""
    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that matter, under fixed names; a null text is empty.

    Other columns of ``df`` do not travel, so their names cannot clash.
    """
    return df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text")
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read.  The
    shuffle files that made it are of no more use and go when it is written.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sha256(text: Column) -> Column:
    """Lowercase hex digest of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
