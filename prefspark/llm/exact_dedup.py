"""Exact duplicates with a heavy-hitter split (operator 4, DataFrame functions only).

A Misra-Gries summary over 64-bit keys of the digests finds the few texts that
may hold a large share of all rows.  Their exact counts and winners are found by
an aggregate that combines on the map side, and this bounded table is broadcast:
rows of heavy texts are decided where they lie and never meet in one task.  All
other digests have less than ``1 / tracked`` of the rows each (that is the
summary's guarantee, up to a constant) and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prefspark.llm.common import id_and_text, sha256, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does that by itself where all characters are ASCII."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def frequent_keys(digests: DataFrame, tracked: int) -> DataFrame:
    """At most ``tracked / 2`` keys ``h``; holds each key with a share over about ``4 / tracked``.

    ``approx_top_k`` keeps a Misra-Gries summary of ``tracked`` counters per task
    and merges the summaries, so what is shuffled does not grow with the rows.
    """
    top = F.expr(f"approx_top_k(h, {tracked // 2}, {tracked})")
    return digests.select(F.xxhash64("text_sha256").alias("h")).agg(top.alias("top")).select(
        F.explode("top.item").alias("h")
    )


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 1024, heavy_rows: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    largest doc_id stays.  A null text equals an empty one.  Rows that repeat a
    doc_id share its decision and count in ``group_size``; a null doc_id stays
    only in a group that has no other.  No row is dropped.  An empty table gives
    an empty result.

    tracked: counters of the frequency summary; bounds the broadcast rows.
    heavy_rows: candidates with fewer exact rows than this go the ordinary way;
    either way gives the same rows.
    """
    texts = id_and_text(df, id_col, text_col)
    digests = stored(texts.select("doc_id", sha256(ascii_lower(F.col("text"))).alias("text_sha256")), "digests")
    candidates = frequent_keys(digests, tracked)
    winners = stored(
        digests.join(F.broadcast(candidates), F.xxhash64("text_sha256") == F.col("h"), "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= heavy_rows),
        "winners",
    )
    marked = digests.join(F.broadcast(winners), "text_sha256", "left")
    same = Window.partitionBy("text_sha256")
    heavy = marked.where(F.col("group_size").isNotNull())
    light = marked.where(F.col("group_size").isNull()).select(
        "text_sha256",
        "doc_id",
        F.max("doc_id").over(same).alias("keep_id"),
        F.count("*").over(same).alias("group_size"),
    )
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
