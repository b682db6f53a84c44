"""Ordered lists per key, whole, without one unbounded group in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .heavy import salted_join, split_heavy
from .numbering import row_numbers

LIST_LIMIT = 4096


def _gather(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(
        F.min("_first").alias(f"first_{order}"),
        F.transform(pairs, lambda p: p["v"]).alias(name),
    )


def ordered_lists(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, limit: int = LIST_LIMIT
) -> DataFrame:
    """``keys, part, first_<order>, <name>_from, <name>``: values of each key in ``order``.

    ``<name>_from`` is the place of the part's first value in the key's whole list.

    A key with up to ``limit`` rows gives one row, part 0.  A larger key gives
    parts of ``limit`` values each, in order, so nothing is dropped and no row
    or task holds more than ``limit`` values of one key.  ``order`` must be a
    unique number.
    """
    by = [*keys, "part"]
    ordinary, heavy = split_heavy(df.select(*keys, order, value), keys, limit, order)
    ordinary = ordinary.withColumns({"part": F.lit(0), "_first": F.col(order)})
    place = (F.col("part").cast("bigint") * limit).alias(f"{name}_from")
    if heavy is None:
        return _gather(ordinary, by, order, value, name).select("*", place)
    firsts = heavy.groupBy(*keys).agg(F.min(order).alias("_first"))
    numbered = row_numbers(heavy, order, group=keys, name="_no")
    sliced = salted_join(numbered, firsts, keys, "_no").withColumn(
        "part", F.floor((F.col("_no") - 1) / F.lit(limit)).cast("int")
    )
    parts = ordinary.unionByName(sliced.drop("_no"))
    return _gather(parts, by, order, value, name).select("*", place)


def group_references(df: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """``row_idx, part, prompt, references``: all chosen texts of each prompt.

    Texts are in first-seen order, and ``row_idx`` (the prompt's first row) is
    the prompt's id; every part of a prompt carries it.  Rows are grouped by a
    digest, so a prompt's text is shuffled once and not with each of its rows.
    """
    keyed = df.select(F.unhex(F.md5("prompt")).alias("_prompt"), "row_idx", "chosen")
    lists = ordered_lists(keyed, ["_prompt"], "row_idx", "chosen", "references", limit)
    lists = lists.select(F.col("first_row_idx").alias("row_idx"), "part", "references_from", "references")
    return lists.join(df.select("row_idx", "prompt"), "row_idx").select(
        "row_idx", "part", "prompt", "references_from", "references"
    )


def generation_records(prompts: DataFrame, outputs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Prompts with their generated texts, one record per (prompt, part).

    ``prompts``: ``sample_id, part, history, prompt, references``;
    ``outputs``: ``sample_id, output_idx, output`` (``output_idx`` unique).
    A prompt without outputs keeps an empty list.  Output lists above ``limit``
    continue in further parts, which hold no history or prompt text again.
    """
    lists = ordered_lists(outputs, ["sample_id"], "output_idx", "output", "outputs", limit)
    lists = lists.select("sample_id", "part", "outputs_from", "outputs")
    if "references_from" not in prompts.columns:
        prompts = prompts.withColumn("references_from", F.lit(0).cast("bigint"))
    records = prompts.join(lists, ["sample_id", "part"], "full_outer")
    no_text = F.array().cast("array<string>")
    return records.select(
        "sample_id",
        F.col("part").cast("int").alias("part"),
        "history",
        "prompt",
        F.coalesce("outputs_from", F.lit(0).cast("bigint")).alias("outputs_from"),
        F.coalesce("references_from", F.lit(0).cast("bigint")).alias("references_from"),
        F.coalesce("outputs", no_text).alias("outputs"),
        F.coalesce("references", no_text).alias("references"),
    )
