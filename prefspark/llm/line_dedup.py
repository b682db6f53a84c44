"""Line deduplication by overlapping three-line windows (operator 2, DataFrame functions only).

Each run of three consecutive non-blank lines of a document is hashed to 128
bits.  Windows seen more than once anywhere keep their first place (smallest
doc_id, then digest of the text, then line); every later place is covered, overlapping covers are merged
and the covered lines removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prefspark.functions.binding import bind
from prefspark.llm.common import id_and_text, stored, unused

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _text_key() -> Column:
    """Tells texts of one doc_id, or of none, apart: a digest of the text."""
    return F.unhex(F.md5(F.col("text")))


def line_windows(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end (line numbers of the first and last line), key (128-bit digest).

    Lines are compared without blanks, tabs and carriage returns at their ends;
    blank lines are skipped.  A text of fewer than three such lines has none.
    """
    numbered = F.transform(
        _lines(F.col("text")), lambda line, i: F.struct(i.alias("at"), F.btrim(line, F.lit(" \t\r")).alias("line"))
    )
    full = F.filter(numbered, lambda x: x["line"] != "")
    rest = lambda a, start: F.slice(a, start, F.greatest(F.size(a), F.lit(1)))
    runs = bind(full, lambda a: F.arrays_zip(a, rest(a, 2), rest(a, 3)))
    parts = texts.select("doc_id", _text_key().alias("text_key"), F.inline(runs).alias("a", "b", "c")).where(F.col("c").isNotNull())
    key = F.unhex(F.md5(F.concat_ws("\n", "a.line", "b.line", "c.line")))
    return parts.select("doc_id", "text_key", F.col("a.at").alias("start"), F.col("c.at").alias("end"), key.alias("key"))


def later_windows(windows: DataFrame) -> DataFrame:
    """The windows whose key occurs at an earlier place, over the whole corpus.

    First places are found by an aggregate that combines on the map side.  The
    repeated keys are stored, so that the join back meets two plain shuffles and
    a key that holds much of the rows can be split by adaptive execution.
    """
    place = F.struct("doc_id", "text_key", "start")
    repeated = stored(
        windows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"),
        "repeated-windows",
    )
    return windows.join(repeated, "key").where(place > F.col("first")).select("doc_id", "text_key", "start", "end")


def merged_runs(covers: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a document merged: doc_id, text_key, runs (sorted start/end pairs)."""
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)
    islands = covers.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    runs = islands.groupBy("doc_id", "text_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def without_runs(text: Column, runs: Column) -> Column:
    """The text's lines outside the runs, joined again."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.lit(2**31 - 1)))
    gaps = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    kept = bind(_lines(text), lambda lines: F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["s"] + 1, g["e"] - g["s"]))))
    return F.array_join(kept, "\n")


def removal_runs(texts: DataFrame) -> DataFrame:
    """run_id, run_key, runs: the line intervals that each document loses; documents that lose none are not listed."""
    windows = stored(line_windows(texts), "line-windows")
    return merged_runs(later_windows(windows)).withColumnsRenamed({"doc_id": "run_id", "text_key": "run_key"})


def deduplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (cleaned), n_lines, n_removed.

    Null texts count as empty and stay empty (one line, none removed).  Rows
    with the same doc_id and text are one place in the order, so a repeated row
    removes nothing from itself; other texts of that doc_id, or without one, are
    places of their own in the order of their digests.  Windows overlap, so a line repeated over and over loses what any later window covers.
    """
    texts = id_and_text(df, id_col, text_col)
    runs = removal_runs(texts)
    both = texts.join(runs, texts["doc_id"].eqNullSafe(runs["run_id"]) & (_text_key() == runs["run_key"]), "left")
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"] + 1)
    n_lines = F.size(_lines(F.col("text")))
    return both.select(
        "doc_id",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(without_runs(F.col("text"), F.col("runs"))).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def with_clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with later occurrences of lines taken out of its texts; all rows and columns stay."""
    names = {name: unused(df, name) for name in ("run_id", "run_key", "runs")}
    runs = removal_runs(id_and_text(df, id_col, text_col)).withColumnsRenamed(names)
    run_id, run_key, found = (F.col(name) for name in names.values())
    text = F.col(f"`{text_col}`")
    own = df[id_col].cast("long").eqNullSafe(run_id) & (F.unhex(F.md5(df[text_col])) == run_key)
    both = df.join(runs, own, "left")
    clean = F.when(found.isNull(), text).otherwise(without_runs(text, found))
    return both.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in df.columns])
