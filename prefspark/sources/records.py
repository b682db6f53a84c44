"""JSON-lines hand-over tables; every reader has a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..operators.judging import comparison_records
from ..operators.metrics import metrics_wide


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A directory of JSON-lines part files, written by the tasks."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_generations(records: DataFrame, path: str) -> None:
    write_json(records.select("sample_id", "part", "history", "prompt", "outputs_from", "references_from", "outputs", "references"), path)


def _generation_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` and ``r``: the parsed record, whose ``bad`` holds a line that is none."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), F.from_json("value", schemas.GENERATED_LINE, how).alias("r"))


def _text_list(value: Column) -> Column:
    """A JSON list of texts, or one text, as a list."""
    listed = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(value)))


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """Hand-over records, of this package or with only ``history, prompt, outputs, references``.

    References may be a list or one text.  A record without ``sample_id`` gets
    one from a digest of its texts and a running number among equal ones, so it
    is the same on every read.  Lines that are no record: ``rejected_lines``.
    """
    parsed = _generation_lines(spark, path).where(F.col("r.bad").isNull()).select("r.*")
    whole = parsed.select(
        "sample_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        "history",
        "prompt",
        F.coalesce("outputs_from", F.lit(0).cast("bigint")).alias("outputs_from"),
        F.coalesce("references_from", F.lit(0).cast("bigint")).alias("references_from"),
        F.coalesce("outputs", F.array().cast("array<string>")).alias("outputs"),
        _text_list(F.col("references")).alias("references"),
    )
    texts = F.md5(F.concat_ws("|", "prompt", F.array_join("outputs", "|"), F.array_join("references", "|")))
    bare = whole.where(F.col("sample_id").isNull()).withColumn("_texts", texts)
    again = F.row_number().over(Window.partitionBy("_texts").orderBy("_texts")) - 1
    lead = F.substring(F.md5(F.concat_ws("|", "_texts", again.cast("string"))), 1, 15)
    numbered = bare.withColumn("sample_id", F.conv(lead, 16, 10).cast("bigint")).drop("_texts")
    return whole.where(F.col("sample_id").isNotNull()).unionByName(numbered)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: what ``read_generations`` leaves out because it is no JSON record."""
    return _generation_lines(spark, path).where(F.col("r.bad").isNotNull()).select("line")


def write_comparisons(valid: DataFrame, path: str) -> None:
    write_json(comparison_records(valid), path)


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.COMPARISON)


def write_metrics(log: DataFrame, path: str, metrics: list[str]) -> None:
    """One JSON line per run and step with the given metrics."""
    write_json(metrics_wide(log, metrics), path)


def read_metrics(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    columns = ", ".join(f"`{m}` double" for m in metrics)
    return read_json(spark, path, f"run string, epoch int, batch bigint, {columns}")
