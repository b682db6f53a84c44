"""Structured Streaming: evaluation statistics and windowed training metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.diversity import row_diversity
from ..session import discard, scratch_path


def read_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int | None = None, **options
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_eval_stats(stream: DataFrame) -> DataFrame:
    """Running mean and standard error of diversity per run.

    Diversity is an expression on the record, so the only state is one row of
    counters per run; no watermark is needed to bound it.
    """
    scored = row_diversity(stream, "vectors")
    return scored.groupBy("run").agg(
        F.count("diversity").alias("n"),
        F.avg("diversity").alias("mean"),
        (F.stddev_samp("diversity") / F.sqrt(F.count("diversity"))).alias("std_err"),
    )


def stream_win_stats(stream: DataFrame, slots: int, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Running win statistics over the ``slots`` of valid comparisons, per run.

    ``run, sample_id, wins`` come in; ``run, n, mean, std_err, min, max`` are over
    the slots' win rates of the samples so far.  The state of a run is one row of
    a counter per slot.  With a watermark on the column ``time``, a sample that is
    there again counts once, and a row later than the watermark does not count;
    the state then also holds the samples within the watermark.  Comparisons with
    another number of slots, or an open one, are not valid and do not count.
    """
    if slots < 1:
        raise ValueError("slots must be positive")
    rows = stream.where((F.size("wins") == slots) & ~F.exists("wins", lambda w: w.isNull()))
    if watermark is not None:
        rows = rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["run", "sample_id"])
    won = [F.sum(F.get("wins", F.lit(i)).cast("bigint")).alias(f"won_{i}") for i in range(slots)]
    counted = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *won)
    rates = counted.select("run", "n", F.array(*[F.col(f"won_{i}") / F.col("n") for i in range(slots)]).alias("rates"))
    mean = F.aggregate("rates", F.lit(0.0), lambda s, r: s + r) / slots
    spread = F.aggregate("rates", F.lit(0.0), lambda s, r: s + (r - F.col("mean")) * (r - F.col("mean")))
    return rates.withColumn("mean", mean).select(
        "run",
        "n",
        "mean",
        (F.sqrt(spread / slots) / F.sqrt(F.lit(slots))).alias("std_err"),
        F.array_min("rates").alias("min"),
        F.array_max("rates").alias("max"),
    )


def stream_train_metrics(
    stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes"
) -> DataFrame:
    """Metric means per run, split and tumbling window; rows later than the watermark drop out."""
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy("run", "split", F.window("ts", window).alias("w"), "metric")
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
        .select("run", "split", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "metric", "value", "n")
    )


def latest(
    spark: SparkSession,
    result: DataFrame,
    keys: list[str],
    name: str,
    path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Run a streaming aggregate over all available input; the last row of every key.

    The query runs in update mode, so a window is there as soon as it has a row,
    the last one too.  A micro-batch writes the rows it changed into a folder of
    its own, overwriting what a failed attempt left.  Before a run, the folders
    of earlier runs are merged into one, so there are never more than the
    micro-batches of a run.  A later run with the same ``path`` and
    ``checkpoint`` goes on where the last one stopped; without input the result
    is empty.
    """
    out = path or scratch_path(spark, name)
    place = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    schema = f"{_ddl(result)}, batch bigint"
    spark.createDataFrame([], schema).drop("batch").write.mode("overwrite").parquet(f"{out}/batch=-1")
    stored = spark.read.schema(schema).parquet(out)
    values = [c for c in result.columns if c not in keys]

    def last_rows() -> DataFrame:
        newest = F.max_by(F.struct(*values), "batch").alias("v")
        return spark.read.schema(schema).parquet(out).groupBy(*keys).agg(newest).select(*keys, "v.*").select(*result.columns)

    upto = stored.agg(F.max("batch")).first()[0]
    if upto is not None:
        merged = scratch_path(spark, f"{name}-merged")
        last_rows().write.parquet(merged)
        spark.read.schema(_ddl(result)).parquet(merged).write.mode("overwrite").parquet(f"{out}/batch={upto}")
        for row in stored.where(F.col("batch") < upto).select("batch").distinct().collect():
            discard(spark, f"{out}/batch={row['batch']}")
        discard(spark, merged)

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = result.writeStream.outputMode("update").option("checkpointLocation", place).foreachBatch(save)
    writer.trigger(availableNow=True).start().awaitTermination()
    return last_rows()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
