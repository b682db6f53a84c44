"""Training and evaluation metrics in long form.

Input rows: ``run, epoch, batch, rank, split, metric, value, n_examples, ts``.
Every aggregate has map-side partial results, so one run or metric may hold
any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .numbering import running_sums

_BATCH = ["run", "split", "epoch", "batch", "metric"]


def metric_key(split: Column, metric: Column) -> Column:
    return F.concat(split, F.lit("/"), metric)


def reduce_ranks(log: DataFrame, op: str = "sum") -> DataFrame:
    """Combine the processes' values of one batch; summing is the default."""
    if op not in ("sum", "avg"):
        raise ValueError("op must be 'sum' or 'avg'")
    combine = F.sum if op == "sum" else F.avg
    return log.groupBy(*_BATCH).agg(combine("value").alias("value"))


def eval_mean(log: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean of batch means per metric (or the mean of all rows)."""
    keys = ["run", "split", "metric"]
    if weighted:
        return log.groupBy(*keys).agg(F.avg("value").alias("value"))
    batches = log.groupBy(*_BATCH).agg(F.avg("value").alias("value"))
    return batches.groupBy(*keys).agg(F.avg("value").alias("value"))


def interval_means(log: DataFrame, log_every: int = 1, op: str = "sum") -> DataFrame:
    """Metric means since the last log line.

    Batch 0 logs alone and then every ``log_every``-th batch closes an interval.
    Collected values are dropped at the end of an epoch, so an interval that
    its epoch does not close is never logged.
    """
    if log_every < 1:
        raise ValueError("log_every must be positive")
    batches = reduce_ranks(log, op).withColumn(
        "interval", F.ceil(F.col("batch") / F.lit(log_every)).cast("bigint")
    )
    return (
        batches.groupBy("run", "split", "epoch", "interval", "metric")
        .agg(
            F.avg("value").alias("value"),
            F.count(F.lit(1)).alias("n_batches"),
            F.max("batch").alias("last_batch"),
        )
        .where(F.col("last_batch") == F.col("interval") * log_every)
        .select(
            "run",
            "epoch",
            F.col("last_batch").alias("batch"),
            metric_key(F.col("split"), F.col("metric")).alias("metric"),
            "value",
            "n_batches",
        )
    )


def count_examples(log: DataFrame) -> DataFrame:
    """Examples per batch: each process counts its share once."""
    shares = log.groupBy("run", "epoch", "batch", "rank").agg(F.max("n_examples").alias("n"))
    return shares.groupBy("run", "epoch", "batch").agg(F.sum("n").alias("n_examples"))


def examples_seen(log: DataFrame) -> DataFrame:
    """Running counters when a batch is logged, before the batch itself counts."""
    batches = count_examples(log)
    summed = running_sums(
        batches, "batch", {"_examples": F.col("n_examples"), "_batches": F.lit(1)}, ["run"]
    )
    return summed.select(
        "run",
        "epoch",
        "batch",
        "n_examples",
        (F.col("_examples") - F.col("n_examples")).alias("examples_seen"),
        (F.col("_batches") - 1).alias("batches_seen"),
        F.col("_batches").alias("update_steps"),
    )


def throughput(log: DataFrame) -> DataFrame:
    """Examples per second of every batch, from its first and last time stamp.

    A batch with one time stamp is measured from the end of the batch before it
    in its run; NULL only where there is none, or no time passed.  Batches are
    numbered in a run without gaps, so the batch before is found by its number.
    """
    spans = log.groupBy("run", "epoch", "batch").agg(
        F.min(F.col("ts").cast("timestamp")).alias("_start"),
        F.max(F.col("ts").cast("timestamp")).alias("_end"),
    )
    ended = spans.groupBy("run", (F.col("batch") + 1).alias("batch")).agg(F.max("_end").alias("_before"))
    start = F.when(F.col("_start") < F.col("_end"), F.col("_start")).otherwise(F.col("_before"))
    seconds = (F.unix_micros("_end") - F.unix_micros(start)) / F.lit(1e6)
    return (
        count_examples(log)
        .join(spans, ["run", "epoch", "batch"])
        .join(ended, ["run", "batch"], "left")
        .select(
            "run",
            "epoch",
            "batch",
            "n_examples",
            F.try_divide(F.col("n_examples"), F.when(seconds > 0, seconds)).alias("examples_per_sec"),
        )
    )


def metrics_wide(log: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run, epoch and batch (the step it was logged at) with the known metrics as columns."""
    return log.groupBy("run", "epoch", "batch").pivot("metric", metrics).agg(F.avg("value"))
