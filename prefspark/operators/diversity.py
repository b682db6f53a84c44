"""Output diversity: 1 - mean cosine over the pairs of a sample's outputs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors
from ..functions.binding import bind


def diversity(df: DataFrame, sample: str, vector: str) -> DataFrame:
    """``sample, n_outputs, diversity`` from one row per output.

    The mean cosine over all pairs follows from |sum u|^2 and sum |u|^2 of the
    unit vectors u, so no pairs are formed: one aggregate with map-side partial
    sums, linear in the rows, and a sample of any size costs its shuffle peers
    one partial row per task.  Below two outputs the result is NULL.

    A NULL vector is no output: it is skipped, and a sample that has nothing
    else is not returned.  Vectors of different widths in a sample are an error.
    """
    v = F.col(vector).cast("array<double>")
    rows = (
        df.where(F.col(vector).isNotNull())
        .select(sample, v.alias("_v"))
        .withColumn("_square", vectors.squared(F.col("_v")))
        .withColumn("_norm", vectors.floored_norm(F.col("_square")))
    )
    own = F.col("_square") / (F.col("_norm") * F.col("_norm"))
    unit = bind(F.col("_norm"), lambda norm: F.transform("_v", lambda x: x / norm))
    sums = rows.withColumn("_u", unit).groupBy(sample).agg(
        F.count("_v").alias("n_outputs"),
        F.sum(own).alias("_own"),
        vector_to_array(Summarizer.sum(array_to_vector("_u"))).alias("_sum"),
    )
    squared = vectors.squared(F.col("_sum"))
    return sums.select(
        sample,
        "n_outputs",
        vectors.diversity_from_sums(F.col("n_outputs"), squared, F.col("_own")).alias("diversity"),
    )


def row_diversity(df: DataFrame, vectors_column: str) -> DataFrame:
    """Diversity where a row already holds all vectors of its sample."""
    return df.withColumn(
        "diversity", vectors.diversity_of_rows(F.col(vectors_column).cast("array<array<double>>"))
    )


def mean_std_err(df: DataFrame, value: str, ddof: int = 1) -> DataFrame:
    """One row: count, mean and standard error (sample std for ddof=1)."""
    spread = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    return df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (spread / F.sqrt(F.count(value))).alias("std_err"),
    )
