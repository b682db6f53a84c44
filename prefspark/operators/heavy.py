"""Keys that hold too many rows for one task: find, set apart, join.

Adaptive execution splits a skewed join only where both sides come straight
from a shuffle; a side that was just aggregated by the same key does not.
Joins of rows with a summary of their own key therefore spread heavy keys here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shuffle_partitions

# A table of this many 8-byte hashes is broadcast; a larger one is joined.
BROADCAST_ROWS = 500_000


def _salts(spark: SparkSession) -> int:
    """Slices of a heavy key: as many as the shuffle has partitions.

    A heavy key has thousands of rows, so this many copies of its one summary
    row are few beside them, and however large it is all tasks share it.
    """
    return shuffle_partitions(spark)


def _salted(df: DataFrame, spread: str) -> DataFrame:
    """Add the slice of a row, fixed by its ``spread`` column."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_salts(df.sparkSession))).cast("int"))


def _all_salts(per_key: DataFrame) -> DataFrame:
    return per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_salts(per_key.sparkSession) - 1))))


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join that also matches NULL keys, as grouping does.

    Keeps the left keys and all other columns of both sides.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same: Column = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def salted_join(left: DataFrame, per_key: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Rows of heavy keys with their key's one row, each key over many tasks."""
    return join_on(_salted(left, spread), _all_salts(per_key), [*keys, "_salt"]).drop("_salt")


def split_heavy(
    df: DataFrame, keys: list[str], limit: int, spread: str
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys above ``limit`` (None if none).

    Keys are counted by their 64-bit hash, so the count shuffles a few bytes per
    key however long the key is.  A hash collision can only send an ordinary key
    to the heavy side, which handles any size.
    """
    hashed = F.xxhash64(*keys)
    heavy = (
        df.groupBy(hashed.alias("_hash"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select("_hash")
    )
    found = heavy.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return df, None
    tagged = df.withColumn("_hash", hashed)
    if found <= BROADCAST_ROWS:
        heavy, on = F.broadcast(heavy), ["_hash"]
    else:
        tagged, heavy, on = _salted(tagged, spread), _all_salts(heavy), ["_hash", "_salt"]
    return (
        tagged.join(heavy, on, "left_anti").drop(*on),
        tagged.join(heavy, on, "left_semi").drop(*on),
    )


def with_summary(
    df: DataFrame,
    keys: list[str],
    summarize: Callable[[DataFrame], DataFrame],
    spread: str,
    limit: int,
) -> DataFrame:
    """Rows joined with ``summarize(rows)``, which has at most one row per key."""
    ordinary, heavy = split_heavy(df, keys, limit, spread)
    joined = join_on(ordinary, summarize(ordinary), keys)
    if heavy is None:
        return joined
    return joined.unionByName(salted_join(heavy, summarize(heavy), keys, spread))
