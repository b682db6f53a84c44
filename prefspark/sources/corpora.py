"""Preference corpora on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import fixed


def split_name(task: str, train: bool, prompt_only: bool = False) -> str:
    if task not in fixed.SPLITS:
        raise ValueError(f"unknown task {task!r}")
    train_split, pair_split, prompt_split = fixed.SPLITS[task]
    return train_split if train else (prompt_split if prompt_only else pair_split)


def load_preferences(
    spark: SparkSession, path: str, task: str, split: str, fmt: str = "parquet"
) -> DataFrame:
    """Raw rows of one split; a table partitioned by ``split`` reads only that one."""
    schema = {"hh": schemas.HH_RAW, "tldr": schemas.TLDR_RAW}.get(task)
    if schema is None:
        raise ValueError(f"unknown task {task!r}")
    return spark.read.schema(schema).format(fmt).load(path).where(F.col("split") == split)


def scan_columns(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Parquet scan of the given columns only."""
    return spark.read.schema(schema).parquet(path).select(*columns)


def dataset_len(df: DataFrame) -> int:
    return df.count()


def write_by_key(df: DataFrame, path: str, key: str, row_group_bytes: int = 8 << 20) -> None:
    """A corpus laid out for look-ups: sorted by key over all files, in small row groups.

    Footers and page indexes then tell which pages can hold an id, and a Bloom
    filter of the key tells it of ids that lie between others.
    """
    options = {
        "parquet.block.size": str(row_group_bytes),
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.bloom.filter.adaptive.enabled#{key}": "true",
    }
    df.repartitionByRange(key).sortWithinPartitions(key).write.options(**options).parquet(path)


def get_rows(df: DataFrame, key: str, ids: list[int] | DataFrame) -> DataFrame:
    """Rows by id: a filter for a short list, a semi join for a table of ids.

    Over a corpus of ``write_by_key`` the filter reads only the pages that can
    hold an id.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids, key, "left_semi")
    wanted: Column = F.col(key).isin(list(ids))
    return df.where(wanted)
