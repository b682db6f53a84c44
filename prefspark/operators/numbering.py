"""Global order on a distributed table: row numbers, batches, running sums.

A window without partition keys would move the whole table into one task.
Here rows are cut into many consecutive *cells* of the order key; a window
works inside a cell, and each cell adds an offset taken from the cells before
it.  The offset table has one row per cell, so its size is fixed by the plan
and not by the data, which is why it alone is broadcast.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rand import digest
from ..session import shuffle_partitions
from .heavy import join_on

# Cells per shuffle partition: several, so that hashing cells to partitions
# leaves no partition with much more than its share.
CELLS_PER_PARTITION = 8


def _wanted_cells(df: DataFrame) -> int:
    return CELLS_PER_PARTITION * shuffle_partitions(df.sparkSession)


def _cuts(df: DataFrame, key: str) -> list[float]:
    """Equal-depth cuts of ``key``, one per cell.

    They come from a quantile sketch of the key column alone (a job that reads
    only that column), so clustered or outlying keys cannot pile up in one cell,
    however many cells the shuffle width asks for.
    """
    wanted = _wanted_cells(df)
    probabilities = [i / wanted for i in range(wanted + 1)]
    marks = df.select(F.col(key).cast("double").alias("k")).approxQuantile(
        "k", probabilities, 1 / (2 * wanted)
    )
    return sorted(set(marks or [0.0]))


def _cells_between(df: DataFrame, key: str, marks: list[float]) -> DataFrame:
    keyed = df.withColumn("_key", F.col(key).cast("double"))
    if len(marks) > 2:
        splits = [-math.inf, *marks[1:-1], math.inf]
        bucketed = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(keyed)
    else:
        bucketed = keyed.withColumn("_bucket", F.lit(0))
    return bucketed.withColumn("_cell", F.col("_bucket").cast("int")).drop("_key", "_bucket")


def cells_by_value(df: DataFrame, key: str) -> DataFrame:
    """Add ``_cell``, non-decreasing in the numeric ``key``, by equal-depth cuts."""
    return _cells_between(df, key, _cuts(df, key))


def cells_by_digest(df: DataFrame, hex_key: str) -> DataFrame:
    """Add ``_cell`` for an md5 key: its leading bits are already uniform."""
    wanted = min(_wanted_cells(df), 65536)
    lead = F.conv(F.substring(F.col(hex_key), 1, 4), 16, 10).cast("bigint")
    return df.withColumn("_cell", F.floor(lead * wanted / 65536).cast("int"))


def _offsets(cells: DataFrame, sums: dict[str, Column], group: list[str]) -> DataFrame:
    """Per cell, the totals of all earlier cells (of the same group)."""
    totals = cells.groupBy(*group, "_cell").agg(*[c.alias(f"_t_{n}") for n, c in sums.items()])
    before = (
        Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *group,
        "_cell",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )


def _with_offsets(celled: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    if not group:
        # One row per cell: bounded by cells_by_*, whatever the table's size.
        return celled.join(F.broadcast(offsets), "_cell")
    return join_on(celled, offsets, [*group, "_cell"])


def _number(
    celled: DataFrame, order: list[str], group: list[str], name: str, counted: DataFrame | None = None
) -> DataFrame:
    counted = celled if counted is None else counted
    offsets = _offsets(counted.select(*group, "_cell"), {"n": F.count(F.lit(1))}, group)
    inside = Window.partitionBy(*group, "_cell").orderBy(*order)
    return (
        _with_offsets(celled, offsets, group)
        .withColumn(name, F.col("_o_n") + F.row_number().over(inside))
        .drop("_cell", "_o_n")
    )


def row_numbers(
    df: DataFrame, key: str, group: list[str] | None = None, name: str = "row_no"
) -> DataFrame:
    """1-based position of every row by the unique numeric ``key`` (per group)."""
    return _number(cells_by_value(df, key), [key], group or [], name)


def row_numbers_by(df: DataFrame, key: str, keys: DataFrame, name: str = "row_no") -> DataFrame:
    """``row_numbers`` of rows that are dear to compute, whose keys are stored.

    ``keys`` holds the ``key`` of every row, as often as it occurs; cells are cut
    and counted on it, so the rows themselves are computed once.
    """
    marks = _cuts(keys, key)
    return _number(_cells_between(df, key, marks), [key], [], name, _cells_between(keys, key, marks))


def shuffled_numbers(df: DataFrame, key: str, seed, name: str = "row_no") -> DataFrame:
    """1-based position of every row in a seeded random order of ``key``."""
    keyed = df.withColumn("_h", digest(seed, F.col(key)))
    return _number(cells_by_digest(keyed, "_h"), ["_h", key], [], name).drop("_h")


def running_sums(
    df: DataFrame, key: str, sums: dict[str, Column], group: list[str] | None = None
) -> DataFrame:
    """Sums over all rows up to and including this one, by ``key`` (per group)."""
    group = group or []
    celled = cells_by_value(
        df.withColumns({f"_x_{n}": c for n, c in sums.items()}), key
    )
    offsets = _offsets(celled, {n: F.sum(f"_x_{n}") for n in sums}, group)
    inside = (
        Window.partitionBy(*group, "_cell")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = _with_offsets(celled, offsets, group)
    added = {n: F.col(f"_o_{n}") + F.sum(f"_x_{n}").over(inside) for n in sums}
    helpers = [f"_x_{n}" for n in sums] + [f"_o_{n}" for n in sums]
    return out.withColumns(added).drop("_cell", *helpers)


def running_stats(df: DataFrame, value: str, key: str) -> DataFrame:
    """Mean and standard error of ``value`` as rows arrive in ``key`` order.

    Sums are taken of the distance to the mean of all rows, so a large common
    offset costs no digits.  NULL values are not counted.
    """
    x = F.col(value).cast("double")
    centre = F.coalesce(df.select(F.avg(x)).scalar(), F.lit(0.0))
    known, d = x.isNotNull().cast("bigint"), x - centre
    summed = running_sums(df, key, {"seen": known, "sum_d": F.coalesce(d, F.lit(0.0)), "sum_dd": F.coalesce(d * d, F.lit(0.0))})
    n, s, q = F.col("seen"), F.col("sum_d"), F.col("sum_dd")
    spread = F.greatest(q - F.try_divide(s * s, n), F.lit(0.0))
    return summed.withColumns(
        {
            "running_mean": centre + F.try_divide(s, n),
            "running_std_err": F.try_divide(F.sqrt(F.try_divide(spread, n - 1)), F.sqrt(n)),
        }
    ).drop("sum_d", "sum_dd")


def first_rows(df: DataFrame, key: str, how_many: Column) -> DataFrame:
    """The first ``how_many`` rows by the unique numeric ``key``.

    Cell counts tell which one cell holds the cut; only that cell's keys are
    numbered.  The cut-off key then filters the table in its scan, so neither
    the rows nor the other keys are shuffled.
    """
    celled = cells_by_value(df.select(key), key)
    totals = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = totals.withColumn("_end", F.sum("_n").over(upto))
    # At most one row: the cell in which the cut lies.
    holder = ends.where(
        (F.col("_end") >= how_many) & (F.col("_end") - F.col("_n") < how_many)
    ).select("_cell", (F.col("_end") - F.col("_n")).alias("_before"))
    inside = celled.join(F.broadcast(holder), "_cell")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(key))
    cut = (
        inside.withColumn("_place", F.col("_before") + place)
        .where(F.col("_place") <= how_many)
        .agg(F.max(key))
        .scalar()
    )
    return df.where(F.col(key) <= cut)


def take_proportion(df: DataFrame, proportion: float, key: str) -> DataFrame:
    """First ``int(proportion * 100)`` percent of the rows; all from 1.0 on."""
    if proportion >= 1.0:
        return df
    percent = int(proportion * 100)
    rows = df.select(key).agg(F.count(F.lit(1))).scalar()
    return first_rows(df, key, F.bround(rows * F.lit(float(percent)) / 100.0, 0))


class ShuffledOrder:
    """A seeded random order of the rows of a unique key, to be read from its start.

    Rows are counted once by the leading 16 bits of their digest, so finding the
    row at any place sorts the keys of one cell only, and the rows before it are
    a filter: neither rows nor keys are shuffled.  Rows without key have no place.
    """

    def __init__(self, df: DataFrame, key: str, seed):
        self._keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
        self.key, self.seed = key, seed
        cells = self._keys.groupBy(F.substring(digest(seed, F.col("key")), 1, 4).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        # At most 65,536 rows, whatever the table's size.
        self._cells = sorted((row.cell, row.n) for row in cells.collect())
        self.rows = sum(n for _, n in self._cells)

    def place(self, how_many: int) -> tuple | None:
        """Digest and key of the ``how_many``-th row; None before the first."""
        left = min(how_many, self.rows)
        if left < 1:
            return None
        for cell, n in self._cells:
            if left <= n:
                break
            left -= n
        keyed = self._keys.select(digest(self.seed, F.col("key")).alias("h"), "key")
        inside = keyed.where(F.substring("h", 1, 4) == cell).orderBy("h", "key").limit(left)
        return tuple(inside.agg(F.max(F.struct("h", "key")).alias("last")).first()["last"])

    def upto(self, place: tuple | None) -> Column:
        """Whether a row comes no later than the place."""
        if place is None:
            return F.lit(False)
        h, known = digest(self.seed, F.col(self.key)), F.col(self.key).isNotNull()
        return known & ((h < place[0]) | ((h == place[0]) & (F.col(self.key) <= F.lit(place[1]))))


def first_shuffled(df: DataFrame, key: str, seed, how_many: int) -> DataFrame:
    """The first ``how_many`` rows of a seeded random order (a sampling operator).

    The rows come unordered, and unshuffled: see ``ShuffledOrder``.
    """
    order = ShuffledOrder(df, key, seed)
    return df.where(order.upto(order.place(how_many)))


def assign_batches(
    df: DataFrame, batch_size: int, key: str, seed=None, name: str = "batch_id", keys: DataFrame | None = None
) -> DataFrame:
    """Consecutive batches of ``batch_size`` in key order, or shuffled by seed.

    ``keys``: for key order, the stored keys of ``df`` (``row_numbers_by``).
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if seed is not None:
        numbered = shuffled_numbers(df, key, seed)
    else:
        numbered = row_numbers(df, key) if keys is None else row_numbers_by(df, key, keys)
    return numbered.withColumn(
        name, F.floor((F.col("row_no") - 1) / F.lit(batch_size)).cast("bigint")
    ).drop("row_no")
