"""A new order of the rows in every epoch, computed from the row number.

Sorting by a seeded digest costs a shuffle per epoch.  Here an epoch's order is
a keyed permutation of 0 .. rows - 1: a row's place follows from its number, its
seed and the epoch alone, so after the rows are numbered once no epoch moves or
sorts anything.

The permutation is a balanced network of four rounds over pairs (left, right)
of a grid barely larger than the table.  A number it sends outside the table is
sent on until it is inside, which keeps it a bijection.
"""

from __future__ import annotations

import hashlib
import math
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rand import bits32, digest

ROUNDS = 4


class EpochOrder:
    """The permutation of ``rows`` numbers that belongs to a seed and an epoch."""

    def __init__(self, rows: int, seed: int, epoch: int):
        if rows < 0:
            raise ValueError("rows must not be negative")
        self.rows, self.seed, self.epoch = rows, seed, epoch
        self.height = max(1, math.isqrt(max(rows, 1) - 1) + 1)
        self.width = max(1, -(-rows // self.height))
        self.steps = self._steps()

    def _image(self, number: int) -> int:
        """``image`` for one number, on the driver."""
        sides, sizes = list(divmod(number, self.width)), (self.height, self.width)
        for turn in range(ROUNDS):
            text = f"{self.seed}|{self.epoch}|{turn}|{sides[1 - turn % 2]}"
            sides[turn % 2] = (sides[turn % 2] + int(hashlib.md5(text.encode()).hexdigest()[:8], 16)) % sizes[turn % 2]
        return sides[0] * self.width + sides[1]

    def _steps(self) -> int:
        """The longest way into the table.

        It leads over numbers outside the table, of which there are fewer than
        its square root.
        """
        longest, known = 1, {}
        for number in range(self.rows, self.height * self.width):
            way, at = [], number
            while at >= self.rows and at not in known:
                way.append(at)
                known[at] = 0
                at = self._image(at)
            for steps, passed in zip(count(known.get(at, 0) + 1), reversed(way)):
                known[passed] = steps
            longest = max(longest, 1 + known[number])
        return longest

    def image(self, number: Column) -> Column:
        """Where one pass of the network sends a number of the grid."""
        width, sizes = F.lit(self.width), (self.height, self.width)
        sides = F.struct(F.floor(number / width).cast("bigint").alias("s0"), (number % width).alias("s1"))

        def mixed(sides: Column, turn: Column) -> Column:
            def moved(own: int) -> list[Column]:
                push = bits32(digest(self.seed, self.epoch, turn, sides[f"s{1 - own}"]))
                new = ((sides[f"s{own}"] + push) % sizes[own]).alias(f"s{own}")
                return [new, sides["s1"].alias("s1")] if own == 0 else [sides["s0"].alias("s0"), new]

            return F.when(turn % 2 == 0, F.struct(*moved(0))).otherwise(F.struct(*moved(1)))

        turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(turns, sides, mixed, lambda s: s["s0"] * width + s["s1"])

    def place(self, number: Column) -> Column:
        """Place in the epoch (from 0) of the row with this number (from 0)."""
        walk = F.sequence(F.lit(1), F.lit(self.steps))
        start = F.struct(self.image(number).alias("at"))
        step = lambda s, i: F.struct(F.when((i == 1) | (s["at"] < self.rows), s["at"]).otherwise(self.image(s["at"])).alias("at"))
        return F.aggregate(walk, start, step, lambda s: s["at"])


def epoch_batches(
    numbered: DataFrame, batch_size: int, seed: int, epoch: int, number: str = "row_no", rows: int | None = None, name: str = "batch_id"
) -> DataFrame:
    """Add the batch (from 0) that every row belongs to in an epoch.

    ``number`` counts all rows from 1 without gaps, as ``row_numbers`` does; a row
    without number has no batch.  ``rows`` spares counting them.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    total = numbered.agg(F.max(number)).first()[0] or 0 if rows is None else rows
    place = EpochOrder(total, seed, epoch).place(F.col(number).cast("bigint") - 1)
    return numbered.withColumn(name, F.floor(place / F.lit(batch_size)).cast("bigint"))
