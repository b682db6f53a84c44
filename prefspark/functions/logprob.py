"""Token log-probabilities and the scalar functions of the losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from . import fixed
from .binding import bind


def double_array(col: Column) -> Column:
    return col.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(double_array(values), F.lit(0.0), lambda acc, x: acc + x)


def masked(values: Column, mask: Column) -> Column:
    return F.zip_with(double_array(values), mask, lambda x, m: F.when(m, x).otherwise(F.lit(0.0)))


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m))


def first_true(mask: Column) -> Column:
    """1-based position of the first true, 0 if there is none."""
    return F.array_position(mask, True)


def last_true(mask: Column) -> Column:
    """1-based position of the last true, 0 if there is none."""
    found = F.array_position(F.reverse(mask), True)
    return F.when(found == 0, F.lit(0)).otherwise(F.size(mask) - found + 1)


def slide_mask(mask: Column) -> Column:
    """Also select the position just before the first selected one."""
    at = first_true(mask)
    slid = F.concat(
        F.slice(mask, F.lit(1), F.greatest(at - 2, F.lit(0))),
        F.array(F.lit(True)),
        F.slice(mask, F.greatest(at, F.lit(1)), F.size(mask)),
    )
    return F.when(at >= 2, slid).otherwise(mask)


def log_softmax_at(logits: Column, index: Column, temperature: float = 1.0) -> Column:
    """log softmax(logits / T)[index] of one position, index 0-based."""

    def with_top(scaled: Column, top: Column) -> Column:
        spread = F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.get(scaled, index) - (top + F.ln(spread))

    return bind(
        F.transform(double_array(logits), lambda x: x / F.lit(float(temperature))),
        lambda scaled: bind(F.array_max(scaled), lambda top: with_top(scaled, top)),
    )


def label_mask(labels: Column) -> Column:
    """Selected positions after the shift by one."""
    return F.transform(
        F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))),
        lambda y: y != fixed.IGNORE_LABEL,
    )


def logits_to_logps(logits: Column, labels: Column, temperature: float = 1.0) -> Column:
    """Log-probability of every next label; ignored labels read id 0.

    Unequal lengths of logits and labels, and labels outside the vocabulary, are errors.
    """
    steps = F.greatest(F.size(labels) - 1, F.lit(0))
    following = F.transform(
        F.slice(labels, F.lit(2), steps),
        lambda y: F.when(y == fixed.IGNORE_LABEL, F.lit(0)).otherwise(y),
    )

    def score(row: Column, y: Column) -> Column:
        outside = F.raise_error(F.concat(F.lit("label outside the vocabulary: "), y.cast("string")))
        return F.when((y < 0) | (y >= F.size(row)), outside.cast("double")).otherwise(
            log_softmax_at(row, y, temperature)
        )

    uneven = F.raise_error(
        F.concat(F.size(logits).cast("string"), F.lit(" rows of logits, labels: "), F.size(labels).cast("string"))
    )
    scores = F.zip_with(F.slice(logits, F.lit(1), steps), following, score)
    return F.when(F.size(logits) != F.size(labels), uneven.cast("array<double>")).otherwise(scores)


def log_sigmoid(x: Column) -> Column:
    """Exact for large |x|, where log(1/(1+exp(-x))) is not."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


#: Terms of the series and of the continued fraction, and where one gives way to the other.
_TERMS, _TAIL = 90, 3.0
_LOG_ROOT_2PI = 0.5 * math.log(2.0 * math.pi)


def neg_log_normal_cdf(z: Column) -> Column:
    """-ln Phi(z), +inf where Phi underflows.

    With phi the density and a = |z|: near 0, Phi(a) = 1/2 + phi(a) times the sum of
    a^(2k+1) / (1 3 5 ... (2k+1)); further out, Phi(-a) = phi(a) / (a + 1/(a + 2/(a + ...))).
    """

    def lower_tail(a: Column) -> Column:
        """-ln Phi(-a) for a >= 0."""
        log_density = a * a / F.lit(2.0) + F.lit(_LOG_ROOT_2PI)
        start = F.struct(F.lit(0.0).alias("s"), a.alias("t"))
        series = F.aggregate(
            F.sequence(F.lit(1), F.lit(_TERMS)),
            start,
            lambda acc, k: F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * a * a / (2 * k + 1)).alias("t")),
            lambda acc: acc["s"],
        )
        near = -F.ln(F.lit(0.5) - F.exp(-log_density) * series)
        fraction = F.aggregate(
            F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc
        )
        return F.when(a < _TAIL, near).otherwise(log_density + F.ln(fraction))

    below = bind(F.abs(z), lower_tail)
    # Half of the least positive double: what Phi itself could not hold.
    lost = F.when(below > F.lit(-math.log(5e-324) + math.log(2.0)), F.lit(math.inf)).otherwise(below)
    return F.when(z <= 0, lost).otherwise(-F.log1p(-F.exp(-below)))
