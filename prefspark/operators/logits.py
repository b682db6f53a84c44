"""Token log-probabilities from logits over large vocabularies, in long form.

A row holds one shard of one position's logits: ``seq_id, pos, start, values,
following``, where ``start`` is the vocabulary id of the first value and
``following`` the label of the next position (NULL at a sequence's last one).  A
shard is reduced in its own row to its maximum and to sums of exponentials
relative to it, at two temperatures; only those few numbers are exchanged, and
partial lists are merged on the map side.  Sequences and vocabularies of any
length work: no row, list or window holds more than the shards of one position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.binding import bind
from ..functions.logprob import double_array
from .heavy import with_summary

#: Rows of one sequence from which it is spread over all tasks.
LONG_SEQUENCE = 100_000


def shard_logits(df: DataFrame, size: int, seq_id: str = "seq_id", logits: str = "logits", labels: str = "labels") -> DataFrame:
    """Rows of whole logits (an array per position) as shards of ``size`` values.

    Unequal numbers of positions and labels are an error.
    """
    if size < 1:
        raise ValueError("a shard holds one value at least")
    uneven = F.raise_error(F.concat(F.size(logits).cast("string"), F.lit(" rows of logits, labels: "), F.size(labels).cast("string")))
    steps = F.when(F.size(logits) != F.size(labels), uneven.cast("array<array<double>>")).otherwise(F.col(logits))
    each = df.select(F.col(seq_id).alias("seq_id"), F.col(labels).alias("_labels"), F.posexplode(steps).alias("pos", "_row"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_row") - 1, F.lit(0)), F.lit(size))
    return each.select("seq_id", "pos", F.get("_labels", F.col("pos") + 1).alias("following"), "_row", F.explode(starts).alias("start")).select(
        "seq_id", "pos", "start", F.slice("_row", F.col("start") + 1, F.lit(size)).alias("values"), "following"
    )


def _partial(values: Column, temperatures: list[float]) -> Column:
    """Maximum of a shard, and per temperature its sum of exp((x - maximum) / T)."""

    def sums(x: Column, top: Column) -> Column:
        def relative(temperature: float) -> Column:
            return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / F.lit(temperature)))

        return F.struct(top.alias("top"), *[relative(t).alias(f"s{i}") for i, t in enumerate(temperatures)])

    return bind(double_array(values), lambda x: bind(F.array_max(x), lambda top: sums(x, top)))


def _log_sum(parts: Column, field: str, temperature: float) -> Column:
    """ln of the sum over all shards of exp(x / T)."""

    def over(top: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p[field] * F.exp((p["top"] - top) / F.lit(temperature)))
        return top / F.lit(temperature) + F.ln(total)

    return bind(F.array_max(F.transform(parts, lambda p: p["top"])), over)


def sharded_logps(
    shards: DataFrame,
    temperature: float = 1.0,
    end_id: int | None = None,
    end_temperature: float = 1.0,
) -> DataFrame:
    """``seq_id, pos, logp, end_logp, counted`` for every position that has a next one.

    ``logp`` is the log-probability of the next label at ``temperature``; an
    ignored label reads id 0 and is not ``counted``.  ``end_logp`` is that of
    ``end_id`` at ``end_temperature``, from the same pass (NULL without an id).
    A label or end id that no shard holds, and a value held twice, are errors.
    """
    temperature, end_temperature = float(temperature), float(end_temperature)
    if temperature <= 0 or end_temperature <= 0:
        raise ValueError("temperatures must be positive")
    ignored = F.col("following") == fixed.IGNORE_LABEL
    label = F.when(ignored, F.lit(0)).otherwise(F.col("following"))

    def held(index: Column) -> Column:
        at = index - F.col("start")
        return F.when((at >= 0) & (at < F.size("values")), F.get("values", at.cast("int"))).cast("double")

    end = held(F.lit(end_id)) if end_id is not None else F.lit(None).cast("double")
    reduced = shards.where(F.col("following").isNotNull() & (F.size("values") > 0)).select(
        "seq_id",
        "pos",
        (~ignored).alias("counted"),
        _partial(F.col("values"), [temperature, end_temperature]).alias("part"),
        held(label).alias("at_label"),
        end.alias("at_end"),
    )
    merged = reduced.groupBy("seq_id", "pos").agg(
        F.first("counted").alias("counted"),
        F.collect_list("part").alias("parts"),
        F.count("at_label").alias("_labels"),
        F.max("at_label").alias("at_label"),
        F.count("at_end").alias("_ends"),
        F.max("at_end").alias("at_end"),
    )

    def once(value: Column, times: Column, what: str) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"{what} found "), times.cast("string"), F.lit(" times at a position")))
        return F.when(times != 1, wrong.cast("double")).otherwise(value)

    logp = once(F.col("at_label"), F.col("_labels"), "the label is") / F.lit(temperature) - _log_sum(F.col("parts"), "s0", temperature)
    end_logp = F.lit(None).cast("double")
    if end_id is not None:
        end_logp = once(F.col("at_end"), F.col("_ends"), "the end id is") / F.lit(end_temperature) - _log_sum(F.col("parts"), "s1", end_temperature)
    return merged.select("seq_id", "pos", logp.alias("logp"), end_logp.alias("end_logp"), "counted")


def slide_counted(positions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Also count the position just before a sequence's first counted one.

    The first counted position is an aggregate with partial minima, joined back
    with long sequences spread over all tasks; there is no window per sequence.
    """
    keys = keys or ["seq_id"]

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min(F.when(F.col("counted"), F.col("pos"))).alias("_first"))

    found = with_summary(positions, keys, first, "pos", LONG_SEQUENCE)
    before = F.coalesce(F.col("pos") == F.col("_first") - 1, F.lit(False))
    return found.withColumn("counted", F.col("counted") | before).drop("_first")


def flow_sequences(policy: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Long scores of two models as the array rows that ``flow_scores`` takes.

    ``policy`` and ``reference`` hold the keys (such as ``pair_id, side``), ``pos,
    logp, end_logp``; the policy's ``counted`` is the mask.  Positions are put in
    order; a position that one model lacks is an error.
    """
    left = policy.select(*keys, "pos", "counted", F.lit(1).alias("_p"), F.col("logp").alias("_pi"), F.col("end_logp").alias("_pe"))
    right = reference.select(*keys, "pos", F.col("logp").alias("_rho"), F.col("end_logp").alias("_re"), F.lit(1).alias("_r"))
    both = left.join(right, [*keys, "pos"], "full")
    whole = F.when(
        F.col("_p").isNull() | F.col("_r").isNull(),
        F.raise_error(F.concat(F.lit("position of one model only: "), F.col("pos").cast("string"))).cast("int"),
    ).otherwise(F.col("pos").cast("int"))
    steps = both.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(whole.alias("pos"), "counted", "_pi", "_pe", "_rho", "_re"))).alias("_steps"))

    def column(field: str) -> Column:
        return F.transform("_steps", lambda s: s[field])

    return steps.select(
        *keys,
        column("_pi").alias("policy_logp"),
        column("_rho").alias("ref_logp"),
        column("_pe").alias("policy_eos_logp"),
        column("_re").alias("ref_eos_logp_gamma"),
        column("counted").alias("mask"),
    )
