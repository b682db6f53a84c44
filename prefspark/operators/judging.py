"""Judged win rate: requests to a judge, its verdicts, and their summary."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import judging, rand
from ..session import materialize
from .numbering import ShuffledOrder, first_shuffled, running_sums, shuffled_numbers


def _tagged(seed, what: str, *parts) -> Column:
    return rand.digest(seed, what, *parts)


def judge_requests(
    records: DataFrame, task: str = "hh", mode: str | None = None, n: int = 1, seed: int = 0
) -> DataFrame:
    """One question per sample and slot: a generated answer against a reference.

    Per sample one reference and ``n`` outputs are drawn by seeded digest of
    their place in the sample's whole lists, so how records cut the lists changes
    no draw; each answer's A/B position is drawn on its own.  Every record first keeps
    only its own best draws, inside the row; the exchange then sees at most
    ``n`` outputs and one reference per record.  Samples without a reference
    give no request.
    """
    sid = F.col("sample_id")

    def draw(column: str, what: str) -> Column:
        start = F.col(f"{column}_from") if f"{column}_from" in records.columns else F.lit(0)
        return F.transform(
            column,
            lambda x, i: F.struct(
                _tagged(seed, what, sid, F.coalesce(start, F.lit(0)) + i).alias("h"), x.alias("text")
            ),
        )

    first_part = F.col("part") == 0 if "part" in records.columns else F.lit(True)
    drawn = records.select(
        sid,
        F.when(first_part, F.col("history")).alias("history"),
        F.slice(F.array_sort(draw("outputs", "out")), 1, n).alias("outs"),
        F.array_min(draw("references", "ref")).alias("ref"),
    )
    heads = drawn.groupBy("sample_id").agg(
        F.first("history", ignorenulls=True).alias("history"), F.min("ref").alias("ref")
    ).where(F.col("ref").isNotNull())
    best = Window.partitionBy("sample_id").orderBy("out.h")
    slots = (
        drawn.select("sample_id", F.explode("outs").alias("out"))
        .withColumn("slot", F.row_number().over(best))
        .where(F.col("slot") <= n)
    )
    asked = slots.join(heads, "sample_id").select(
        "sample_id",
        "slot",
        F.concat_ws("|", "sample_id", "slot").alias("request_id"),
        (rand.bits32(_tagged(seed, "ab", sid, F.col("slot"))) % 2 == 0).alias("response_is_a"),
        "history",
        F.col("out.text").alias("response"),
        F.col("ref.text").alias("reference_response"),
    )
    a, b = F.col("response_is_a"), ~F.col("response_is_a")
    return asked.withColumn(
        "judge_prompt",
        judging.judge_prompt(
            F.col("history"),
            F.when(a, F.col("response")).otherwise(F.col("reference_response")),
            F.when(b, F.col("response")).otherwise(F.col("reference_response")),
            task,
            mode,
        ),
    )


def votes(requests: DataFrame, completions: DataFrame, task: str) -> DataFrame:
    """Requests with their completion's verdict letter and vote.

    A request that was answered more than once keeps its least completion, so a
    repeated hand-over changes nothing.
    """
    once = completions.groupBy("request_id").agg(F.min("completion").alias("completion"))
    joined = requests.join(once, "request_id", "left")
    letter = F.coalesce(judging.verdict(F.col("completion"), task), F.lit(""))
    return joined.withColumn("verdict", letter).withColumn(
        "win", judging.vote(F.col("verdict"), F.col("response_is_a"))
    )


def verdicts(requests: DataFrame, completions: DataFrame, task: str, n: int = 1) -> DataFrame:
    """Valid comparisons: samples whose ``n`` completions all gave a vote.

    ``sample_id, reference_response, history, wins`` with ``wins`` in slot
    order.  A sample has at most ``n`` requests, so its list is bounded.
    """
    judged = votes(requests, completions, task)
    wins = F.sort_array(F.collect_list(F.struct("slot", "win")))
    return (
        judged.groupBy("sample_id")
        .agg(
            F.count("win").alias("_valid"),
            F.count(F.lit(1)).alias("_asked"),
            wins.alias("_wins"),
            F.first("history").alias("history"),
            F.first("reference_response").alias("reference_response"),
        )
        .where((F.col("_valid") == n) & (F.col("_asked") == n))
        .select(
            "sample_id",
            "history",
            "reference_response",
            F.transform("_wins", lambda w: w["win"]).alias("wins"),
        )
    )


def sample_comparisons(valid: DataFrame, samples: int = 300, seed: int = 0) -> DataFrame:
    """The first ``samples`` valid comparisons in seeded random order."""
    return first_shuffled(valid, "sample_id", seed, samples)


def judge_until(
    requests: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    task: str,
    n: int = 1,
    samples: int = 300,
    seed: int = 0,
) -> DataFrame:
    """The first ``samples`` valid comparisons in seeded order, judging few more than it takes.

    ``ask`` maps requests to completions.  Samples are released to it in rounds,
    in the seeded order: as many as are still missing, by the share that has been
    valid so far.  The rounds end when there are enough or none is left.  All
    samples before the last released one have been judged, so the rows are those
    of judging everything; whatever the partitioning, the rounds are the same.
    Each round's answers are stored, so no request is asked twice.  ``requests``
    is read once per round: store it first if it is dear to compute.
    """
    order = ShuffledOrder(requests.select("sample_id").distinct(), "sample_id", seed)
    valid, found, released, before = None, 0, 0, None
    while found < samples and released < order.rows:
        missing = samples - found
        share = 1.0 if not released else max(found, 0.5) / released
        # Twice the spread of how many of them will be valid, so that one more round is rare.
        wanted = missing + 2 * math.sqrt(missing * (1 - min(share, 1.0)))
        upto = released + math.ceil(wanted / share)
        # One round says little about a small share: go on with what it supports.
        released = min(upto, 4 * released or samples, order.rows)
        place = order.place(released)
        asked = requests.where(order.upto(place) & ~order.upto(before))
        answered = materialize(ask(asked), "completions")
        judged = materialize(verdicts(asked, answered, task, n), "verdicts")
        found, before = found + judged.count(), place
        valid = judged if valid is None else valid.unionByName(judged)
    if valid is None:
        return verdicts(requests, ask(requests.where("false")), task, n)
    return sample_comparisons(valid, samples, seed)


def slot_win_rates(valid: DataFrame) -> DataFrame:
    """Mean win per output slot."""
    slots = valid.select(F.posexplode("wins").alias("slot", "win"))
    return slots.groupBy("slot").agg(F.avg(F.col("win").cast("double")).alias("win_rate"))


def win_summary(valid: DataFrame) -> DataFrame:
    """Mean, min and max of the slot rates; population std over slots / sqrt(n)."""
    rate = F.col("win_rate")
    return slot_win_rates(valid).agg(
        F.avg(rate).alias("mean"),
        (F.stddev_pop(rate) / F.sqrt(F.count(rate))).alias("std_err"),
        F.min(rate).alias("min"),
        F.max(rate).alias("max"),
    )


def running_win_stats(valid: DataFrame, seed: int = 0) -> DataFrame:
    """Win statistics over the slots as samples arrive in seeded random order.

    ``sample_id, row_no`` and the mean, standard error, least and greatest of the
    slots' win rates over the samples so far.
    """
    order = shuffled_numbers(valid.select("sample_id"), "sample_id", seed)
    numbered = valid.select("sample_id", "wins").join(order, "sample_id")
    # Stored, as the sums read them for the cells, the offsets and the rows.
    slots = materialize(numbered.select("sample_id", "row_no", F.posexplode("wins").alias("slot", "win")), "slots")
    summed = running_sums(slots, "row_no", {"won": F.col("win").cast("int")}, ["slot"])
    rate = F.col("won") / F.col("row_no")
    return summed.groupBy("sample_id", "row_no").agg(
        F.avg(rate).alias("mean"),
        (F.stddev_pop(rate) / F.sqrt(F.count(rate))).alias("std_err"),
        F.min(rate).alias("min"),
        F.max(rate).alias("max"),
    )


def comparison_records(valid: DataFrame) -> DataFrame:
    """Rows to write: what was compared and who won."""
    return valid.select(
        F.struct("sample_id", "history").alias("generated"),
        F.struct("reference_response", "wins").alias("reference"),
    )
