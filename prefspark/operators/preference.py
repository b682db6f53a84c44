"""Preference losses and rewards from stored token log-probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import logprob

_SCORES = ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected")


def token_logps(
    df: DataFrame,
    temperature: float = 1.0,
    slide_mask: bool = False,
    logits: str = "logits",
    labels: str = "labels",
) -> DataFrame:
    """Add ``logp`` and ``mask`` (one shorter than ``labels``) from raw logits."""
    mask = logprob.label_mask(F.col(labels))
    if slide_mask:
        mask = logprob.slide_mask(mask)
    with_mask = df.withColumn("mask", mask)
    logp = logprob.logits_to_logps(F.col(logits), F.col(labels), temperature)
    return with_mask.withColumn("logp", logprob.masked(logp, F.col("mask")))


def sequence_logp(values: Column, mask: Column, how: str = "sum") -> Column:
    """Score of one sequence; ``none`` keeps the masked token scores."""
    picked = logprob.masked(values, mask)
    if how == "none":
        return picked
    if how == "sum":
        return logprob.total(picked)
    if how == "mean":
        return F.try_divide(logprob.total(picked), logprob.count_true(mask))
    raise ValueError(f"unknown reduction {how!r}")


def stack_sides(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both halves as one table with a ``side`` column."""
    return chosen.withColumn("side", F.lit("chosen")).unionByName(
        rejected.withColumn("side", F.lit("rejected"))
    )


def join_scores(policy: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Policy and reference scores of the same sequence in one row."""
    return policy.join(reference, keys)


def pair_scores(sequences: DataFrame, loss_type: str = "sigmoid") -> DataFrame:
    """One row per pair from one row per (pair, side).

    A conditional aggregate instead of a self-join: one shuffle of four numbers.
    Long-normalized scores for the squared-margin loss, sums otherwise.  Two
    rows for one side of a pair are an error; a pair without one of its sides has
    NULL scores there (see ``incomplete_pairs``).
    """
    how = "mean" if loss_type == "ipo" else "sum"
    scored = sequences.select(
        "pair_id",
        "side",
        sequence_logp(F.col("policy_logp"), F.col("mask"), how).alias("policy"),
        sequence_logp(F.col("ref_logp"), F.col("mask"), how).alias("ref"),
    )

    def pick(column: str, side: str) -> Column:
        rows = F.count(F.when(F.col("side") == side, 1))
        twice = F.raise_error(F.concat(F.lit(f"two {side} rows of pair "), F.first("pair_id").cast("string")))
        value = F.max(F.when(F.col("side") == side, F.col(column)))
        return F.when(rows > 1, twice.cast("double")).otherwise(value).alias(f"{column}_{side}")

    return scored.groupBy("pair_id").agg(
        *[pick(c, s) for c in ("policy", "ref") for s in ("chosen", "rejected")]
    )


def incomplete_pairs(sequences: DataFrame) -> DataFrame:
    """``pair_id, missing``: pairs that lack their chosen or rejected row."""
    has = lambda side: F.max((F.col("side") == side).cast("int")) == 1
    sides = sequences.groupBy("pair_id").agg(has("chosen").alias("c"), has("rejected").alias("r"))
    missing = F.when(~F.col("c"), "chosen").when(~F.col("r"), "rejected")
    return sides.select("pair_id", missing.alias("missing")).where(F.col("missing").isNotNull())


def margin() -> Column:
    return (F.col("policy_chosen") - F.col("policy_rejected")) - (
        F.col("ref_chosen") - F.col("ref_rejected")
    )


def loss_sigmoid(z: Column, beta: float, label_smoothing: float = 0.0) -> Column:
    scaled = z * F.lit(float(beta))
    kept = -logprob.log_sigmoid(scaled) * F.lit(1.0 - label_smoothing)
    return kept - logprob.log_sigmoid(-scaled) * F.lit(float(label_smoothing))


def loss_ipo(z: Column, beta: float, label_smoothing: float = 0.0) -> Column:
    return F.pow(z - F.lit(1.0 / (2.0 * beta)), F.lit(2.0))


def loss_normcdf(z: Column, beta: float, label_smoothing: float = 0.0) -> Column:
    return logprob.neg_log_normal_cdf(z * F.lit(float(beta)))


_LOSSES: dict[str, Callable[[Column, float, float], Column]] = {
    "sigmoid": loss_sigmoid,
    "ipo": loss_ipo,
    "normcdf": loss_normcdf,
}


def register_loss(name: str, fn: Callable[[Column, float, float], Column]) -> None:
    """Make ``fn(margin, beta, label_smoothing) -> Column`` available by name."""
    _LOSSES[name] = fn


def score_name(loss_type: str) -> str:
    return "ipo" if loss_type == "ipo" else "dpo"


def preference_scores(
    pairs: DataFrame,
    loss_type: str = "sigmoid",
    beta: float = 0.1,
    label_smoothing: float = 0.0,
    granularity: str = "pair",
) -> DataFrame:
    """Loss, rewards, margin, accuracy and log-probs.

    ``pair``: one row per pair.  ``batch``: one row per ``batch_id``, where
    rewards and log-probs are sums over the batch and accuracy is one bit.
    """
    if beta <= 0:
        raise ValueError("beta must be positive")
    if loss_type not in _LOSSES:
        raise ValueError(f"unknown loss type {loss_type!r}; known: {sorted(_LOSSES)}")
    lossy = pairs.withColumn("margin_logit", margin())
    lossy = lossy.withColumn("loss", _LOSSES[loss_type](F.col("margin_logit"), beta, label_smoothing))
    if granularity == "batch":
        lossy = lossy.groupBy("batch_id").agg(
            F.avg("loss").alias("loss"), *[F.sum(c).alias(c) for c in _SCORES]
        )
    elif granularity != "pair":
        raise ValueError("granularity must be 'pair' or 'batch'")
    scale = F.lit(float(beta))
    rewarded = lossy.withColumns(
        {
            "rewards_chosen": scale * (F.col("policy_chosen") - F.col("ref_chosen")),
            "rewards_rejected": scale * (F.col("policy_rejected") - F.col("ref_rejected")),
        }
    )
    chosen, rejected = F.col("rewards_chosen"), F.col("rewards_rejected")
    return rewarded.withColumns(
        {
            "rewards": chosen + rejected,
            "rewards_margin": chosen - rejected,
            "rewards_accuracy": (chosen > rejected).cast("double"),
            "logps_chosen": F.col("policy_chosen"),
            "logps_rejected": F.col("policy_rejected"),
        }
    ).drop(*_SCORES)


METRICS = (
    "loss",
    "rewards_chosen",
    "rewards_rejected",
    "rewards",
    "rewards_accuracy",
    "rewards_margin",
    "logps_chosen",
    "logps_rejected",
)


def batch_means(scores: DataFrame, by: str | None = "batch_id", split: str | None = None) -> DataFrame:
    """Means of the per-pair scores; names become ``split/…`` where given."""
    prefix = f"{split}/" if split else ""
    means = [F.avg(m).alias(f"{prefix}{m}") for m in METRICS]
    return scores.groupBy(by).agg(*means) if by else scores.agg(*means)


def sft_nll(sequences: DataFrame, by: str = "batch_id", logp: str = "policy_logp") -> DataFrame:
    """Token-mean negative log-likelihood of the counted positions per batch."""
    summed = sequences.select(
        by,
        sequence_logp(F.col(logp), F.col("mask")).alias("_lp"),
        logprob.count_true(F.col("mask")).alias("_n"),
    )
    return summed.groupBy(by).agg(
        F.sum("_n").alias("n_tokens"),
        F.try_divide(-F.sum("_lp"), F.sum("_n")).alias("loss"),
    )
