"""Operator inputs derived from the test tables.

The tables hold no rejected answers, log-probabilities or judge texts; these
are made from the rows by md5, so they exercise arithmetic, not model quality.
Every derivation works on all rows of its table and on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import chat, rand, tokens
from ..functions.binding import bind
from ..operators import turns as turn_ops
from ..operators.grouping import generation_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def hh_raw(spark: SparkSession, sf_dir: str, max_prompt_length: int | None = None, needed: int = 2) -> DataFrame:
    """Raw ``hh`` rows, with the context that prompts of ``max_prompt_length`` tokens reach (None: all)."""
    return turn_ops.example_rows(table(spark, sf_dir, "conversations"), max_prompt_length, needed)


def tldr_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: the first line is chosen, the last one rejected."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"),
        F.when(F.col("lang") == "en", "train").otherwise("valid1").alias("split"),
        text.alias("prompt"),
        F.concat(F.substring_index(text, "\n", 1), F.lit(" #"), F.col("doc_id")).alias("chosen"),
        F.concat(F.substring_index(text, "\n", -1), F.lit(" #"), F.col("doc_id")).alias("rejected"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as generated outputs; ``output_idx`` is unique in a sample."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "assistant")
        .select(
            F.col("conv_id").alias("sample_id"),
            F.col("turn").alias("output_idx"),
            F.col("text").alias("output"),
        )
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per conversation: its first user message; reference: the last answer."""
    talk = table(spark, sf_dir, "conversations")

    def pick(by, role: str) -> Column:
        said = F.col("role") == role
        return by(F.when(said, F.col("text")), F.when(said, F.col("turn")))

    picked = talk.groupBy("conv_id").agg(
        pick(F.min_by, "user").alias("question"), pick(F.max_by, "assistant").alias("answer")
    )
    history = F.array(chat.message("user", F.col("question")))
    return picked.select(
        F.col("conv_id").alias("sample_id"),
        F.lit(0).alias("part"),
        chat.render(history, add_generation_prompt=True).alias("prompt"),
        history.alias("history"),
        F.array_compact(F.array("answer")).alias("references"),
    )


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation_records(prompts(spark, sf_dir), answers(spark, sf_dir))


def completions(requests: DataFrame, task: str) -> DataFrame:
    """Judge answers by the request's digest: A, B, a quoted A, or no verdict."""
    u = rand.unit(F.col("request_id"))
    cue = "More helpful: " if task == "hh" else "Preferred: "
    return requests.select(
        "request_id",
        F.when(u < 0.45, cue + "A")
        .when(u < 0.9, cue + "B")
        .when(u < 0.95, cue + '"A"')
        .otherwise("no verdict")
        .alias("completion"),
    )


def answer_pairs(spark: SparkSession, sf_dir: str, needed: int = 2) -> DataFrame:
    """``pair_id, side, text``: last (chosen) and first (rejected) answers."""
    talk = table(spark, sf_dir, "conversations")
    marked = turn_ops.with_spans(talk, needed)
    sides = F.array(
        F.when(F.col("turn") == F.col("last_turn"), "chosen"),
        F.when(F.col("turn") == F.col("first_turn"), "rejected"),
    )
    return marked.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("pair_id"),
        F.explode(F.array_compact(sides)).alias("side"),
        "text",
    )


def token_scores(spark: SparkSession, sf_dir: str, needed: int = 2) -> DataFrame:
    """Token log-probabilities per sequence; the first third is the prompt."""
    # A text with any non-blank character has a token; counting pairs reads no tokens.
    spoken = answer_pairs(spark, sf_dir, needed).where(F.col("text").rlike(r"[^ \t\n\r\f]"))
    pairs = spoken.select(
        "pair_id",
        "side",
        F.concat_ws(":", "pair_id", "side").alias("seq"),
        F.size(tokens.words(F.col("text"))).alias("n"),
    )
    places = F.sequence(F.lit(0), F.col("n") - 1)

    def scores(kind: str) -> Column:
        drawn = bind(
            F.col("seq"),
            lambda seq: F.transform(places, lambda t: -4.0 * rand.unit(seq, t, kind)),
        )
        return drawn.alias(kind)

    mask = bind(F.col("n"), lambda n: F.transform(places, lambda t: t * 3 >= n))
    return pairs.select(
        "pair_id",
        "side",
        scores("policy_logp"),
        scores("ref_logp"),
        scores("policy_eos_logp"),
        scores("ref_eos_logp_gamma"),
        mask.alias("mask"),
    )


def logits(spark: SparkSession, sf_dir: str, length: int = 8) -> DataFrame:
    """Embeddings as logits: ``length`` consecutive vectors form a sequence."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / length).alias("seq_id"), F.col("vec_id"), "embedding"
    )
    # vec_id is unique, so a sequence gathers at most ``length`` rows.
    ordered = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    label = lambda s: F.when(F.pmod(s["vec_id"], F.lit(length)) * 3 < length, F.lit(-100)).otherwise(
        rand.bits32(rand.digest(s["vec_id"])) % F.size(s["embedding"])
    ).cast("int")
    return (
        rows.groupBy("seq_id")
        .agg(ordered.alias("steps"))
        .select(
            "seq_id",
            F.transform("steps", lambda s: s["embedding"]).alias("logits"),
            F.transform("steps", label).alias("labels"),
        )
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training log: 20 events per batch, 250 batches per epoch."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.lit("r0").alias("run"),
        F.floor(event / 5000).cast("int").alias("epoch"),
        F.floor(event / 20).cast("bigint").alias("batch"),
        (F.col("user_id") % 2).cast("int").alias("rank"),
        F.lit("train").alias("split"),
        F.col("event_type").alias("metric"),
        "value",
        F.lit(16).cast("bigint").alias("n_examples"),
        "ts",
    )
