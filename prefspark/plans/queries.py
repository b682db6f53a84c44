"""Registered queries: name -> (spark, sf_dir) -> DataFrame, over whole tables.

List columns come out as joined text and doubles rounded, so that results can
be compared with plain SQL (``oracles.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import chat, judging as judging_fn
from ..operators import (
    adapters,
    asking,
    diversity as div,
    encoding,
    epochs,
    flow,
    grouping,
    judging,
    logits as sharded,
    metrics,
    numbering,
    plugins,
    preference as pref,
    turns,
)
from ..session import materialize, scratch_path
from ..sources import corpora, records, tables
from ..sources.ledger import Ledger
from ..streaming import metrics as streams
from . import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PROMPT_LENGTH, LENGTH = 96, 160


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def joined(column: str) -> Column:
    """A list column as blank-separated text."""
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


# --- diversity -------------------------------------------------------------


def _diversity(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "embeddings")
    return div.diversity(rows, "label", "embedding")


@query
def diversity_per_sample(spark, sf):
    return rounded(_diversity(spark, sf), "diversity")


@query
def diversity_summary(spark, sf):
    return rounded(div.mean_std_err(_diversity(spark, sf), "diversity"), "mean", "std_err")


def _embedded_records(spark: SparkSession, sf: str) -> DataFrame:
    """Ten consecutive vectors per record (vec_id is unique, so ten at most)."""
    rows = tables.table(spark, sf, "embeddings")
    return rows.groupBy(F.floor(F.col("vec_id") / 10).alias("sample_id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))),
            lambda s: s["embedding"].cast("array<double>"),
        ).alias("vectors")
    ).select(F.lit("r0").alias("run"), "sample_id", "vectors")


@query
def diversity_of_records(spark, sf):
    scored = div.row_diversity(_embedded_records(spark, sf), "vectors")
    return rounded(scored.select("sample_id", "diversity"), "diversity")


# --- adapters --------------------------------------------------------------


def _turn_messages(kind: str, columns: tuple[str, ...]) -> Query:
    return lambda spark, sf: turns.messages(
        tables.table(spark, sf, "conversations"), kind
    ).select(*columns)


QUERIES["hh_paired"] = _turn_messages("paired", ("row_idx", "side", "pos", "role", "content"))
QUERIES["hh_unpaired"] = _turn_messages("unpaired", ("row_idx", "side", "pos", "role", "content"))


QUERIES["hh_prompt_only"] = _turn_messages("prompt", ("row_idx", "side", "pos", "role", "content"))


def _example_messages(raw: DataFrame, adapter: str) -> DataFrame:
    """The messages of adapted examples, a row each."""
    examples = adapters.adapt(raw, adapter)
    sides = [c for c in ("chosen", "rejected") if c in examples.columns]
    tagged = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("messages")) for s in sides])
    return (
        examples.select("row_idx", F.explode(tagged).alias("e"))
        .select("row_idx", "e.side", F.posexplode("e.messages").alias("pos", "m"))
        .select("row_idx", "side", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")
    )


@query
def hh_paired_examples(spark, sf):
    return _example_messages(tables.hh_raw(spark, sf), "hh_paired")


@query
def hh_unpaired_examples(spark, sf):
    return _example_messages(tables.hh_raw(spark, sf, needed=1), "hh_unpaired")


@query
def hh_prompt_only_examples(spark, sf):
    """Prompt with its cue, the messages it was made of, and its one reference."""
    prompts = adapters.adapt(tables.hh_raw(spark, sf, needed=1), "hh_prompt_only")
    said = F.transform("history", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return prompts.select(
        "sample_id", "prompt", F.array_join(said, " | ").alias("history"), F.array_join("references", " | ").alias("references")
    )


@query
def registered_adapter(spark, sf):
    """A user's adapter by name: both answers swapped."""

    def swapped(df: DataFrame) -> DataFrame:
        other = df.select("row_idx", "prompt", F.col("rejected").alias("chosen"), F.col("chosen").alias("rejected"))
        return adapters.to_paired(other, "tldr")

    adapters.register_adapter("tldr_swapped", swapped)
    return _example_messages(tables.tldr_raw(spark, sf), "tldr_swapped")


@query
def picked_template(spark, sf):
    """The template picked for a tokenizer with instruction marks, against one for generation."""
    examples = adapters.adapt(tables.tldr_raw(spark, sf), "tldr_unpaired")
    own = "{{ '[INST]' + message + '[/INST]' }}"
    texts = {
        "trained": chat.render(F.col("chosen"), chat.pick_template(own)),
        "generating": chat.render(F.slice("chosen", 1, 1), chat.pick_template(own, generating=True), add_generation_prompt=True),
    }
    return examples.select("row_idx", *[c.alias(n) for n, c in texts.items()])


@query
def hh_chatml_messages(spark, sf):
    talk = turns.messages(tables.table(spark, sf, "conversations"), "unpaired")
    text = chat.chatml_message(F.col("role"), F.col("content"), F.col("opens"), "<|im_end|>")
    return talk.select("row_idx", "pos", text.alias("rendered"))


def _tldr(adapter: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _example_messages(tables.tldr_raw(spark, sf), adapter)

    return run


QUERIES["tldr_paired"] = _tldr("tldr_paired")
QUERIES["tldr_unpaired"] = _tldr("tldr_unpaired")


@query
def tldr_grouped_prompts(spark, sf):
    grouped = grouping.group_references(tables.tldr_raw(spark, sf))
    prompts = adapters.adapt(grouped, "tldr_prompt_only")
    return prompts.select(
        "sample_id",
        F.col("part").cast("bigint").alias("part"),
        "prompt",
        F.size("references").cast("bigint").alias("n_references"),
        F.array_join("references", " | ").alias("references"),
    )


def _rendered(template: str, cue: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        examples = adapters.adapt(tables.tldr_raw(spark, sf), "tldr_unpaired")
        return examples.select(
            "row_idx",
            chat.render(F.col("chosen"), template, add_generation_prompt=cue).alias("conversation"),
            chat.render(F.slice("chosen", 2, 1), template).alias("answer"),
        )

    return run


QUERIES["chatml_render"] = _rendered("chatml", True)
QUERIES["llama_render"] = _rendered("llama", True)


# --- encoding and batching -------------------------------------------------


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.hh_raw(spark, sf, PROMPT_LENGTH)
    pairs = adapters.adapt(raw, "hh_paired")
    return encoding.encode(pairs, ["chosen", "rejected"], PROMPT_LENGTH, LENGTH)


@query
def encode_truncate(spark, sf):
    return _encoded(spark, sf).select(
        "row_idx", joined("prompt_ids"), joined("chosen_ids"), joined("rejected_ids")
    )


@query
def labels(spark, sf):
    labelled = encoding.build_labels(_encoded(spark, sf), ["chosen", "rejected"])
    return labelled.select(
        "row_idx",
        *[
            joined(f"{s}_{f}")
            for s in ("chosen", "rejected")
            for f in ("input_ids", "attention_mask", "labels")
        ],
    )


@query
def batch_pad_right(spark, sf):
    raw = tables.hh_raw(spark, sf, PROMPT_LENGTH)
    batches = flows.training_batches(
        raw, "hh", max_prompt_length=PROMPT_LENGTH, max_length=LENGTH, pad_id=1
    )
    return batches.select(
        "row_idx",
        "batch_id",
        F.col("padded_length").cast("bigint").alias("padded_length"),
        *[joined(f"{s}_{f}") for s in ("chosen", "rejected") for f in ("input_ids", "attention_mask", "labels")],
    )


@query
def batch_pad_left(spark, sf):
    raw = tables.hh_raw(spark, sf, PROMPT_LENGTH, needed=1)
    batches = flows.prompt_batches(
        raw,
        "hh",
        max_prompt_length=PROMPT_LENGTH,
        max_length=LENGTH,
        pad_id=1,
    )
    return batches.select(
        "row_idx",
        "batch_id",
        joined("prompt_input_ids"),
        joined("prompt_attention_mask"),
        "reference_response",
    )


@query
def generation_prompt_ids(spark, sf):
    """Prompts cut from the left to the generator's context."""
    grouped = grouping.group_references(tables.tldr_raw(spark, sf))
    prompts = adapters.adapt(grouped, "tldr_prompt_only")
    ids = encoding.encode_prompts(prompts, context_length=256)
    return ids.select("sample_id", joined("prompt_ids"))


@query
def tokenizer_plugin(spark, sf):
    """A user tokenizer in place of the default: one id per blank-separated word."""

    def loader():
        return lambda texts: [[len(w) for w in t.split(" ") if w] for t in texts]

    docs = tables.table(spark, sf, "documents")
    ids = encoding.tokenize(docs.select("doc_id", "text"), {"text": "ids"}, loader)
    return ids.select("doc_id", joined("ids"))


# --- sampling and order ----------------------------------------------------


@query
def take_proportion(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return numbering.take_proportion(docs, 0.29, "doc_id")


@query
def seeded_shuffle(spark, sf):
    events = tables.table(spark, sf, "events").select("event_id")
    return numbering.shuffled_numbers(events, "event_id", 7)


@query
def seeded_shuffle_topn(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang")
    return numbering.first_shuffled(docs, "doc_id", 7, 100)


@query
def shuffled_batches(spark, sf):
    events = tables.table(spark, sf, "events").select("event_id")
    return numbering.assign_batches(events, 16, "event_id", seed=3)


@query
def epoch_shuffled_batches(spark, sf):
    """The batches of all rows in two epochs, from numbers that are made once."""
    events = tables.table(spark, sf, "events").select("event_id")
    numbered = materialize(numbering.row_numbers(events, "event_id"), "numbered")
    first = epochs.epoch_batches(numbered, 16, seed=3, epoch=0, name="batch_0")
    return epochs.epoch_batches(first, 16, seed=3, epoch=1, name="batch_1")


@query
def running_eval_stats(spark, sf):
    events = tables.table(spark, sf, "events").select("event_id", (F.col("value") / 3).alias("value"))
    stats = numbering.running_stats(events, "value", "event_id")
    return rounded(
        stats.select(
            "event_id", F.col("seen").cast("bigint").alias("seen"), "running_mean", "running_std_err"
        ),
        "running_mean",
        "running_std_err",
    )


# --- corpora and hand-over tables ------------------------------------------


@query
def load_split(spark, sf):
    """Corpus written by split, then one split read back and counted."""
    path = scratch_path(spark, "corpus")
    tables.tldr_raw(spark, sf).write.partitionBy("split").parquet(path)
    rows = corpora.load_preferences(spark, path, "tldr", corpora.split_name("tldr", train=False))
    return rows.select("row_idx", "split", F.length("chosen").cast("bigint").alias("chosen_chars"))


@query
def rows_by_id(spark, sf):
    labelled = tables.table(spark, sf, "labels").where("quality = 0").select("doc_id")
    docs = corpora.scan_columns(
        spark, f"{sf}/documents.parquet", schemas.TABLES["documents"], ["doc_id", "lang"]
    )
    return corpora.get_rows(docs, "doc_id", labelled)


@query
def row_look_up(spark, sf):
    """The rows of a short list of ids (the first of every language), from a corpus laid out by key, and its length."""
    path = scratch_path(spark, "by-key")
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang", "source")
    corpora.write_by_key(docs, path, "doc_id")
    corpus = spark.read.schema(docs.schema).parquet(path)
    ids = [r[0] for r in corpus.groupBy("lang").agg(F.min("doc_id")).select("min(doc_id)").collect()]
    return corpora.get_rows(corpus, "doc_id", ids).withColumn("corpus_rows", F.lit(corpora.dataset_len(corpus)).cast("bigint"))


@query
def generation_records(spark, sf):
    path = scratch_path(spark, "generated")
    records.write_generations(tables.generated(spark, sf), path)
    rows = records.read_generations(spark, path)
    return rows.select(
        "sample_id",
        F.col("part").cast("bigint").alias("part"),
        F.element_at("history", -1)["content"].alias("question"),
        "prompt",
        F.size("outputs").cast("bigint").alias("n_outputs"),
        F.array_join("outputs", " | ").alias("outputs"),
        F.array_join("references", " | ").alias("references"),
    )


# --- log-probabilities and losses ------------------------------------------


@query
def token_logps(spark, sf):
    scored = pref.token_logps(tables.logits(spark, sf), temperature=0.7, slide_mask=True)
    exploded = scored.select("seq_id", F.posexplode(F.arrays_zip("logp", "mask")).alias("pos", "t"))
    return rounded(
        exploded.select(
            "seq_id",
            F.col("pos").cast("bigint").alias("pos"),
            F.col("t.logp").alias("logp"),
            F.col("t.mask").cast("bigint").alias("counted"),
        ),
        "logp",
    )


@query
def sequence_logp(spark, sf):
    seqs = tables.token_scores(spark, sf)
    lp, mask = F.col("policy_logp"), F.col("mask")
    return rounded(
        seqs.select(
            "pair_id",
            "side",
            pref.sequence_logp(lp, mask, "sum").alias("logp_sum"),
            pref.sequence_logp(lp, mask, "mean").alias("logp_mean"),
        ),
        "logp_sum",
        "logp_mean",
    )


@query
def sft_nll(spark, sf):
    chosen = tables.token_scores(spark, sf, needed=1).where("side = 'chosen'")
    batched = numbering.assign_batches(chosen.select("pair_id", "policy_logp", "mask"), 16, "pair_id")
    losses = pref.sft_nll(batched).withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
    return rounded(losses, "loss")


def _scores(loss_type: str, beta: float = 0.1, smoothing: float = 0.0) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pairs = pref.pair_scores(tables.token_scores(spark, sf), loss_type)
        return pref.preference_scores(pairs, loss_type, beta, smoothing)

    return run


def _loss(loss_type: str, beta: float, smoothing: float = 0.0) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        scores = _scores(loss_type, beta, smoothing)(spark, sf)
        return rounded(scores.select("pair_id", "margin_logit", "loss"), "margin_logit", "loss")

    return run


QUERIES["dpo_sigmoid"] = _loss("sigmoid", 0.1, 0.1)
QUERIES["dpo_ipo"] = _loss("ipo", 0.1)
QUERIES["dpo_normcdf"] = _loss("normcdf", 0.1)


@query
def registered_loss(spark, sf):
    """A user's loss by name, beside the name its scores are logged under."""
    pref.register_loss("hinge", lambda z, beta, smoothing: F.greatest(F.lit(0.0), 1 - beta * z))
    scores = _scores("hinge")(spark, sf)
    named = scores.select("pair_id", F.lit(pref.score_name("hinge")).alias("score_name"), "loss")
    return rounded(named, "loss")


def _batch_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Batch of each pair, numbered on the narrow table of keys."""
    keys = tables.answer_pairs(spark, sf).where(F.col("text").rlike(r"[^ \t\n\r\f]")).select("pair_id").distinct()
    return numbering.assign_batches(materialize(keys, "pair-keys"), 16, "pair_id")


@query
def reward_metrics(spark, sf):
    scores = _scores("sigmoid")(spark, sf).join(_batch_numbers(spark, sf), "pair_id")
    return rounded(pref.batch_means(scores), *pref.METRICS)


@query
def reward_metrics_by_batch(spark, sf):
    pairs = pref.pair_scores(tables.token_scores(spark, sf)).join(_batch_numbers(spark, sf), "pair_id")
    scores = pref.preference_scores(pairs, granularity="batch")
    return rounded(scores.select("batch_id", *pref.METRICS), *pref.METRICS)


@query
def policy_reference_join(spark, sf):
    """Policy and reference scores kept as two tables, stacked sides, then joined."""
    seqs = tables.token_scores(spark, sf)

    def half(side: str, column: str, name: str) -> DataFrame:
        score = pref.sequence_logp(F.col(column), F.col("mask")).alias(name)
        return seqs.where(F.col("side") == side).select("pair_id", score)

    def both(column: str, name: str) -> DataFrame:
        return pref.stack_sides(half("chosen", column, name), half("rejected", column, name))

    scores = pref.join_scores(
        both("policy_logp", "policy"), both("ref_logp", "ref"), ["pair_id", "side"]
    )
    return rounded(scores, "policy", "ref")


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    return flow.flow_scores(tables.token_scores(spark, sf), alpha=0.1)


@query
def sharded_token_logps(spark, sf):
    """Label and end-token log-probabilities from shards of ten values, at two temperatures in one pass."""
    shards = sharded.shard_logits(tables.logits(spark, sf), 10)
    scored = sharded.slide_counted(sharded.sharded_logps(shards, 0.7, end_id=3, end_temperature=1.5))
    return rounded(
        scored.select("seq_id", F.col("pos").cast("bigint").alias("pos"), "logp", "end_logp", F.col("counted").cast("bigint").alias("counted")),
        "logp",
        "end_logp",
    )


@query
def flow_from_logits(spark, sf):
    """Flow scores that start from two models' logits; the reference's are the policy's, negated."""
    made = tables.logits(spark, sf)
    other = made.withColumn("logits", F.transform("logits", lambda row: F.transform(row, lambda x: -x)))
    policy = sharded.slide_counted(sharded.sharded_logps(sharded.shard_logits(made, 16), 0.7, end_id=3))
    reference = sharded.sharded_logps(sharded.shard_logits(other, 16), 0.7, end_id=3, end_temperature=2.0)
    sequences = sharded.flow_sequences(policy, reference, ["seq_id"])
    sided = sequences.withColumn("side", F.when(F.col("seq_id") % 2 == 0, "chosen").otherwise("rejected"))
    scores = flow.flow_scores(sided.withColumnRenamed("seq_id", "pair_id"), alpha=0.1)
    return rounded(scores, "residual_loss", "reward", "kl")


@query
def flow_residual(spark, sf):
    return rounded(_flow(spark, sf).select("pair_id", "side", "residual_loss"), "residual_loss")


@query
def flow_rewards(spark, sf):
    return rounded(_flow(spark, sf).select("pair_id", "side", "reward"), "reward")


@query
def flow_kl(spark, sf):
    return rounded(_flow(spark, sf).select("pair_id", "side", "kl"), "kl")


@query
def flow_metrics(spark, sf):
    names = ("loss", "kl", "rewards", "chosen_rewards", "rejected_rewards")
    return rounded(flow.flow_metrics(_flow(spark, sf)), *names)


# --- judged win rate -------------------------------------------------------


def _requests(spark: SparkSession, sf: str, task: str, mode: str | None, n: int) -> DataFrame:
    return judging.judge_requests(tables.generated(spark, sf), task, mode, n)


def _request_query(task: str, mode: str | None, n: int) -> Query:
    return lambda spark, sf: _requests(spark, sf, task, mode, n).select(
        "sample_id",
        F.col("slot").cast("bigint").alias("slot"),
        "request_id",
        F.col("response_is_a").cast("bigint").alias("response_is_a"),
        "judge_prompt",
    )


QUERIES["judge_requests"] = _request_query("hh", None, 2)
QUERIES["judge_requests_concise"] = _request_query("tldr", "concise", 1)
QUERIES["judge_requests_simple"] = _request_query("tldr", "simple", 1)


@query
def judge_verdicts(spark, sf):
    asked = _requests(spark, sf, "hh", None, 2)
    judged = judging.votes(asked, tables.completions(asked, "hh"), "hh")
    return judged.select("request_id", "verdict", F.col("win").cast("bigint").alias("win"))


def _valid(spark: SparkSession, sf: str, n: int) -> DataFrame:
    asked = _requests(spark, sf, "hh", None, n)
    return judging.verdicts(asked, tables.completions(asked, "hh"), "hh", n)


@query
def slot_win_rate(spark, sf):
    rates = judging.slot_win_rates(_valid(spark, sf, 2))
    return rounded(rates.withColumn("slot", F.col("slot").cast("bigint")), "win_rate")


@query
def win_rate(spark, sf):
    report = flows.win_rate_report(
        tables.generated(spark, sf), lambda asked: tables.completions(asked, "hh"), n=2, samples=40
    )
    return rounded(report, "mean", "std_err", "min", "max")


@query
def judged_until_enough(spark, sf):
    """A judge that is asked in rounds, until 25 samples have two valid votes each."""
    requests = materialize(_requests(spark, sf, "hh", None, 2), "requests")
    chosen = judging.judge_until(requests, lambda asked: tables.completions(asked, "hh"), "hh", 2, 25)
    return chosen.select("sample_id", "reference_response", joined("wins"))


@query
def running_win_stats(spark, sf):
    stats = judging.running_win_stats(_valid(spark, sf, 2))
    return rounded(stats, "mean", "std_err", "min", "max")


@query
def foreign_records_win_rate(spark, sf):
    """Records without ids, their references a list or one text, and a line that is none: read and judged."""
    path = scratch_path(spark, "foreign")
    made = tables.generated(spark, sf)
    one = F.to_json(F.struct("history", "prompt", "outputs", F.get("references", F.lit(0)).alias("references")))
    many = F.to_json(F.struct("history", "prompt", "outputs", "references"))
    lines = made.select(F.when(F.pmod("sample_id", F.lit(2)) == 0, one).otherwise(many).alias("value"))
    lines.unionByName(spark.createDataFrame([("not a record",)], "value string")).write.text(path)
    rows = records.read_generations(spark, path)
    report = flows.win_rate_report(rows, lambda asked: tables.completions(asked, "hh"), n=1, samples=10**6)
    rejected = records.rejected_lines(spark, path).count()
    return rounded(report, "mean", "std_err", "min", "max").withColumn("rejected_lines", F.lit(rejected).cast("bigint"))


@query
def comparison_records(spark, sf):
    path = scratch_path(spark, "comparisons")
    records.write_comparisons(_valid(spark, sf, 1), path)
    rows = records.read_comparisons(spark, path)
    return rows.select(
        "generated.sample_id",
        "reference.reference_response",
        F.array_join(F.col("reference.wins").cast("array<string>"), ",").alias("wins"),
    )


@query
def judge_plugin(spark, sf):
    """A user's judge function in place of a completion table."""

    def loader():
        return lambda texts, temperature, max_tokens: [
            "Comparison: by length\nMore helpful: " + ("A" if len(t) % 2 == 0 else "B") for t in texts
        ]

    asked = _requests(spark, sf, "hh", None, 1)
    judged = judging.votes(asked, plugins.judge(asked, loader), "hh")
    return judged.select("request_id", "verdict", F.col("win").cast("bigint").alias("win"))


@query
def asked_once(spark, sf):
    """Answers of a model about every turn's text, which it is asked about once however often it is said."""

    def ask(texts: DataFrame) -> DataFrame:
        return plugins.judge(
            texts.select(F.col("digest").alias("request_id"), F.col("text").alias("judge_prompt")),
            lambda: lambda texts, temperature, max_tokens: [str(len(t.split(" "))) for t in texts],
        ).select(F.col("request_id").alias("digest"), F.col("completion").alias("answer"))

    said = tables.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    ledger = Ledger(spark, scratch_path(spark, "answers"), "digest string, answer string")
    return asking.ask_once(said, "text", ask, ledger, batches=2).drop("text")


@query
def embed_outputs_diversity(spark, sf):
    """A user's embedder (letter counts) on every output, then diversity."""

    def loader():
        return lambda texts: [[t.count(c) for c in "aeioutnrs"] for t in texts]

    outputs = plugins.embed(tables.answers(spark, sf), "output", loader)
    return rounded(div.diversity(outputs, "sample_id", "embedding"), "diversity")


@query
def resumed_generation(spark, sf):
    """Generation that ends after one commit and is then continued: the records of one run."""

    def loader():
        return lambda prompts, n, **sampling: [
            [f"{len(p)} characters, sample {i}, top {sampling['top_k']}" for i in range(n)] for p in prompts
        ]

    path, raw = scratch_path(spark, "ledger"), tables.tldr_raw(spark, sf)
    how = {"batch_size": 32, "n_samples": 2, "top_k": 40, "min_new_tokens": 1, "max_new_tokens": 64}
    flows.generate_resumable(raw, "tldr", loader, path, batches_per_commit=2, max_commits=1, **how)
    made = flows.generate_resumable(raw, "tldr", loader, path, **how)
    return made.select("sample_id", F.array_join("outputs", " | ").alias("outputs"), F.size("references").cast("bigint").alias("n_references"))


@query
def generate_plugin(spark, sf):
    """A user's generator on the grouped prompts, two samples each."""

    def loader():
        return lambda prompts, n, **sampling: [
            [f"{len(p)} characters, sample {i}" for i in range(n)] for p in prompts
        ]

    made = flows.generate_records(tables.tldr_raw(spark, sf), "tldr", loader, n_samples=2)
    return made.select(
        "sample_id",
        F.array_join("outputs", " | ").alias("outputs"),
        F.size("references").cast("bigint").alias("n_references"),
    )


@query
def generate_in_context(spark, sf):
    """A generator that reads the last 256 prompt ids; its texts end at the stop mark."""

    def loader():
        return lambda ids, n, **sampling: [[f"{len(x)} ids, sample {i}<|im_end|>more" for i in range(n)] for x in ids]

    made = flows.generate_records(
        tables.tldr_raw(spark, sf), "tldr", loader, context_length=256, stop="<|im_end|>", n_samples=2
    )
    return made.select("sample_id", F.array_join("outputs", " | ").alias("outputs"))


@query
def clean_response(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select("doc_id", judging_fn.clean_response(F.col("text")).alias("cleaned"))


# --- training log ----------------------------------------------------------


@query
def train_interval_means(spark, sf):
    means = metrics.interval_means(tables.train_log(spark, sf), log_every=8)
    return rounded(means.withColumn("epoch", F.col("epoch").cast("bigint")), "value")


@query
def eval_batch_mean(spark, sf):
    log = tables.train_log(spark, sf)
    by_batch = metrics.eval_mean(log).withColumn("kind", F.lit("batch"))
    by_row = metrics.eval_mean(log, weighted=True).withColumn("kind", F.lit("row"))
    return rounded(by_batch.unionByName(by_row), "value")


@query
def rank_reduce(spark, sf):
    reduced = metrics.reduce_ranks(tables.train_log(spark, sf))
    key = metrics.metric_key(F.col("split"), F.col("metric"))
    return rounded(reduced.select("batch", key.alias("metric"), "value"), "value")


@query
def examples_seen(spark, sf):
    counters = metrics.examples_seen(tables.train_log(spark, sf))
    return counters.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("epoch", "batch", "n_examples", "examples_seen", "batches_seen", "update_steps")]
    )


@query
def throughput(spark, sf):
    speed = metrics.throughput(tables.train_log(spark, sf))
    return rounded(speed.select("batch", "n_examples", "examples_per_sec"), "examples_per_sec")


EVENT_METRICS = ["click", "error", "purchase", "signup", "view"]


@query
def metrics_json(spark, sf):
    path = scratch_path(spark, "metrics")
    records.write_metrics(tables.train_log(spark, sf), path, EVENT_METRICS)
    rows = records.read_metrics(spark, path, EVENT_METRICS)  # a row per step
    return rounded(rows.withColumn("epoch", F.col("epoch").cast("bigint")), *EVENT_METRICS)


# --- streaming -------------------------------------------------------------


@query
def stream_eval_stats(spark, sf):
    path = scratch_path(spark, "embedded")
    records.write_json(_embedded_records(spark, sf), path)
    stream = streams.read_stream(spark, path, schemas.EMBEDDED, files_per_trigger=4)
    stats = streams.latest(spark, streams.stream_eval_stats(stream), ["run"], "eval-stats")
    return rounded(stats, "mean", "std_err")


@query
def stream_win_stats(spark, sf):
    """Comparisons as they come in, every one of them twice."""
    path = scratch_path(spark, "compared")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("sample_id", F.lit(3600)))
    valid = _valid(spark, sf, 2).select(F.lit("r0").alias("run"), "sample_id", at.alias("ts"), "wins")
    for again in range(2):
        records.write_json(valid, f"{path}/again={again}")
    schema = "run string, sample_id bigint, ts timestamp, wins array<boolean>, again int"
    stream = streams.read_stream(spark, path, schema, files_per_trigger=4)
    stats = streams.latest(spark, streams.stream_win_stats(stream, 2, "1 day"), ["run"], "win-stats")
    return rounded(stats, "mean", "std_err", "min", "max")


@query
def stream_train_metrics(spark, sf):
    """Window means of whole cents, whose sums are exact in any order."""
    # A pattern, so that the table may be a file or a folder of files.
    stream = streams.read_stream(spark, f"{sf}/[e]vents.parquet", schemas.TABLES["events"], "parquet").select(
        F.lit("r0").alias("run"),
        F.lit("train").alias("split"),
        "ts",
        F.col("event_type").alias("metric"),
        F.round(F.col("value") * 100).alias("value"),
    )
    means = streams.stream_train_metrics(stream, "6 hours", "10 minutes")
    keys = ["run", "split", "window_start", "metric"]
    return streams.latest(spark, means, keys, "train-metrics").withColumnRenamed("value", "cents")
