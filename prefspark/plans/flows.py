"""The three end-to-end flows: training data, generation, evaluation."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import adapters, diversity, encoding, grouping, judging, numbering, plugins
from ..session import materialize, shuffle_partitions, task_slots
from ..sources.ledger import Ledger


def training_batches(
    raw: DataFrame,
    task: str,
    paired: bool = True,
    batch_size: int = 16,
    max_prompt_length: int = 384,
    max_length: int = 768,
    pad_id: int = 0,
    seed=None,
    loader=None,
) -> DataFrame:
    """Raw rows to padded, labelled batches (shuffled when a seed is given).

    Batches are assigned on the raw rows, where counting reads the key alone.
    """
    sides = ["chosen", "rejected"] if paired else ["chosen"]
    batched = numbering.assign_batches(raw, batch_size, "row_idx", seed)
    examples = adapters.adapt(batched, f"{task}_{'paired' if paired else 'unpaired'}")
    encoded = encoding.encode(examples, sides, max_prompt_length, max_length, loader=loader)
    return encoding.pad_batches(encoding.build_labels(encoded, sides), sides, pad_id)


def prompt_batches(
    raw: DataFrame,
    task: str,
    batch_size: int = 16,
    max_prompt_length: int = 384,
    max_length: int = 768,
    pad_id: int = 0,
    loader=None,
) -> DataFrame:
    """Prompts alone, padded on the left, in order."""
    batched = numbering.assign_batches(raw, batch_size, "row_idx")
    examples = adapters.adapt(batched, f"{task}_unpaired")
    encoded = encoding.encode(examples, [], max_prompt_length, max_length, loader=loader)
    prompts = encoded.select(
        "row_idx",
        "batch_id",
        *[c for c in ("history",) if c in encoded.columns],
        "reference_response",
        F.col("prompt_ids").alias("prompt_input_ids"),
        F.col("prompt_mask").alias("prompt_attention_mask"),
    )
    return encoding.pad_batches(prompts, ["prompt"], pad_id, side="left")


def generate_records(
    raw: DataFrame, task: str, loader, context_length: int | None = None, stop: str | None = None, tokenizer=None, **sampling
) -> DataFrame:
    """Prompt-only rows through the user's generator to hand-over records.

    With a ``context_length`` the generator reads the last so many ids of each
    prompt instead of its text; a text ends before the first ``stop`` mark in it.
    The generator runs once: its texts are stored before they are joined back.
    """
    source = grouping.group_references(raw) if task == "tldr" else raw
    prompts = adapters.adapt(source, f"{task}_prompt_only")
    column = "prompt"
    asked = prompts
    if context_length is not None:
        asked, column = encoding.encode_prompts(prompts, context_length, tokenizer), "prompt_ids"
    outputs = plugins.generate(asked, loader, column=column, **sampling)
    if stop is not None:
        outputs = outputs.withColumn("output", F.substring_index("output", stop, 1))
    return grouping.generation_records(prompts, materialize(outputs, "outputs"))


#: What a generation ledger holds.
OUTPUTS = "sample_id bigint, output_idx bigint, output string, settings string"


def _leading(keys: DataFrame, key: str, share: float) -> Column:
    """A condition on ``key`` that holds for the first ``share`` of the keys in order and about a hundredth more."""
    error = 1 / 256
    last = keys.approxQuantile(key, [min(1.0, share + 2 * error)], error)
    return F.col(key).isNull() | (F.col(key) <= F.lit(last[0] if last else None))


def generate_resumable(
    raw: DataFrame,
    task: str,
    loader,
    path: str,
    batch_size: int = 256,
    batches_per_commit: int = 100,
    max_commits: int | None = None,
    context_length: int | None = None,
    stop: str | None = None,
    tokenizer=None,
    **sampling,
) -> DataFrame:
    """``generate_records`` that keeps what is finished in the ledger at ``path``.

    Batches of prompts are generated in order, ``batches_per_commit`` of them at
    a time, and each such commit is kept in full or not at all.  A run that was
    killed, or ended after ``max_commits``, is continued by calling this again:
    prompts in the ledger do not reach the model again, only those of the commit
    that was not finished do.  New prompts are added the same way.  The records
    are those of one undisturbed run, as far as the ledger has come.  Going on
    with other sampling settings is an error.
    """
    if batches_per_commit < 1:
        raise ValueError("batches_per_commit must be positive")
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    spark = raw.sparkSession
    ledger = Ledger(spark, path, OUTPUTS)
    ledger.clear_unfinished()
    settings = json.dumps({**sampling, "context_length": context_length, "stop": stop}, sort_keys=True)
    other = ledger.read().where(F.col("settings") != settings).select("settings").head()
    if other is not None:
        raise ValueError(f"the ledger at {path} was made with {other.settings}, not {settings}")
    source = grouping.group_references(raw) if task == "tldr" else raw
    prompts = adapters.adapt(source, f"{task}_prompt_only")
    column, asked = "prompt", prompts
    if context_length is not None:
        asked, column = encoding.encode_prompts(prompts, context_length, tokenizer), "prompt_ids"
    heads = (asked.where("part = 0") if "part" in asked.columns else asked).select("sample_id", column)
    missing = heads.join(ledger.read().select("sample_id").distinct(), "sample_id", "left_anti")
    # Ids alone say how many commits there are; texts are moved once, and only those that are asked now.
    ids = materialize(missing.select("sample_id"), "missing-ids")
    rows, of_commit = ids.count(), batch_size * batches_per_commit
    commits = -(-rows // of_commit)
    if max_commits is not None:
        commits = max(0, min(commits, max_commits))
    if commits == 0:
        return grouping.generation_records(prompts, ledger.read().drop("settings"))
    if commits * of_commit < rows:
        first = _leading(ids, "sample_id", commits * of_commit / rows)
        if ids.where(first).count() >= commits * of_commit:
            missing, ids = missing.where(first), ids.where(first)
    # As many tasks as can run at once, with as many batches each.
    tasks = min(batches_per_commit, shuffle_partitions(spark), task_slots(spark))
    numbered = numbering.assign_batches(missing, batch_size, "sample_id", keys=ids)
    numbered = numbered.withColumn("_commit", F.floor(F.col("batch_id") / batches_per_commit).cast("bigint"))
    # A folder for each commit, so that a commit reads its own prompts and not all that are missing.
    todo = materialize(numbered.where(F.col("_commit") < commits), "to-generate", by="_commit")

    def outputs_of(at: int) -> DataFrame:
        part = todo.where(F.col("_commit") == at).drop("_commit")
        # A batch stays in one task.
        dealt = part.repartitionById(tasks, F.pmod("batch_id", F.lit(tasks)).cast("int")).sortWithinPartitions("batch_id", "sample_id")
        outputs = plugins.generate(dealt, loader, column=column, batch_size=batch_size, **sampling)
        if stop is not None:
            outputs = outputs.withColumn("output", F.substring_index("output", stop, 1))
        return outputs.withColumn("settings", F.lit(settings))

    # While a commit is generated the next one is planned, but not begun.
    with ThreadPoolExecutor(1) as ahead:
        coming = ahead.submit(outputs_of, 0)
        for at in range(commits):
            outputs = coming.result()
            if at + 1 < commits:
                coming = ahead.submit(outputs_of, at + 1)
            ledger.append(outputs)
    return grouping.generation_records(prompts, ledger.read().drop("settings"))


def output_rows(records: DataFrame) -> DataFrame:
    """One row per generated text of the hand-over records."""
    each = records.select("sample_id", "outputs_from", F.posexplode("outputs").alias("at", "output"))
    return each.select("sample_id", (F.col("outputs_from") + F.col("at")).alias("output_idx"), "output")


def diversity_report(records: DataFrame, loader) -> DataFrame:
    """Mean diversity and standard error over the samples."""
    vectors = plugins.embed(output_rows(records), "output", loader)
    return diversity.mean_std_err(diversity.diversity(vectors, "sample_id", "embedding"), "diversity")


def win_rate_report(
    records: DataFrame,
    completions,
    task: str = "hh",
    mode: str | None = None,
    n: int = 1,
    samples: int = 300,
    seed: int = 0,
) -> DataFrame:
    """Win rate over the first ``samples`` valid comparisons.

    ``completions`` maps requests to a completion table; it gets them in rounds,
    until there are enough valid ones (``judging.judge_until``).
    """
    requests = materialize(judging.judge_requests(records, task, mode, n, seed), "requests")
    return judging.win_summary(judging.judge_until(requests, completions, task, n, samples, seed))
