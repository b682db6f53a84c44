"""Examples to token ids, truncated, labelled, padded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import chat, fixed, tokens
from .adapters import key_columns

Tokenizer = Callable[[list[str]], list[list[int]]]


def token_ids(text: Column, loader: Callable[[], Tokenizer] | None = None, vocab_size: int = 50_000) -> Column:
    """Ids of a text column.

    Without ``loader`` the default hashed tokenizer stays in the JVM.  With it,
    ``loader()`` runs once per Python worker batch stream and returns a function
    from texts to id lists (no special tokens added).
    """
    if loader is None:
        return tokens.hashed_ids(text, vocab_size)

    @pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = loader()
        for batch in batches:
            yield pd.Series([list(ids) for ids in tokenizer(batch.fillna("").tolist())], dtype=object)

    return run(text)


def tokenize(
    df: DataFrame,
    columns: dict[str, str],
    loader: Callable[[], Tokenizer] | None = None,
    vocab_size: int = 50_000,
) -> DataFrame:
    """Add id lists: ``columns`` maps a text column to the name of its ids."""
    return df.withColumns(
        {name: token_ids(F.col(text), loader, vocab_size) for text, name in columns.items()}
    )


def token_counts(text: Column, loader: Callable[[], Tokenizer] | None = None) -> Column:
    """Number of ids of a text column."""
    return F.size(tokens.words(text) if loader is None else token_ids(text, loader))


def _tokenize_cut(
    df: DataFrame,
    columns: dict[str, str],
    cut: Callable[[DataFrame], DataFrame],
    loader: Callable[[], Tokenizer] | None,
    vocab_size: int,
) -> DataFrame:
    """``tokenize``, then ``cut``; ids of the default tokenizer are made only of tokens that stay."""
    if loader is not None:
        return cut(tokenize(df, columns, loader, vocab_size))
    split = cut(df.withColumns({name: tokens.words(F.col(text)) for text, name in columns.items()}))
    return split.withColumns({name: tokens.hashed(F.col(name), vocab_size) for name in columns.values()})


def truncate(
    df: DataFrame, sides: list[str], max_prompt_length: int = 384, max_length: int = 768
) -> DataFrame:
    """Cut ``prompt_ids`` from the left and every ``<side>_ids`` from the right.

    All sides of an example share the budget ``max_length - kept prompt``.
    """
    if not 1 <= max_prompt_length <= max_length:
        raise ValueError("need 1 <= max_prompt_length <= max_length")
    kept = df.withColumn("prompt_ids", tokens.keep_last(F.col("prompt_ids"), max_prompt_length))
    budget = F.lit(max_length) - F.size("prompt_ids")
    return kept.withColumns(
        {f"{s}_ids": tokens.keep_first(F.col(f"{s}_ids"), budget) for s in sides}
    )


def encode_prompts(
    prompts: DataFrame,
    context_length: int,
    loader: Callable[[], Tokenizer] | None = None,
    vocab_size: int = 50_000,
) -> DataFrame:
    """Add ``prompt_ids``: the last ``context_length`` ids of the prompt text."""
    if context_length < 1:
        raise ValueError("context_length must be positive")
    last = lambda df: df.withColumn("prompt_ids", tokens.keep_last(F.col("prompt_ids"), context_length))
    return _tokenize_cut(prompts, {"prompt": "prompt_ids"}, last, loader, vocab_size)


def split_examples(df: DataFrame, sides: list[str]) -> DataFrame:
    """``history`` and the answer messages of every side."""
    history = chat.history_of(F.col("chosen"))
    answers = {"chosen": F.array(chat.response_of(F.col("chosen")))}
    if "rejected" in sides:
        answers["rejected"] = chat.tail_after(F.col("rejected"), history)
    return df.select(
        *key_columns(df),
        history.alias("history"),
        chat.response_of(F.col("chosen"))["content"].alias("reference_response"),
        *[answers[s].alias(f"{s}_answer") for s in sides],
    )


def encode(
    df: DataFrame,
    sides: list[str],
    max_prompt_length: int = 384,
    max_length: int = 768,
    template: str = "chatml",
    loader: Callable[[], Tokenizer] | None = None,
    vocab_size: int = 50_000,
    **marks,
) -> DataFrame:
    """Examples to truncated prompt and answer ids with their masks.

    ``sides=[]`` encodes the prompt alone (generation).  Rows with ``context_cut``
    have no ``history``, as it would lack messages; ``turns.histories`` has it.
    """
    split = split_examples(df, sides)
    prompt = chat.render(F.col("history"), template, add_generation_prompt=True, **marks)
    texts = split.withColumns(
        {"_prompt": prompt}
        | {f"_{s}": chat.render(F.col(f"{s}_answer"), template, **marks) for s in sides}
    )
    names = {"_prompt": "prompt_ids"} | {f"_{s}": f"{s}_ids" for s in sides}
    cut = _tokenize_cut(texts, names, lambda df: truncate(df, sides, max_prompt_length, max_length), loader, vocab_size)
    return cut.select(
        *[c for c in key_columns(cut) if c != "context_cut"],
        *([] if "context_cut" in cut.columns else ["history"]),
        "reference_response",
        "prompt_ids",
        tokens.ones_like(F.col("prompt_ids")).alias("prompt_mask"),
        *[F.col(f"{s}_ids") for s in sides],
        *[tokens.ones_like(F.col(f"{s}_ids")).alias(f"{s}_mask") for s in sides],
    )


def build_labels(df: DataFrame, sides: list[str]) -> DataFrame:
    """Per side: ids and mask of prompt + answer, labels that skip the prompt."""
    made = {}
    for s in sides:
        made[f"{s}_input_ids"] = F.concat("prompt_ids", f"{s}_ids")
        made[f"{s}_attention_mask"] = F.concat("prompt_mask", f"{s}_mask")
        made[f"{s}_labels"] = tokens.labels_for(F.col("prompt_ids"), F.col(f"{s}_ids"))
    kept = [c for c in df.columns if not c.endswith(("_ids", "_mask"))]
    return df.select(*kept, *[c.alias(n) for n, c in made.items()])


def pad_batches(
    df: DataFrame, sides: list[str], pad_id: int, side: str = "right", batch: str = "batch_id"
) -> DataFrame:
    """Pad every row to the longest row of its batch, over all sides.

    Batches have a fixed size, so the window holds that many rows at most.
    """
    if side not in ("right", "left"):
        raise ValueError("side must be 'right' or 'left'")
    longest = F.greatest(*[F.size(f"{s}_input_ids") for s in sides], F.lit(0))
    sized = df.withColumn("padded_length", F.max(longest).over(Window.partitionBy(batch)))
    fillers = {"input_ids": pad_id, "attention_mask": 0, "labels": fixed.IGNORE_LABEL}
    padded = {
        f"{s}_{field}": tokens.pad(F.col(f"{s}_{field}"), filler, F.col("padded_length"), side)
        for s in sides
        for field, filler in fillers.items()
        if f"{s}_{field}" in df.columns
    }
    return sized.withColumns(padded)
