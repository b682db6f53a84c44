"""Raw preference corpora to paired / unpaired / prompt-only examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chat

_ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_adapter(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Make ``fn`` available to ``adapt`` under ``name``."""
    _ADAPTERS[name] = fn


def adapt(df: DataFrame, name: str) -> DataFrame:
    if name not in _ADAPTERS:
        raise ValueError(f"unknown adapter {name!r}; known: {sorted(_ADAPTERS)}")
    return _ADAPTERS[name](df)


def key_columns(df: DataFrame) -> list[str]:
    """The columns that identify an example and, once assigned, its batch; and the mark of a cut context."""
    return [c for c in ("row_idx", "batch_id", "context_cut") if c in df.columns]


def _context(task: str) -> Column:
    if task == "hh":
        return chat.map_roles(F.col("context"))
    if task == "tldr":
        return F.array(chat.message("user", F.col("prompt")))
    raise ValueError(f"unknown task {task!r}")


def _answer(task: str, side: str) -> Column:
    text = F.col(side)["text"] if task == "hh" else F.col(side)
    return F.array(chat.message("assistant", text))


def to_unpaired(df: DataFrame, task: str) -> DataFrame:
    """``chosen``: the conversation ending in the chosen answer."""
    chosen = F.concat(_context(task), _answer(task, "chosen"))
    return df.select(*key_columns(df), chosen.alias("chosen"))


def to_paired(df: DataFrame, task: str) -> DataFrame:
    """``chosen`` and ``rejected``: same conversation, two endings."""
    context = _context(task)
    return df.select(
        *key_columns(df),
        F.concat(context, _answer(task, "chosen")).alias("chosen"),
        F.concat(context, _answer(task, "rejected")).alias("rejected"),
    )


def to_prompt_only(df: DataFrame, task: str, template: str = "chatml", **marks) -> DataFrame:
    """``prompt`` with the generation cue, ``history`` and ``references``.

    ``tldr`` expects the rows of ``group_references``; ``hh`` has one
    reference per prompt.  Needs whole contexts.
    """
    if "context_cut" in df.columns:
        raise ValueError("a cut context is not the history; use example_rows without max_prompt_length")
    history = _context(task)
    references = F.array(F.col("chosen")["text"]) if task == "hh" else F.col("references")
    part = F.col("part") if "part" in df.columns else F.lit(0)
    return df.select(
        F.col("row_idx").alias("sample_id"),
        part.cast("int").alias("part"),
        chat.render(history, template, add_generation_prompt=True, **marks).alias("prompt"),
        history.alias("history"),
        *[F.col(c) for c in ("references_from",) if c in df.columns],
        references.alias("references"),
    )


for _task in ("hh", "tldr"):
    register_adapter(f"{_task}_unpaired", lambda df, t=_task: to_unpaired(df, t))
    register_adapter(f"{_task}_paired", lambda df, t=_task: to_paired(df, t))
    register_adapter(f"{_task}_prompt_only", lambda df, t=_task: to_prompt_only(df, t))
