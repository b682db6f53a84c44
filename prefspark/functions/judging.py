"""Judge prompts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def judge_prompt(history: Column, first: Column, second: Column, task: str, mode: str | None) -> Column:
    """Question to the judge about answers A (first) and B (second).

    Without a message to quote, the query is empty.
    """
    if (task, mode if task == "tldr" else None) not in fixed.JUDGE_WORDING:
        raise ValueError(f"no judge wording for task {task!r}, mode {mode!r}")
    opening, before_a, before_b, closing = fixed.JUDGE_WORDING[
        (task, mode if task == "tldr" else None)
    ]
    if task == "hh":
        last = F.try_element_at(history, F.lit(-1))
        query = F.concat(F.upper(last["role"]), F.lit(": "), last["content"], F.lit("\n"))
    else:
        query = F.try_element_at(history, F.lit(1))["content"]
    query = F.coalesce(query, F.lit(""))
    return F.concat(
        F.lit(opening), query, F.lit(before_a), first, F.lit(before_b), second, F.lit(closing)
    )


def verdict(completion: Column, task: str) -> Column:
    """Lower-cased verdict letter, '' where the completion states none."""
    return F.lower(F.regexp_extract(completion, fixed.VERDICT_PATTERN[task], 2))


def vote(letter: Column, response_is_a: Column) -> Column:
    """Did the generated response win?  NULL for other letters."""
    return F.when(letter == "a", response_is_a).when(letter == "b", ~response_is_a)


def clean_response(text: Column) -> Column:
    """Text up to its last sentence mark; unchanged if it has none."""
    cut = F.regexp_extract(text, fixed.SENTENCE_PREFIX, 1)
    return F.when(cut == "", text).otherwise(cut)
