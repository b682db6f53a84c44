"""Token ids, truncation and labels on ``array<int>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .rand import bits32


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def hashed(tokens: Column, vocab_size: int = 50_000) -> Column:
    """A stable id per token."""
    return F.transform(tokens, lambda t: F.pmod(bits32(F.md5(t)), F.lit(vocab_size)).cast("int"))


def hashed_ids(text: Column, vocab_size: int = 50_000) -> Column:
    """Default tokenizer: a stable id per token, no vocabulary table needed."""
    return hashed(words(text), vocab_size)


def ones_like(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def keep_last(ids: Column, k: int) -> Column:
    """Last ``k`` ids, or all of a shorter list (prompt side)."""
    return F.slice(ids, F.greatest(F.size(ids) - F.lit(k - 1), F.lit(1)), F.lit(k))


def keep_first(ids: Column, budget: Column) -> Column:
    """First ``budget`` ids (response side)."""
    return F.slice(ids, F.lit(1), budget)


def labels_for(prompt_ids: Column, response_ids: Column) -> Column:
    """Prompt positions are ignored, response positions carry their id."""
    return F.concat(F.array_repeat(F.lit(fixed.IGNORE_LABEL), F.size(prompt_ids)), response_ids)


def pad(values: Column, filler, to_length: Column, side: str) -> Column:
    fill = F.array_repeat(F.lit(filler), to_length - F.size(values))
    return F.concat(values, fill) if side == "right" else F.concat(fill, values)
