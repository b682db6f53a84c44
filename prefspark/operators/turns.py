"""Preference examples from a table with one row per conversation turn.

Whole conversations stay one row per message here: a conversation may hold any
share of the table, so it is never gathered.  Where an example row is wanted
(encoding), the messages that can still matter after truncation are gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chat
from ..session import materialize
from . import encoding
from .heavy import with_summary
from .numbering import running_sums

# Turns above which a conversation's join is spread over tasks; the rows are the same.
LONG_CONVERSATION = 4096


def spans(turns: DataFrame) -> DataFrame:
    """Per conversation: its first turn, first and last assistant turn, their number.

    Integers only, so this is a hash aggregate with map-side partial results.
    """
    answered = F.when(F.col("role") == "assistant", F.col("turn"))
    return turns.groupBy("conv_id").agg(
        F.min("turn").alias("start_turn"),
        F.min(answered).alias("first_turn"),
        F.max(answered).alias("last_turn"),
        F.count(answered).alias("answers"),
    )


def with_spans(turns: DataFrame, needed: int) -> DataFrame:
    """Turns of conversations with ``needed`` answers, with the conversation's spans."""
    enough = F.col("answers") >= needed
    return with_summary(
        turns, ["conv_id"], lambda t: spans(t).where(enough), "turn", LONG_CONVERSATION
    )


def messages(turns: DataFrame, kind: str) -> DataFrame:
    """Long form of the ``hh`` adapters: ``row_idx, side, pos, role, content, opens``.

    ``pos`` is the turn number, so messages need no renumbering; ``opens`` marks
    the conversation's first message.  Kinds: ``paired`` (two answers needed),
    ``unpaired``, ``prompt`` (sides ``history`` and ``reference``).  The last
    assistant turn is the chosen answer, the first one the rejected answer.
    """
    needed = 2 if kind == "paired" else 1
    marked = with_spans(turns, needed)
    turn, first, last = F.col("turn"), F.col("first_turn"), F.col("last_turn")

    def place(side: str, pos):
        return F.struct(F.lit(side).alias("side"), pos.alias("pos"))

    if kind == "paired":
        places = [
            F.when(turn <= last, place("chosen", turn)),
            F.when(turn < last, place("rejected", turn)),
            F.when(turn == first, place("rejected", last)),
        ]
    elif kind == "unpaired":
        places = [F.when(turn <= last, place("chosen", turn))]
    elif kind == "prompt":
        places = [
            F.when(turn < last, place("history", turn)),
            F.when(turn == last, place("reference", turn)),
        ]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return marked.select(
        F.col("conv_id").alias("row_idx"),
        F.explode(F.array_compact(F.array(*places))).alias("at"),
        chat.map_role(_raw_role(F.col("role"))).alias("role"),
        F.col("text").alias("content"),
        "start_turn",
    ).select(
        "row_idx",
        "at.side",
        "at.pos",
        "role",
        "content",
        (F.col("at.pos") == F.col("start_turn")).alias("opens"),
    )


def histories(turns: DataFrame, needed: int = 2) -> DataFrame:
    """Whole histories of the examples of ``example_rows``, a row per message: ``row_idx, pos, role, content``."""
    before = with_spans(turns, needed).where(F.col("turn") < F.col("last_turn"))
    role = chat.map_role(_raw_role(F.col("role")))
    return before.select(F.col("conv_id").alias("row_idx"), F.col("turn").alias("pos"), role.alias("role"), F.col("text").alias("content"))


def _raw_role(role: Column) -> Column:
    """The corpus calls the user ``human``."""
    return F.when(role == "user", "human").otherwise(role)


def example_rows(
    turns: DataFrame,
    max_prompt_length: int | None = None,
    needed: int = 2,
    loader: Callable | None = None,
    template: str = "chatml",
) -> DataFrame:
    """``hh`` raw rows (``row_idx, context, chosen, rejected``) of conversations with ``needed`` answers.

    ``context`` holds the messages before the last answer.  With a
    ``max_prompt_length`` it holds, for every conversation alike, those that the
    last so many tokens of the prompt can reach: each message's tokens are
    counted with the tokenizer in its own row, and a message stays while those
    after it are fewer.  One token per message is not counted, as texts may fuse
    where they meet.  Such rows are marked by ``context_cut``, and what is encoded
    from them has no ``history``: that is ``histories``, by ``row_idx``.
    """
    marked = with_spans(turns, needed).where(F.col("turn") <= F.col("last_turn"))
    if max_prompt_length is None:
        return _gather(marked)
    message = chat.message(chat.map_role(_raw_role(F.col("role"))), F.col("text"))
    size = encoding.token_counts(chat.render(F.array(message), template), loader)
    before = F.col("turn") < F.col("last_turn")
    sized = marked.select(
        "conv_id", (-F.col("turn")).alias("back"), F.when(before, F.greatest(size - 1, F.lit(0))).otherwise(0).alias("n")
    )
    # Three numbers a message, stored, as the sums read them for the cells, the offsets and the rows.
    sized = materialize(sized, "message-sizes")
    upto = running_sums(sized, "back", {"upto": F.col("n")}, ["conv_id"])
    reached = upto.where(F.col("upto") - F.col("n") < max_prompt_length).select("conv_id", (-F.col("back")).alias("turn"))
    kept = marked.join(reached, ["conv_id", "turn"], "left_semi")
    # The first answer is the rejected one; it may lie before all that is reached.
    opening = marked.where(F.col("turn") == F.col("first_turn")).join(reached, ["conv_id", "turn"], "left_anti")
    rows = _gather(kept.withColumn("shown", F.lit(True)).unionByName(opening.withColumn("shown", F.lit(False))))
    return rows.withColumn("context_cut", F.lit(True))


def _gather(turns: DataFrame) -> DataFrame:
    shown = F.col("shown") if "shown" in turns.columns else F.lit(True)
    turn, last = F.col("turn"), F.col("last_turn")
    context = F.sort_array(
        F.collect_list(F.when(shown & (turn < last), F.struct("turn", _raw_role(F.col("role")).alias("role"), "text")))
    )
    pick = lambda at: F.struct(F.max(F.when(turn == F.col(at), F.col("text"))).alias("text"))
    return turns.groupBy(F.col("conv_id").alias("row_idx")).agg(
        F.transform(context, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("context"),
        pick("last_turn").alias("chosen"),
        pick("first_turn").alias("rejected"),
    )
