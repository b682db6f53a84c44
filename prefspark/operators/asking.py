"""Ask a model once per distinct text, ever: its answers are kept and joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..sources.ledger import Ledger


def answers_of(df: DataFrame, text: str, ask: Callable[[DataFrame], DataFrame], ledger: Ledger, batches: int = 1) -> DataFrame:
    """``digest, answer`` of every distinct text of a column, asking only for new ones.

    ``ask`` maps ``digest, text`` to ``digest, answer``, in the schema of the
    ledger.  Texts whose digest the ledger holds do not reach it.  The others go
    in ``batches`` parts of the digest's range, each committed by itself, so a run
    that is killed loses at most the part it was in.  A NULL text is not asked.
    """
    if batches < 1:
        raise ValueError("batches must be positive")
    ledger.clear_unfinished()
    texts = df.where(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("digest"), F.col(text).alias("text"))
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") * F.lit(batches) / F.lit(2**32))
    for i in range(batches):
        new = texts.where(part == i) if batches > 1 else texts
        # Copies meet as one row per task before anything is shuffled.
        once = new.groupBy("digest").agg(F.first("text").alias("text"))
        open_ = once.join(ledger.read().select("digest"), "digest", "left_anti")
        ledger.append(ask(open_).select("digest", "answer"))
    return ledger.read()


def ask_once(
    df: DataFrame, text: str, ask: Callable[[DataFrame], DataFrame], ledger: Ledger, name: str = "answer", batches: int = 1
) -> DataFrame:
    """Add the model's answer to every row's text; see ``answers_of``.

    All rows and columns stay; a NULL text has a NULL answer.
    """
    known = answers_of(df, text, ask, ledger, batches)
    own = F.sha2(df[text].cast("binary"), 256) == known["digest"]
    return df.join(known, own, "left").select(*[df[c] for c in df.columns], known["answer"].alias(name))
