"""Line-first quality rules (operator 1).

Every line is judged by itself - punctuation, navigation, boilerplate - and lines
that fail are removed; a document that loses more than half of its words'
characters, or fails the base rules, is rejected.  All counts are integers, so
the verdict is the same everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prefspark.llm.common import BLANKS, id_and_text

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    r"(?i)\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|"
    r"lorem ipsum|click here|sign up|log in|subscribe (now|to)|add to cart|skip to content)\b"
)
_BOILERPLATE = re.compile(BOILERPLATE)
#: A line may end in one of these; short lines must.
LINE_ENDS = ".!?…:;\"'”’»)]"
SHORT_LINE_WORDS = 8
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_failed_lines long, lost_chars long, clean_text string"
)


def word_characters(text: str) -> int:
    """Code points that are not blanks."""
    return len(text) - sum(map(text.count, BLANKS))


def line_fails(line: str) -> str:
    """'' for a good line, else the rule it breaks; ``line`` holds a word."""
    words = len(line.encode("utf-8", "surrogatepass").split())
    symbols = sum(map(line.count, SYMBOLS))
    if 3 * line.count("|") > words:
        return "navigation"
    if 3 * symbols > 2 * words or 2 * line.count("!") > words + 1:
        return "punctuation"
    if words < SHORT_LINE_WORDS and line.rstrip(BLANKS)[-1] not in LINE_ENDS:
        return "punctuation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    base = len(codes) + 1
    if base > 2_000_000:  # three codes no longer fit one integer: number the pairs first
        pairs, ranks = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        keys = ranks[:-1] * base + ids[2:]
    else:
        keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def judge(text: str) -> tuple:
    """All result columns of a text but its id."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = word_characters(text)
    lines = text.split("\n")
    full = [line for line in lines if line.strip(BLANKS)]
    failed = {line for line in set(full) if line_fails(line)}
    lost = sum(word_characters(line) for line in full if line in failed)
    n_failed = sum(line in failed for line in full)
    repeats = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * chars
    clean = "\n".join(line for line in lines if line not in failed) if failed else text
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, len(full) - len(set(full)), repeats, base_failed, kept, n_failed, lost, clean


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: the base counts, the verdicts and the cleaned text.

    Words are runs of characters other than blank and 0x09 to 0x0D.  Null and
    empty texts have no words and fail the base rules.  Each row is judged by
    itself: ties and repeated rows change nothing.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(judge, batch.column(1).to_pylist()))) or [[]] * 10
            if not with_text:
                columns = columns[:9]
            arrays = [batch.column(0)] + [
                pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()])
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = SCHEMA if with_text else SCHEMA.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(",")]
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)
