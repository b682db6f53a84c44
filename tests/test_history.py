"""Histories of examples whose contexts are cut for encoding."""

import pytest
from pyspark.sql import functions as F

from prefspark import schemas
from prefspark.operators import adapters, encoding, turns


def test_no_history_lacks_messages(spark):
    """A conversation longer than the prompt budget: the whole history by key, none in the encoded row."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"w{t}") for t in range(40)] + [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "r"), (2, 3, "assistant", "b")]
    talk = spark.createDataFrame(rows, schemas.TABLES["conversations"]).repartition(3)
    encode = lambda raw: encoding.encode(adapters.adapt(raw, "hh_paired"), ["chosen", "rejected"], 6, 12)
    whole, reduced = encode(turns.example_rows(talk)), encode(turns.example_rows(talk, 6))
    long = turns.histories(talk).groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("m"))
    history = long.select("row_idx", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))
    assert "history" not in reduced.columns
    both = reduced.join(history, "row_idx").select(*whole.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(ValueError):
        adapters.adapt(turns.example_rows(talk, 6), "hh_prompt_only")
