"""Log-probabilities from sharded logits: against the array form, on long sequences and odd input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prefspark.functions import logprob
from prefspark.operators import flow, logits, preference


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(4)
    rows = []
    for seq in range(30):
        n = draw.choice([1, 2, 5, 12])
        scale = draw.choice([1.0, 30.0, 900.0])
        first = draw.randint(0, n)
        labels = [-100 if i < first else draw.randrange(37) for i in range(n)]
        rows.append((seq, [[draw.uniform(-scale, scale) for _ in range(37)] for _ in range(n)], labels))
    return spark.createDataFrame(rows, "seq_id long, logits array<array<double>>, labels array<int>").repartition(3)


def by_key(df, *values):
    return {(r.seq_id, r.pos): tuple(r[v] for v in values) for r in df.collect()}


@pytest.mark.parametrize("size", [1, 10, 37, 1000])
def test_equals_the_array_form(model, size):
    for temperature in (0.7, 2.0):
        long = logits.slide_counted(logits.sharded_logps(logits.shard_logits(model, size), temperature, 5, 1.3))
        arrays = preference.token_logps(model, temperature=temperature, slide_mask=True)
        want = by_key(arrays.select("seq_id", F.posexplode(F.arrays_zip("logp", "mask")).alias("pos", "t")).select("seq_id", "pos", "t.*"), "logp", "mask")
        got = by_key(long, "logp", "counted", "end_logp")
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert all(math.isclose(got[k][0], v[0], rel_tol=1e-12, abs_tol=1e-12) for k, v in want.items() if v[1])
        ends = model.select("seq_id", F.posexplode("logits").alias("pos", "row")).select("seq_id", "pos", logprob.log_softmax_at(F.col("row"), F.lit(5), 1.3).alias("end"))
        ends = by_key(ends, "end")
        assert all(math.isclose(v[2], ends[k][0], rel_tol=1e-12, abs_tol=1e-12) for k, v in got.items())


def test_only_reduced_shards_are_exchanged(model):
    plan = logits.sharded_logps(logits.shard_logits(model, 10), 1.0, 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "partial_collect_list" in below and "Window" not in plan and "Join" not in plan
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "values" not in exchange


def test_one_long_sequence_is_spread(spark, monkeypatch):
    monkeypatch.setattr(logits, "LONG_SEQUENCE", 100)
    rows = spark.range(5000).select(F.lit(1).alias("seq_id"), F.col("id").alias("pos"), (F.col("id") >= 4000).alias("counted"))
    rows = rows.unionByName(spark.createDataFrame([(2, 0, True), (2, 1, True), (3, 0, False), (4, 0, False), (4, 1, True)], "seq_id int, pos long, counted boolean"))
    got = by_key(logits.slide_counted(rows), "counted")
    assert len(got) == 5005 and {k for k, v in got.items() if v[0]} == {(1, p) for p in range(3999, 5000)} | {(2, 0), (2, 1), (4, 0), (4, 1)}
    plan = logits.slide_counted(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Window" not in plan


def test_flow_scores_from_long_scores(model):
    shards = logits.shard_logits(model, 8)
    long = logits.sharded_logps(shards, 1.0, 5).withColumns({"pair_id": F.col("seq_id"), "side": F.lit("chosen")})
    policy = logits.slide_counted(long, ["pair_id", "side"])
    sequences = logits.flow_sequences(policy, long, ["pair_id", "side"])
    lengths = {r.pair_id: len(r.policy_logp) for r in sequences.collect()}
    assert lengths == {r.seq_id: len(r.labels) - 1 for r in model.collect() if len(r.labels) > 1}
    scores = flow.flow_scores(sequences).collect()
    assert len(scores) == len(lengths) and all(s.kl == 0 for s in scores)
    with pytest.raises(Exception, match="position of one model only"):
        logits.flow_sequences(policy, long.where("pos > 0"), ["pair_id", "side"]).collect()


def test_odd_input(spark):
    made = lambda *rows: spark.createDataFrame(list(rows), "seq_id long, logits array<array<double>>, labels array<int>")
    empty = logits.sharded_logps(logits.shard_logits(made(), 4))
    assert empty.count() == 0 and logits.sharded_logps(logits.shard_logits(made((1, [[0.0]], [0]), (2, None, None)), 4)).count() == 0
    with pytest.raises(Exception, match="the label is found 0 times"):
        logits.sharded_logps(logits.shard_logits(made((1, [[0.0, 1.0], [0.0, 1.0]], [0, 2])), 1)).collect()
    with pytest.raises(Exception, match="rows of logits, labels"):
        logits.shard_logits(made((1, [[0.0, 1.0]], [0, 1])), 1).collect()
    doubled = logits.shard_logits(made((1, [[0.0, 1.0], [0.0, 1.0]], [0, 1])), 2)
    with pytest.raises(Exception, match="found 2 times"):
        logits.sharded_logps(doubled.unionByName(doubled)).collect()
    with pytest.raises(ValueError):
        logits.sharded_logps(doubled, temperature=0)
