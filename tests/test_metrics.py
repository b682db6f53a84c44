"""Training-log aggregates and the streaming summaries."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prefspark import schemas
from prefspark.operators import diversity as div
from prefspark.operators import metrics
from prefspark.sources import records
from prefspark.streaming import metrics as streams

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("r", b // 10, b, rank, "train", "loss", float(b + rank), 16 - rank, START + timedelta(seconds=b))
        for b in range(25)
        for rank in range(2)
    ]
    return spark.createDataFrame(rows, schemas.TRAIN_LOG).repartition(6)


def test_reduce_ranks(log):
    sums = {r["batch"]: r["value"] for r in metrics.reduce_ranks(log).collect()}
    assert sums == {b: 2 * b + 1.0 for b in range(25)}
    means = {r["batch"]: r["value"] for r in metrics.reduce_ranks(log, "avg").collect()}
    assert means[3] == 3.5
    with pytest.raises(ValueError):
        metrics.reduce_ranks(log, "max")


def test_intervals_follow_the_logging_loop(log):
    every, kept, expected = 4, [], {}
    for b in range(25):
        if b % 10 == 0:
            kept = []
        kept.append(2 * b + 1.0)
        if b % every == 0:
            expected[b] = sum(kept) / len(kept)
            kept = []
    got = metrics.interval_means(log, every).collect()
    assert {r["batch"]: r["value"] for r in got} == expected
    assert {r["metric"] for r in got} == {"train/loss"}


def test_eval_mean_weighs_batches_equally(spark):
    rows = [("r", 0, 0, 0, "eval", "loss", 1.0, 1, START)] * 3 + [("r", 0, 1, 0, "eval", "loss", 5.0, 1, START)]
    df = spark.createDataFrame(rows, schemas.TRAIN_LOG)
    assert metrics.eval_mean(df).head()["value"] == 3.0
    assert metrics.eval_mean(df, weighted=True).head()["value"] == 2.0


def test_counters(log):
    rows = {r["batch"]: r for r in metrics.examples_seen(log).collect()}
    for b in range(25):
        assert rows[b]["n_examples"] == 31
        assert (rows[b]["examples_seen"], rows[b]["batches_seen"], rows[b]["update_steps"]) == (31 * b, b, b + 1)


def test_counters_per_run(log):
    two = log.unionByName(log.where("batch < 5").withColumn("run", F.lit("s")))
    rows = metrics.examples_seen(two).where("run = 's'").collect()
    assert sorted(r["examples_seen"] for r in rows) == [31 * b for b in range(5)]


def test_throughput(spark):
    rows = [
        ("r", 0, 0, 0, "train", "loss", 1.0, 8, START),
        ("r", 0, 0, 0, "train", "kl", 1.0, 8, START + timedelta(seconds=2)),
        ("r", 0, 1, 0, "train", "loss", 1.0, 8, START),
    ]
    got = metrics.throughput(spark.createDataFrame(rows, schemas.TRAIN_LOG)).collect()
    assert {r["batch"]: r["examples_per_sec"] for r in got} == {0: 4.0, 1: None}


def test_throughput_of_batches_with_one_time_stamp(spark):
    rows = [("r", 0, b, 0, "train", "loss", 1.0, 8, START + timedelta(seconds=s)) for b, s in enumerate((0, 2, 6))]
    got = metrics.throughput(spark.createDataFrame(rows, schemas.TRAIN_LOG)).collect()
    assert {r["batch"]: r["examples_per_sec"] for r in got} == {0: None, 1: 4.0, 2: 2.0}


def test_metrics_json(spark, log, tmp_path):
    records.write_metrics(log, str(tmp_path / "m"), ["loss", "kl"])
    rows = records.read_metrics(spark, str(tmp_path / "m"), ["loss", "kl"]).orderBy("epoch", "batch").collect()
    steps = {}
    for r in log.where("metric = 'loss'").collect():
        steps.setdefault((r["epoch"], r["batch"]), []).append(r["value"])
    assert [(r["epoch"], r["batch"]) for r in rows] == sorted(steps)
    assert [r["loss"] for r in rows] == [sum(v) / len(v) for _, v in sorted(steps.items())]
    assert rows[0]["kl"] is None


def test_stream_eval_stats_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a" if i % 3 else "b", i, [[1.0, i / 10], [0.5, 1.0], [i / 7, 0.2]]) for i in range(30)]
    df = spark.createDataFrame(rows, schemas.EMBEDDED)
    df.repartition(6).write.json(path)
    stream = streams.read_stream(spark, path, schemas.EMBEDDED, files_per_trigger=1)
    got = streams.latest(spark, streams.stream_eval_stats(stream), ["run"], "stats").collect()
    scored = div.row_diversity(df, "vectors")
    for r in got:
        batch = div.mean_std_err(scored.where(F.col("run") == r["run"]), "diversity").head()
        assert (r["n"], r["mean"], r["std_err"]) == pytest.approx(tuple(batch))
    assert {r["run"] for r in got} == {"a", "b"}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out, place = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = lambda lo, hi: spark.createDataFrame(
        [("a", i, [[1.0, float(i)], [1.0, 0.0]]) for i in range(lo, hi)], schemas.EMBEDDED
    )
    for lo, hi in ((0, 5), (5, 9)):
        rows(lo, hi).write.mode("append").json(path)
        stream = streams.read_stream(spark, path, schemas.EMBEDDED)
        state = streams.latest(spark, streams.stream_eval_stats(stream), ["run"], "s", out, place)
        assert state.head()["n"] == hi


def test_stream_drops_late_rows(spark, tmp_path):
    path = tmp_path / "log"
    schema = "run string, split string, ts timestamp, metric string, value double"
    at = lambda minutes: START + timedelta(minutes=minutes)
    files = [
        [(at(1), "loss", 1.0), (at(2), "loss", 3.0)],
        [(at(200), "loss", 5.0)],
        [(at(201), "loss", 7.0)],
        [(at(3), "loss", 100.0), (at(202), "loss", 9.0)],
        [(at(400), "loss", 9.0)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame([("r", "train", *row) for row in rows], schema).coalesce(1).write.json(str(path / f"f={i}"))
    ordered = sorted(path.glob("f=*/part-*"), key=str)
    for i, file in enumerate(ordered):
        stamp = START.timestamp() + i * 60
        os.utime(file, (stamp, stamp))
    stream = streams.read_stream(spark, str(path / "f=*"), schema, files_per_trigger=1)
    means = streams.stream_train_metrics(stream, "1 hour", "10 minutes")
    out = streams.latest(spark, means, ["run", "split", "window_start", "metric"], "late")
    got = {r["window_start"]: (r["value"], r["n"]) for r in out.collect()}
    assert got == {START: (2.0, 2), START + timedelta(hours=3): (7.0, 3), START + timedelta(hours=6): (9.0, 1)}


def test_stream_without_input_is_empty_and_from_a_folder_whole(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stats = streams.stream_eval_stats(streams.read_stream(spark, str(tmp_path / "none"), schemas.EMBEDDED))
    assert streams.latest(spark, stats, ["run"], "none").count() == 0
    schema = "run string, split string, ts timestamp, metric string, value double"
    rows = [(f"r{i % 2}", "train", START + timedelta(hours=i), "loss", float(i)) for i in range(12)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "log.parquet"))
    stream = streams.read_stream(spark, str(tmp_path / "log.parquet"), schema, "parquet")
    means = streams.stream_train_metrics(stream, "6 hours", "10 minutes")
    out = streams.latest(spark, means, ["run", "split", "window_start", "metric"], "folder")
    assert sum(r["n"] for r in out.collect()) == 12 and out.select("run").distinct().count() == 2
