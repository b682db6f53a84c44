"""Orders of an epoch, answers that are kept, look-ups by key, running wins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import prefspark as ps
from prefspark.operators import numbering
from prefspark.streaming import metrics as streams


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 7, 16, 17, 101, 1000, 4097])
def test_an_epoch_is_a_permutation(spark, rows):
    numbered = spark.range(1, rows + 1).select(F.col("id").alias("row_no"))
    orders = [ps.EpochOrder(rows, 5, epoch) for epoch in (0, 1)]
    got = numbered.select(*[o.place(F.col("row_no") - 1).alias(f"p{i}") for i, o in enumerate(orders)]).collect()
    places = np.array(got, dtype=int).reshape(-1, 2)
    assert sorted(places[:, 0]) == sorted(places[:, 1]) == list(range(rows))
    for order, column in zip(orders, places.T):
        want = []
        for at in range(rows):
            at = order._image(at)
            while at >= rows:
                at = order._image(at)
            want.append(at)
        assert column.tolist() == want
    if rows > 100:
        assert (places[:, 0] != places[:, 1]).mean() > 0.9
        assert abs(np.corrcoef(np.arange(rows), places[:, 0])[0, 1]) < 0.3


def test_epochs_move_no_rows(spark, tmp_path):
    numbering.row_numbers(spark.range(500), "id").write.parquet(str(tmp_path / "n"))
    batched = ps.epoch_batches(spark.read.parquet(str(tmp_path / "n")), 16, seed=1, epoch=4)
    assert "Exchange" not in batched._jdf.queryExecution().executedPlan().toString()
    sizes = sorted(r["count"] for r in batched.groupBy("batch_id").count().collect())
    assert sizes == [4] + [16] * 31


def test_only_new_texts_reach_the_model(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def ask(texts):
        def run(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch.assign(answer=batch["text"].str.upper())[["digest", "answer"]]

        return texts.mapInPandas(run, "digest string, answer string")

    ledger = ps.Ledger(spark, str(tmp_path / "answers"), "digest string, answer string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string")
    want = {1: "A", 2: "B", 3: "A", 4: None, 5: ""}
    for expected in (3, 3):
        assert {r.id: r.answer for r in ps.ask_once(rows, "text", ask, ledger, batches=3).collect()} == want
        assert asked.value == expected
    more = rows.unionByName(spark.createDataFrame([(6, "c")], rows.schema))
    assert {r.id: r.answer for r in ps.ask_once(more, "text", ask, ledger).collect()} == want | {6: "C"}
    assert asked.value == 4
    clashing = rows.withColumns({"digest": F.lit(0), "answer": F.lit(1)})
    assert ps.ask_once(clashing, "text", ask, ledger, "said").columns == ["id", "text", "digest", "answer", "said"]


def test_a_killed_run_keeps_its_finished_parts(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("t"), "id").alias("text"))
    calls = []

    def ask(texts):
        calls.append(texts.count())
        if len(calls) == 3:
            raise RuntimeError("killed")
        return texts.select("digest", F.length("text").cast("string").alias("answer"))

    ledger = ps.Ledger(spark, str(tmp_path / "answers"), "digest string, answer string")
    with pytest.raises(RuntimeError):
        ps.answers_of(rows, "text", ask, ledger, batches=4)
    assert ps.answers_of(rows, "text", ask, ledger, batches=4).count() == 40
    assert calls[3:5] == [0, 0] and sum(calls) - calls[2] == 40


def test_a_look_up_reads_few_rows(spark, tmp_path):
    rows = 200_000
    docs = spark.range(rows).select((F.col("id") * 2).alias("key"), F.md5(F.col("id").cast("string")).alias("text"))
    ps.write_by_key(docs.orderBy("text"), str(tmp_path / "c"), "key", row_group_bytes=1 << 18)
    found = ps.get_rows(spark.read.parquet(str(tmp_path / "c")), "key", [10, 200_000, 399_998])

    def read(df):
        got = df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return got, leaf.metrics().apply("numOutputRows").value()

    got, scanned = read(found)
    assert sorted(r.key for r in got) == [10, 200_000, 399_998]
    assert scanned < rows / 5
    missing, scanned = read(ps.get_rows(spark.read.parquet(str(tmp_path / "c")), "key", [199_999]))
    assert missing == [] and scanned < rows / 20


def test_running_wins_count_replays_once(spark, tmp_path):
    valid = [("r", i, i, [i % 2 == 0, i % 3 == 0]) for i in range(12)]
    odd = [("r", 90, 1, [True]), ("r", 91, 1, [True, None]), ("s", 1, 1, [False, True])]
    columns = "run string, sample_id bigint, t bigint, wins array<boolean>"
    for k, rows in enumerate([valid[:7], valid[5:] + odd, valid]):
        made = spark.createDataFrame(rows, columns).select("run", "sample_id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "wins")
        made.coalesce(1).write.json(str(tmp_path / "in" / f"f={k}"))
    schema = "run string, sample_id bigint, ts timestamp, wins array<boolean>, f int"
    stream = streams.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    out = streams.latest(spark, ps.stream_win_stats(stream, 2, "1 hour"), ["run"], "wins", str(tmp_path / "out"))
    got = {r.run: r for r in out.collect()}
    comparisons = spark.createDataFrame([v[3:] for v in valid], "wins array<boolean>")
    want = ps.win_summary(comparisons).first()
    assert got["r"].n == 12 and got["s"].n == 1
    assert [got["r"][c] for c in ("mean", "std_err", "min", "max")] == pytest.approx([want[c] for c in ("mean", "std_err", "min", "max")])
