"""Global order: brute force, skewed keys, partition invariance."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from prefspark.operators import numbering


def frame(spark, keys, parts=4):
    rows = [(k, float(k % 7)) for k in keys]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k bigint, x double").repartition(parts)


KEYS = {
    "dense": list(range(500)),
    "outlier": list(range(400)) + [10**15],
    "clusters": list(range(0, 300)) + list(range(10**9, 10**9 + 300)) + [-(10**12)],
    "single": [42],
    "two": [3, 9],
}


@pytest.mark.parametrize("cells", [1, 300])
@pytest.mark.parametrize("name", KEYS)
def test_row_numbers(spark, name, cells, monkeypatch):
    monkeypatch.setattr(numbering, "CELLS_PER_PARTITION", cells)
    got = numbering.row_numbers(frame(spark, KEYS[name]), "k").collect()
    assert {r["k"]: r["row_no"] for r in got} == {
        k: i + 1 for i, k in enumerate(sorted(KEYS[name]))
    }


def test_outlier_does_not_pile_up(spark):
    sizes = (
        numbering.cells_by_value(frame(spark, KEYS["outlier"]), "k").groupBy("_cell").count().collect()
    )
    assert max(r["count"] for r in sizes) <= 60


def test_empty(spark):
    empty = frame(spark, [1]).where("k > 5")
    assert numbering.row_numbers(empty, "k").count() == 0
    assert numbering.running_stats(empty, "x", "k").count() == 0
    assert numbering.take_proportion(empty, 0.5, "k").count() == 0


def test_row_numbers_per_group(spark):
    df = frame(spark, range(300)).withColumn("g", F.when(F.col("k") < 200, 0).otherwise(F.col("k") % 3))
    got = numbering.row_numbers(df, "k", group=["g"]).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["k"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["row_no"] == seen[r["g"]]


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_shuffled_numbers_do_not_depend_on_partitions(spark, parts):
    got = numbering.shuffled_numbers(frame(spark, range(200), parts), "k", 5).collect()
    order = sorted(range(200), key=lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest())
    assert {r["k"]: r["row_no"] for r in got} == {k: i + 1 for i, k in enumerate(order)}


def test_seed_changes_order(spark):
    df = frame(spark, range(100))
    a, b = ([r["k"] for r in numbering.first_shuffled(df, "k", s, 10).collect()] for s in (0, 1))
    assert a != b


def test_sample_is_the_top_k_of_the_digests(spark):
    df = frame(spark, range(300))
    some = {r["k"] for r in numbering.first_shuffled(df, "k", 0, 50).collect()}
    top = df.orderBy(F.md5(F.concat(F.lit("0|"), F.col("k"))), "k").limit(50)
    assert {r["k"] for r in top.collect()} == some


def test_running_std_err_with_a_large_offset(spark):
    rows = [(k, 1e9 + k % 2) for k in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, x double").repartition(5)
    got = {r["k"]: r["running_std_err"] for r in numbering.running_stats(df, "x", "k").collect()}
    assert got[999] == pytest.approx(statistics.stdev(x for _, x in rows) / 1000**0.5, rel=1e-9)
    assert got[10] == pytest.approx(statistics.stdev(x for _, x in rows[:11]) / 11**0.5, rel=1e-9)


@pytest.mark.parametrize("n, p, kept", [(200, 0.29, 56), (200, 1.0, 200), (50, 0.01, 0), (150, 0.01, 2), (10, 0.0, 0), (7, 0.5, 4)])
def test_take_proportion(spark, n, p, kept):
    # int(0.29 * 100) is 28; 50 * 1% = 0.5 and 150 * 1% = 1.5 round to even.
    got = sorted(r["k"] for r in numbering.take_proportion(frame(spark, range(n)), p, "k").collect())
    assert got == list(range(kept))


def test_running_stats(spark):
    keys = KEYS["clusters"]
    got = {r["k"]: r for r in numbering.running_stats(frame(spark, keys), "x", "k").collect()}
    seen = []
    for k in sorted(keys):
        seen.append(float(k % 7))
        row = got[k]
        assert row["running_mean"] == pytest.approx(statistics.fmean(seen))
        if len(seen) == 1:
            assert row["running_std_err"] is None
        else:
            expected = statistics.stdev(seen) / len(seen) ** 0.5
            assert row["running_std_err"] == pytest.approx(expected, abs=1e-9)


def test_batches(spark):
    got = numbering.assign_batches(frame(spark, range(50)), 16, "k").collect()
    assert {r["k"]: r["batch_id"] for r in got} == {k: k // 16 for k in range(50)}
    with pytest.raises(ValueError):
        numbering.assign_batches(frame(spark, [1]), 0, "k")


@pytest.mark.parametrize("name", KEYS)
def test_row_numbers_by_stored_keys(spark, name):
    """Rows are numbered by cells that are cut and counted on their keys alone; keys that come twice have two numbers."""
    df = frame(spark, KEYS[name] + KEYS[name][:3])
    got = sorted((r["k"], r["row_no"]) for r in numbering.row_numbers_by(df, "k", df.select("k")).collect())
    assert got == [(k, i + 1) for i, k in enumerate(sorted(KEYS[name] + KEYS[name][:3]))]
