"""Judging in rounds: the rows of judging everything, for few more questions than they take."""

import pytest
from pyspark.sql import functions as F

from prefspark.operators import judging, numbering


def requests(spark, samples, n):
    rows = [(s, slot, f"{s}|{slot}", (s + slot) % 2 == 0, None, "r", f"ref {s}", "?") for s in range(samples) for slot in range(1, n + 1)]
    schema = "sample_id long, slot int, request_id string, response_is_a boolean, history array<struct<role:string,content:string>>, response string, reference_response string, judge_prompt string"
    return spark.createDataFrame(rows, schema).repartition(5)


class Judge:
    """Answers a fixed share of the requests in the wanted form, and counts what it was asked."""

    def __init__(self, share):
        self.share, self.asked = share, []

    def __call__(self, asked):
        self.asked.append([r.request_id for r in asked.select("request_id").collect()])
        fit = F.pmod(F.xxhash64("request_id"), F.lit(1000)) < int(1000 * self.share)
        return asked.select("request_id", F.when(fit, "More helpful: A").otherwise("cannot say").alias("completion"))


@pytest.mark.parametrize("samples,n,share,wanted", [(3000, 1, 0.9, 300), (3000, 1, 0.4, 200), (3000, 2, 0.7, 250), (1500, 1, 1.0, 100)])
def test_rounds_give_the_rows_of_judging_all(spark, samples, n, share, wanted):
    asked, judge = requests(spark, samples, n), Judge(share)
    found = {(r.sample_id, tuple(r.wins)) for r in judging.judge_until(asked, judge, "hh", n, wanted, seed=3).collect()}
    every = judging.verdicts(asked, Judge(share)(asked), "hh", n)
    assert found == {(r.sample_id, tuple(r.wins)) for r in judging.sample_comparisons(every, wanted, seed=3).collect()}
    assert len(found) == wanted
    questions = [q for part in judge.asked for q in part]
    assert len(questions) == len(set(questions))
    rate = every.count() / samples
    assert len(questions) <= 1.3 * n * wanted / rate


def test_rounds_end_without_enough(spark):
    asked = requests(spark, 40, 1)
    for share in (0.5, 0.0):
        judge = Judge(share)
        found = judging.judge_until(asked, judge, "hh", 1, 1000)
        assert sum(map(len, judge.asked)) == 40
        assert found.count() == judging.verdicts(asked, Judge(share)(asked), "hh", 1).count()
    assert judging.judge_until(asked.where("false"), Judge(1.0), "hh", 1, 10).count() == 0


def test_order_is_that_of_the_numbers(spark):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(3)
    order = numbering.ShuffledOrder(df, "k", 9)
    numbered = {r.k: r.row_no for r in numbering.shuffled_numbers(df, "k", 9).collect()}
    for count in (0, 1, 37, 500, 900):
        got = {r.k for r in df.where(order.upto(order.place(count))).collect()}
        assert got == {k for k, no in numbered.items() if no <= count}
    plan = df.where(order.upto(order.place(37)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    odd = df.unionByName(spark.createDataFrame([(None,)], "k long"))
    assert numbering.first_shuffled(odd, "k", 9, 10**6).count() == 500
