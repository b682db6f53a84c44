"""Losses, flow scores, diversity and win rate against plain Python."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from prefspark import schemas
from prefspark.operators import diversity as div
from prefspark.operators import flow, judging, preference as pref
from prefspark.plans import flows
from prefspark.sources import records

SEQ = (
    "pair_id bigint, side string, policy_logp array<double>, ref_logp array<double>, "
    "policy_eos_logp array<double>, ref_eos_logp_gamma array<double>, mask array<boolean>"
)


def sequences(pairs=12):
    rng = random.Random(0)
    rows = []
    for p, side in itertools.product(range(pairs), ("chosen", "rejected")):
        n = rng.randrange(2, 9)
        start = rng.randrange(n)
        draw = lambda: [-4 * rng.random() for _ in range(n)]
        rows.append((p, side, draw(), draw(), draw(), draw(), [t >= start for t in range(n)]))
    return rows


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(sequences(), SEQ).repartition(5)


def picked(row, i):
    return [x for x, m in zip(row[i], row[6]) if m]


@pytest.mark.parametrize("loss_type, smoothing", [("sigmoid", 0.0), ("sigmoid", 0.2), ("ipo", 0.0), ("normcdf", 0.0)])
def test_losses(seqs, loss_type, smoothing):
    beta = 0.3
    score = (lambda v: sum(v) / len(v)) if loss_type == "ipo" else sum
    by = {(r[0], r[1]): (score(picked(r, 2)), score(picked(r, 3))) for r in sequences()}
    got = pref.preference_scores(pref.pair_scores(seqs, loss_type), loss_type, beta, smoothing)
    for r in got.collect():
        (pc, rc), (pr, rr) = by[r["pair_id"], "chosen"], by[r["pair_id"], "rejected"]
        z = (pc - pr) - (rc - rr)
        logs = lambda x: -math.log1p(math.exp(-x))
        expected = {
            "sigmoid": -logs(beta * z) * (1 - smoothing) - logs(-beta * z) * smoothing,
            "ipo": (z - 1 / (2 * beta)) ** 2,
            "normcdf": -math.log(0.5 * (1 + math.erf(beta * z / math.sqrt(2)))),
        }[loss_type]
        assert r["loss"] == pytest.approx(expected)
        assert r["rewards_chosen"] == pytest.approx(beta * (pc - rc))
        assert r["rewards_margin"] == pytest.approx(beta * ((pc - rc) - (pr - rr)))
        assert r["rewards"] == pytest.approx(beta * ((pc - rc) + (pr - rr)))
        assert r["rewards_accuracy"] == float((pc - rc) > (pr - rr))


def test_batch_granularity_sums(seqs):
    pairs = pref.pair_scores(seqs).withColumn("batch_id", F.col("pair_id") % 2)
    by_pair = pref.preference_scores(pairs).groupBy("batch_id").agg(
        F.sum("rewards_chosen").alias("c"), F.sum("rewards_rejected").alias("r"), F.avg("loss").alias("l")
    )
    batch = pref.preference_scores(pairs, granularity="batch")
    for r in batch.join(by_pair, "batch_id").collect():
        assert r["rewards_chosen"] == pytest.approx(r["c"])
        assert r["rewards_accuracy"] == float(r["c"] > r["r"])
        assert r["loss"] == pytest.approx(r["l"])


def test_bad_arguments(seqs):
    pairs = pref.pair_scores(seqs)
    for bad in ({"beta": 0.0}, {"loss_type": "other"}, {"granularity": "row"}):
        with pytest.raises(ValueError):
            pref.preference_scores(pairs, **bad)
    assert pref.score_name("ipo") == "ipo" and pref.score_name("normcdf") == "dpo"


def test_register_loss(seqs):
    pref.register_loss("hinge", lambda z, beta, _: F.greatest(1 - z * beta, F.lit(0.0)))
    row = pref.preference_scores(pref.pair_scores(seqs), "hinge", 0.5).head()
    assert row["loss"] == pytest.approx(max(1 - 0.5 * row["margin_logit"], 0))


def test_batch_means_names(seqs):
    scores = pref.preference_scores(pref.pair_scores(seqs))
    assert pref.batch_means(scores, by=None, split="eval").columns[0] == "eval/loss"


def test_flow(seqs):
    alpha = 0.25
    got = {(r["pair_id"], r["side"]): r for r in flow.flow_scores(seqs, alpha).collect()}
    for p, side, pi, rho, qe, re, mask in sequences():
        n = len(mask)
        last = max(t for t in range(n) if mask[t])
        reward = [rho[t] * mask[t] + re[t] for t in range(n)]
        reward[last] += alpha * (0 if side == "chosen" else -8)
        f = [reward[t] - qe[t] for t in range(n)]
        loss = sum((f[t] - f[t + 1] + pi[t]) ** 2 for t in range(n - 1) if mask[t])
        row = got[p, side]
        assert row["residual_loss"] == pytest.approx(loss)
        assert row["reward"] == pytest.approx(sum(reward) / sum(mask))
        assert row["kl"] == pytest.approx(sum(a - b for a, b, m in zip(pi, rho, mask) if m))
    total = flow.flow_metrics(flow.flow_scores(seqs, alpha)).head()
    assert total["kl"] == pytest.approx(sum(r["kl"] for r in got.values()))


def test_one_token_answer_has_no_residual(spark):
    row = (1, "rejected", [-1.0], [-2.0], [-3.0], [-4.0], [True])
    got = flow.flow_scores(spark.createDataFrame([row], SEQ), 0.1).head()
    assert got["residual_loss"] == 0.0 and got["reward"] == pytest.approx(-6.8)


def test_reward_without_counted_token_divides_by_zero_as_the_sql(spark):
    rows = [(k, "chosen", [-1.0], [-2.0], [-3.0], [end], [False]) for k, end in enumerate((-4.0, 4.0, 0.0))]
    got = {r["pair_id"]: r["reward"] for r in flow.flow_scores(spark.createDataFrame(rows, SEQ), 0.1).collect()}
    sql = duckdb.sql("SELECT k, sum(e) / count(*) FILTER (k < 0) FROM (VALUES (0, -4e0), (1, 4e0), (2, 0e0)) t(k, e) GROUP BY k").fetchall()
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in sql} == {0: "-inf", 1: "inf", 2: "nan"}


def test_diversity_matches_pairs(spark):
    rng = random.Random(2)
    rows = [(i % 4 if i < 30 else 9, [rng.gauss(0, 1) for _ in range(5)]) for i in range(31)]
    rows += [(0, [0.0] * 5)]
    df = spark.createDataFrame(rows, "s bigint, v array<float>").repartition(6)
    got = {r["s"]: r["diversity"] for r in div.diversity(df, "s", "v").collect()}

    def cosine(a, b):
        norms = max(math.hypot(*a), 1e-12) * max(math.hypot(*b), 1e-12)
        return sum(x * y for x, y in zip(a, b)) / norms

    for s in range(4):
        vs = [v for k, v in rows if k == s]
        pairs = list(itertools.combinations(vs, 2))
        assert got[s] == pytest.approx(1 - sum(cosine(a, b) for a, b in pairs) / len(pairs), abs=1e-6)
    assert got[9] is None


def test_diversity_of_ragged_and_null_vectors(spark):
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (1, [0.0, 1.0])], "s bigint, v array<float>")
    with pytest.raises(Exception, match="(?i)dimension"):
        div.diversity(ragged.coalesce(1), "s", "v").collect()
    nulls = spark.createDataFrame([(1, [1.0, 0.0]), (1, None), (1, [0.0, 1.0]), (2, None)], "s bigint, v array<float>")
    rows = div.diversity(nulls, "s", "v").collect()
    assert [(r["s"], r["n_outputs"], r["diversity"]) for r in rows] == [(1, 2, pytest.approx(1.0))]


def test_diversity_of_nothing(spark):
    empty = spark.createDataFrame([], "s bigint, v array<float>")
    assert div.diversity(empty, "s", "v").count() == 0
    summary = div.mean_std_err(div.diversity(empty, "s", "v"), "diversity").head()
    assert summary["n"] == 0 and summary["mean"] is None and summary["std_err"] is None


def generated(spark, samples=40, parts=1):
    rows = []
    for s in range(samples):
        for p in range(parts):
            refs = [] if s == 0 else [f"ref{s}.{p}.{i}" for i in range(2)]
            outs = [f"out{s}.{p}.{i}" for i in range(3)]
            rows.append((s, p, [("user", f"q{s}")], "p", 3 * p, 2 * p, outs, refs))
    return spark.createDataFrame(rows, schemas.GENERATED).repartition(7)


@pytest.mark.parametrize("parts", [1, 3])
def test_requests(spark, parts):
    rows = judging.judge_requests(generated(spark, parts=parts), "hh", n=2, seed=1).collect()
    assert len(rows) == 2 * 39 and all(r["sample_id"] != 0 for r in rows)
    assert {r["slot"] for r in rows} == {1, 2}
    for s in range(1, 40):
        mine = [r for r in rows if r["sample_id"] == s]
        assert len({r["response"] for r in mine}) == 2
        assert len({r["reference_response"] for r in mine}) == 1
    for r in rows:
        first = r["response"] if r["response_is_a"] else r["reference_response"]
        assert f"Response A: {first}\n" in r["judge_prompt"]
    again = judging.judge_requests(generated(spark, parts=parts).repartition(1), "hh", n=2, seed=1)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    other = judging.judge_requests(generated(spark, parts=parts), "hh", n=2, seed=2)
    assert sorted(map(str, other.collect())) != sorted(map(str, rows))


def test_verdicts_and_summary(spark, tmp_path):
    asked = judging.judge_requests(generated(spark), "hh", n=2)
    said = {1: "no verdict", 2: 'More helpful: "A"', 3: None}
    completions = [
        (r["request_id"], said.get(r["sample_id"], "More helpful: " + ("A" if r["response_is_a"] == (r["slot"] == 1) else "b")))
        for r in asked.collect()
        if r["sample_id"] != 4 or r["slot"] == 1
    ]
    answers = spark.createDataFrame(completions, "request_id string, completion string")
    valid = judging.verdicts(asked, answers, "hh", n=2)
    rows = valid.collect()
    assert {r["sample_id"] for r in rows} == set(range(5, 40))
    assert all(r["wins"] == [True, False] for r in rows)
    summary = judging.win_summary(valid).head()
    assert (summary["mean"], summary["min"], summary["max"]) == (0.5, 0.0, 1.0)
    assert summary["std_err"] == pytest.approx(0.5 / math.sqrt(2))
    assert judging.sample_comparisons(valid, 7).count() == 7
    assert judging.win_summary(valid.where("false")).head()["mean"] is None
    records.write_comparisons(valid, str(tmp_path / "c"))
    back = records.read_comparisons(spark, str(tmp_path / "c"))
    assert back.count() == 35 and back.head()["reference"]["wins"] == [True, False]


def test_win_rate_single_slot_has_no_error(spark):
    say = lambda asked: asked.select("request_id", F.lit("More helpful: A").alias("completion"))
    row = flows.win_rate_report(generated(spark), say, samples=300).head()
    assert row["std_err"] == 0.0 and 0 < row["mean"] < 1


def test_diversity_report(spark):
    loader = lambda: lambda texts: [[float(len(t)), float(t.count("1"))] for t in texts]
    row = flows.diversity_report(generated(spark), loader).head()
    assert row["n"] == 40 and row["mean"] >= 0


def test_draws_do_not_depend_on_how_lists_are_cut(spark):
    refs, outs = [f"r{i}" for i in range(6)], [f"o{i}" for i in range(6)]
    whole = [(1, 0, [("user", "q")], "p", 0, 0, outs, refs)]
    parts = [(1, k, [("user", "q")], "p", 2 * k, 2 * k, outs[2 * k : 2 * k + 2], refs[2 * k : 2 * k + 2]) for k in range(3)]
    for seed in range(6):
        a, b = (judging.judge_requests(spark.createDataFrame(x, schemas.GENERATED), n=3, seed=seed).collect() for x in (whole, parts))
        assert sorted(a) == sorted(b)


def test_judge_prompt_without_history(spark):
    rows = [(1, 0, [], "p", 0, 0, ["out"], ["ref"])]
    asked = judging.judge_requests(spark.createDataFrame(rows, schemas.GENERATED), "hh").collect()
    assert len(asked) == 1 and "out" in asked[0]["judge_prompt"]


def test_repeated_completions_count_once(spark):
    requests = judging.judge_requests(generated(spark), "hh", n=2)
    said = requests.select("request_id", F.lit("More helpful: A").alias("completion"))
    once = judging.verdicts(requests, said, "hh", 2).count()
    assert once == 39 and judging.verdicts(requests, said.unionByName(said), "hh", 2).count() == once


def test_pair_scores_reject_duplicates_and_report_missing_sides(spark):
    schema = "pair_id bigint, side string, policy_logp array<double>, ref_logp array<double>, mask array<boolean>"
    row = lambda pair, side: (pair, side, [-1.0], [-0.5], [True])
    twice = spark.createDataFrame([row(1, "chosen"), row(1, "chosen"), row(1, "rejected")], schema)
    with pytest.raises(Exception, match="two chosen rows of pair 1"):
        pref.pair_scores(twice).collect()
    half = spark.createDataFrame([row(1, "chosen"), row(2, "rejected"), row(3, "chosen"), row(3, "rejected")], schema)
    missing = {r["pair_id"]: r["missing"] for r in pref.incomplete_pairs(half).collect()}
    assert missing == {1: "rejected", 2: "chosen"}


@pytest.mark.parametrize(
    "logits, labels, message", [([[0.0, 1.0]], [0, 1], "rows of logits"), ([[0.0, 1.0]] * 2, [0, 5], "outside the vocabulary")]
)
def test_token_logps_check_shapes(spark, logits, labels, message):
    df = spark.createDataFrame([(logits, labels)], "logits array<array<double>>, labels array<int>")
    with pytest.raises(Exception, match=message):
        pref.token_logps(df).collect()
