"""Generation that is broken off and continued."""

from collections import Counter

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from prefspark.operators import plugins
from prefspark.plans import flows
from prefspark.sources.ledger import Ledger


def raw(spark, rows):
    made = [(i, "train", f"prompt {i // 2}", f"chosen {i}", "no") for i in rows]
    return spark.createDataFrame(made, "row_idx long, split string, prompt string, chosen string, rejected string").repartition(3)


def model(log, fail_on=None):
    """A loader whose model notes every prompt it is asked, and fails on one of them."""

    def loader():
        def run(prompts, n, **sampling):
            with open(log, "a") as out:
                out.writelines(p.replace("\n", " ") + "\n" for p in prompts)
            if fail_on and any(fail_on in p for p in prompts):
                raise RuntimeError("out of memory")
            return [[f"{len(p)}:{i}" for i in range(n)] for p in prompts]

        return run

    return loader


def rows(df):
    return sorted((r.sample_id, r.part, tuple(r.outputs), tuple(r.references)) for r in df.collect())


def asked(log):
    return Counter(log.read_text().splitlines()) if log.exists() else Counter()


def test_a_broken_run_is_continued(spark, tmp_path):
    how = {"batch_size": 4, "batches_per_commit": 3, "n_samples": 2}
    first, second, whole = tmp_path / "first", tmp_path / "second", tmp_path / "whole"
    source, path = raw(spark, range(100)), str(tmp_path / "ledger")
    with pytest.raises(Exception, match="out of memory"):
        flows.generate_resumable(source, "tldr", model(first, "prompt 30<"), path, **how)
    ledger = Ledger(spark, path, flows.OUTPUTS)
    kept = ledger.read().select("sample_id").distinct().count()
    assert 0 < kept < 50 and kept % 12 == 0
    made = flows.generate_resumable(source, "tldr", model(second), path, **how)
    assert rows(made) == rows(flows.generate_records(source, "tldr", model(whole), n_samples=2))
    # What was finished is not asked again; of the rest each prompt is asked once.
    assert set(asked(second).values()) == {1} and len(asked(second)) == 50 - kept
    assert len(set(asked(first)) | set(asked(second))) == 50
    outputs = ledger.read()
    assert outputs.count() == outputs.select("sample_id", "output_idx").distinct().count() == 100


def test_parts_of_a_run_add_up_and_new_prompts_follow(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "ledger")
    how = {"batch_size": 5, "batches_per_commit": 2}
    for commits in (1, 2, 3):
        made = flows.generate_resumable(raw(spark, range(60)), "tldr", model(log), path, max_commits=1, **how)
        assert made.where(F.size("outputs") > 0).count() == 10 * commits and made.count() == 30
    assert len(Ledger(spark, path, flows.OUTPUTS).commits()) == 3
    more = flows.generate_resumable(raw(spark, range(70)), "tldr", model(log), path, **how)
    assert more.where(F.size("outputs") == 1).count() == 35
    assert set(asked(log).values()) == {1} and len(asked(log)) == 35
    again = flows.generate_resumable(raw(spark, range(70)), "tldr", model(log, "prompt"), path, **how)
    assert rows(again) == rows(more)


def test_unfinished_commits_are_not_read(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), "sample_id bigint")
    assert ledger.read().count() == 0
    ledger.append(spark.range(3).withColumnRenamed("id", "sample_id"))
    left = tmp_path / "commit-torn"
    left.mkdir()
    (left / "part-0.json").write_text('{"sample_id": 9}\n')
    assert ledger.read().count() == 3
    ledger.clear_unfinished()
    assert not left.exists() and ledger.read().count() == 3


def test_other_settings_are_an_error(spark, tmp_path):
    source, path = raw(spark, range(4)), str(tmp_path / "ledger")
    flows.generate_resumable(source, "tldr", model(tmp_path / "log"), path, temperature=0.5)
    with pytest.raises(ValueError, match="was made with"):
        flows.generate_resumable(source, "tldr", model(tmp_path / "log"), path, temperature=0.7)


def test_limits_reach_the_model_where_set(spark):
    def loader():
        return lambda prompts, **sampling: [[f"{len(prompts)} {sorted(sampling)}"] for _ in prompts]

    df = spark.createDataFrame([(i, "p") for i in range(5)], "sample_id long, prompt string").coalesce(1)
    plain = {r.output for r in plugins.generate(df, loader).collect()}
    assert plain == {"5 ['n', 'seed', 'temperature', 'top_p']"}
    limited = {r.output for r in plugins.generate(df, loader, batch_size=2, top_k=3, min_new_tokens=1, max_new_tokens=9).collect()}
    assert {x.split()[0] for x in limited} == {"1", "2"} and all("top_k" in x and "max_new_tokens" in x for x in limited)
    with pytest.raises(ValueError):
        plugins.generate(df, loader, min_new_tokens=5, max_new_tokens=4)


def test_generator_without_a_batch_size_gets_bounded_pieces(spark):
    """Twelve megabytes in one Arrow batch reach the model in parts; ids, numbers and null prompts stay."""

    def loader():
        return lambda prompts, n, **sampling: [[f"{len(prompts)} {p and len(p)} {i}" for i in range(n)] for p in prompts]

    df = spark.range(3000).selectExpr("id AS sample_id", "IF(id = 7, NULL, repeat('x', 4000)) AS prompt").coalesce(1)
    rows = plugins.generate(df, loader, n_samples=2).collect()
    assert sorted((r.sample_id, r.output_idx) for r in rows) == [(k, i) for k in range(3000) for i in range(2)]
    assert max(int(r.output.split()[0]) for r in rows) < 1200
    assert {r.output.split(" ", 1)[1] for r in rows if r.sample_id == 7} == {"None 0", "None 1"}


def test_a_commit_reads_its_own_prompts_only(spark, tmp_path, monkeypatch):
    """Each commit's scan is cut to its folder of the stored prompts."""
    raw = spark.range(40).selectExpr("id AS row_idx", "'train' AS split", "concat('q', id) AS prompt", "'a' AS chosen", "'b' AS rejected")
    read, real = [], plugins.generate

    def spy(dealt, *args, **how):
        read.append("_commit" in dealt._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters: [")[2].partition("]")[0])
        return real(dealt, *args, **how)

    monkeypatch.setattr(plugins, "generate", spy)
    loader = lambda: lambda prompts, n, **sampling: [["x"] * n for _ in prompts]
    made = flows.generate_resumable(raw, "tldr", loader, str(tmp_path / "ledger"), batch_size=2, batches_per_commit=4)
    assert read == [True] * 5 and made.count() == 40


def test_only_prompts_of_wanted_commits_are_stored(spark, tmp_path, monkeypatch):
    """What a run ends before is neither stored nor given a folder; a run without missing prompts stores none."""
    stored, real = [], flows.materialize

    def spy(df, name, *args, **how):
        made = real(df, name, *args, **how)
        if name == "to-generate":
            stored.append((made.count(), made.select("_commit").distinct().count()))
        return made

    monkeypatch.setattr(flows, "materialize", spy)
    log, path = tmp_path / "log", str(tmp_path / "ledger")
    how = {"batch_size": 5, "batches_per_commit": 2}
    made = flows.generate_resumable(raw(spark, range(1000)), "tldr", model(log), path, max_commits=3, **how)
    assert stored == [(30, 3)]
    assert sorted(r.sample_id for r in made.where(F.size("outputs") > 0).collect()) == list(range(0, 60, 2))
    flows.generate_resumable(raw(spark, range(60)), "tldr", model(log, "prompt"), path, **how)
    assert len(stored) == 1


def test_batches_of_a_commit_are_dealt_out_evenly(spark, tmp_path):
    """Four batches for four tasks: one each, and none is split."""

    def loader():
        return lambda prompts, n, **sampling: [[f"{TaskContext.get().partitionId()}:{len(prompts)}"] * n for _ in prompts]

    made = flows.generate_resumable(raw(spark, range(96)), "tldr", loader, str(tmp_path / "ledger"), batch_size=4, batches_per_commit=4)
    for at in range(3):
        commit = made.where(F.floor(F.col("sample_id") / 32) == at).select(F.explode("outputs").alias("o"))
        assert {r.o: r["count"] for r in commit.groupBy("o").count().collect()} == {f"{task}:4": 4 for task in range(4)}


def test_repeated_ids_are_asked_as_often_as_they_occur(spark, tmp_path):
    """Rows that come twice: the records of a resumed run are those of one run."""
    source, path = raw(spark, [*range(40), *range(40)]), str(tmp_path / "ledger")
    how = {"batch_size": 4, "batches_per_commit": 2, "n_samples": 2}
    flows.generate_resumable(source, "tldr", model(tmp_path / "first"), path, max_commits=2, **how)
    assert sum(asked(tmp_path / "first").values()) == 16
    made = flows.generate_resumable(source, "tldr", model(tmp_path / "second"), path, **how)
    assert rows(made) == rows(flows.generate_records(source, "tldr", model(tmp_path / "whole"), n_samples=2))
