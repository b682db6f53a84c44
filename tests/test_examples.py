"""Adapters, conversations, grouping, encoding: skewed and edge inputs."""

import random

import pytest
from pyspark.sql import functions as F

from prefspark import schemas
from prefspark.operators import adapters, encoding, grouping, heavy, plugins, turns
from prefspark.plans import flows
from prefspark.sources import corpora, records


def talk_rows(conv, n, seed=0):
    rng = random.Random(seed + conv)
    roles = ["system"] + ["user", "assistant"] * (n // 2)
    return [
        (conv, t, roles[t % len(roles)], " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(4))))
        for t in range(n)
    ]


@pytest.fixture(scope="module")
def talk(spark):
    rows = [r for conv in range(6) for r in talk_rows(conv, 9)] + talk_rows(77, 400)
    rows += [(90, 0, "user", "only a question"), (91, 0, "user", "q"), (91, 1, "assistant", "one answer")]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, schemas.TABLES["conversations"]).repartition(5)


def encoded(raw, k, loader=None):
    pairs = adapters.adapt(raw, "hh_paired")
    rows = encoding.encode(pairs, ["chosen", "rejected"], k, 2 * k, loader=loader).drop("history").collect()
    return {r["row_idx"]: r.asDict() for r in rows}


@pytest.mark.parametrize("k", [4, 40])
@pytest.mark.parametrize("drops", [False, True])
def test_reduced_context_encodes_the_same(talk, k, drops):
    def few_tokens():
        """A tokenizer that gives many messages no token."""
        return lambda texts: [[int(w[1:]) for w in t.split() if w[0] == "w" and w[1:].isdigit() and int(w[1:]) > 60] for t in texts]

    loader = few_tokens if drops else None
    whole = encoded(turns.example_rows(talk), k, loader)
    reduced = encoded(turns.example_rows(talk, k, loader=loader), k, loader)
    assert whole == reduced
    assert set(whole) == {0, 1, 2, 3, 4, 5, 77}


def test_reduced_context_is_bounded_and_the_same_however_joins_are_spread(talk, monkeypatch):
    results = []
    for limit in (5, 10**9):
        monkeypatch.setattr(turns, "LONG_CONVERSATION", limit)
        results.append(sorted(turns.example_rows(talk, 5).collect()))
    assert results[0] == results[1]
    assert max(len(r["context"]) for r in results[0] if r["row_idx"] == 77) <= 5


@pytest.mark.parametrize("long", [50, 4096])
@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_messages_match_array_adapters(talk, long, broadcast_rows, monkeypatch):
    monkeypatch.setattr(turns, "LONG_CONVERSATION", long)
    monkeypatch.setattr(heavy, "BROADCAST_ROWS", broadcast_rows)
    raw = turns.example_rows(talk)
    arrays = adapters.adapt(raw, "hh_paired").collect()
    expected = {}
    for r in arrays:
        for side in ("chosen", "rejected"):
            expected[r["row_idx"], side] = [(m["role"], m["content"]) for m in r[side]]
    got = {}
    for r in sorted(turns.messages(talk, "paired").collect(), key=lambda r: r["pos"]):
        got.setdefault((r["row_idx"], r["side"]), []).append((r["role"], r["content"]))
    assert got == expected


def test_unpaired_and_prompt(talk):
    assert turns.messages(talk, "unpaired").where("row_idx = 91").count() == 2
    prompt = turns.messages(talk, "prompt").where("row_idx = 91").orderBy("pos").collect()
    assert [(r["side"], r["content"]) for r in prompt] == [("history", "q"), ("reference", "one answer")]
    assert turns.messages(talk, "unpaired").where("row_idx = 90").count() == 0
    with pytest.raises(ValueError):
        turns.messages(talk, "other")


def test_prompt_only_hh(spark):
    raw = spark.createDataFrame(
        [(1, "test", [("human", "q"), ("system", "s")], ("a",), ("b",))], schemas.HH_RAW
    )
    row = adapters.adapt(raw, "hh_prompt_only").head()
    assert row["prompt"] == (
        "<|im_start|>user\nq<|im_end|><|im_start|>assistant\ns<|im_end|><|im_start|>assistant\n"
    )
    assert [m["role"] for m in row["history"]] == ["user", "assistant"] and row["references"] == ["a"]


def test_register_adapter(spark):
    adapters.register_adapter("upper", lambda df: df.select(F.upper("t").alias("t")))
    assert adapters.adapt(spark.createDataFrame([("a",)], "t string"), "upper").head()[0] == "A"
    with pytest.raises(ValueError):
        adapters.adapt(spark.range(1), "unheard of")


def posts(spark):
    prompts = ["hot"] * 100 + ["b", "c", "b"] + [None] * 30
    rows = [(i, "train", p, f"c{i}", f"r{i}") for i, p in enumerate(prompts)]
    random.Random(0).shuffle(rows)
    return prompts, spark.createDataFrame(rows, schemas.TLDR_RAW).repartition(6)


@pytest.mark.parametrize("limit", [7, 29, 30, 1000])
@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_group_references_whole_and_bounded(spark, limit, broadcast_rows, monkeypatch):
    monkeypatch.setattr(heavy, "BROADCAST_ROWS", broadcast_rows)
    prompts, df = posts(spark)
    got = grouping.group_references(df, limit).collect()
    assert all(len(r["references"]) <= limit for r in got)
    whole = {}
    for r in sorted(got, key=lambda r: r["part"]):
        whole.setdefault((r["row_idx"], r["prompt"]), []).extend(r["references"])
    expected = {}
    for i, p in enumerate(prompts):
        expected.setdefault((prompts.index(p), p), []).append(f"c{i}")
    assert whole == expected


@pytest.mark.parametrize("limit", [3, 100])
def test_generation_records_round_trip(spark, limit, tmp_path):
    outputs = [(1, i, f"o{i}") for i in range(10)] + [(2, 50, "x")]
    outs = spark.createDataFrame(outputs, "sample_id bigint, output_idx bigint, output string")
    prompts = spark.createDataFrame(
        [
            (1, 0, [("user", "q1")], "p1", ["r0", "r1"]),
            (1, 1, [("user", "q1")], "p1", ["r2"]),
            (2, 0, [("user", "q2")], "p2", ["s"]),
            (3, 0, [("user", "q3")], "p3", []),
        ],
        f"sample_id bigint, part int, history {schemas.MESSAGES}, prompt string, references array<string>",
    )
    records.write_generations(grouping.generation_records(prompts, outs, limit), str(tmp_path / "g"))
    rows = records.read_generations(spark, str(tmp_path / "g")).orderBy("sample_id", "part").collect()
    outs_of, refs_of = {}, {}
    for r in rows:
        assert len(r["outputs"]) <= limit
        if r["part"] == 0:
            assert r["history"][0]["content"] == f"q{r['sample_id']}"
        outs_of.setdefault(r["sample_id"], []).extend(r["outputs"])
        refs_of.setdefault(r["sample_id"], []).extend(r["references"])
    assert outs_of == {1: [f"o{i}" for i in range(10)], 2: ["x"], 3: []}
    assert refs_of == {1: ["r0", "r1", "r2"], 2: ["s"], 3: []}


def test_encode_budget(spark):
    df = spark.createDataFrame(
        [(1, [("user", "a b c d"), ("assistant", "e f g h i j k l")], [("user", "a b c d"), ("assistant", "z")])],
        f"row_idx bigint, chosen {schemas.MESSAGES}, rejected {schemas.MESSAGES}",
    )
    row = encoding.encode(df, ["chosen", "rejected"], 5, 8).head()
    assert len(row["prompt_ids"]) == 5 and len(row["chosen_ids"]) == 3 and len(row["rejected_ids"]) == 2
    labelled = encoding.build_labels(encoding.encode(df, ["chosen"], 5, 8), ["chosen"]).head()
    assert labelled["chosen_labels"][:5] == [-100] * 5 and labelled["chosen_labels"][5:] == row["chosen_ids"]
    with pytest.raises(ValueError):
        encoding.encode(df, ["chosen"], 9, 8)


def test_rejected_tail_may_hold_several_messages(spark):
    df = spark.createDataFrame(
        [(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b"), ("user", "c")])],
        f"row_idx bigint, chosen {schemas.MESSAGES}, rejected {schemas.MESSAGES}",
    )
    row = encoding.split_examples(df, ["chosen", "rejected"]).head()
    assert [m["content"] for m in row["rejected_answer"]] == ["b", "c"]
    assert row["reference_response"] == "a"


def test_training_batches_pad_to_longest_of_both_sides(talk):
    raw = turns.example_rows(talk, 40)
    rows = flows.training_batches(raw, "hh", batch_size=3, max_prompt_length=40, max_length=80, seed=1).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r["batch_id"], []).append(r)
        sizes = {len(r[f"{s}_{f}"]) for s in ("chosen", "rejected") for f in ("input_ids", "attention_mask", "labels")}
        assert sizes == {r["padded_length"]}
    for batch in by_batch.values():
        assert any(0 not in r[f"{s}_attention_mask"] for r in batch for s in ("chosen", "rejected"))
    assert sorted(len(b) for b in by_batch.values()) == [1, 3, 3]


def test_user_tokenizer(spark):
    df = spark.createDataFrame([("a bb",), (None,)], "t string")
    loader = lambda: lambda texts: [[len(w) for w in t.split()] for t in texts]
    rows = df.select(encoding.token_ids(F.col("t"), loader).alias("ids")).collect()
    assert [r["ids"] for r in rows] == [[1, 2], []]


def test_load_preferences_reads_one_split(spark, tmp_path):
    _, df = posts(spark)
    both = df.unionByName(df.withColumn("split", F.lit("valid1")))
    both.write.partitionBy("split").parquet(str(tmp_path / "c"))
    rows = corpora.load_preferences(spark, str(tmp_path / "c"), "tldr", corpora.split_name("tldr", False))
    assert corpora.dataset_len(rows) == df.count()
    assert corpora.get_rows(rows, "row_idx", [1, 2]).count() == 2
    assert corpora.split_name("tldr", False, prompt_only=True) == "test"
    assert corpora.split_name("hh", True) == "train"


def test_generate_flow(spark):
    _, df = posts(spark)
    loader = lambda: lambda prompts, n, **kw: [[f"{i}:{kw['top_p']}" for i in range(n)] for _ in prompts]
    rows = flows.generate_records(df.where("prompt is not null"), "tldr", loader, n_samples=2).collect()
    assert len(rows) == 3 and all(r["outputs"] == ["0:0.95", "1:0.95"] for r in rows)


def test_foreign_records(spark, tmp_path):
    lines = [
        '{"history":[{"role":"user","content":"q"}],"prompt":"p","outputs":["a","b"],"references":["r","s"]}',
        '{"history":[{"role":"user","content":"q"}],"prompt":"p","outputs":["a"],"references":"one text"}',
        '{"history":[{"role":"user","content":"q"}],"prompt":"p","outputs":["a"],"references":"one text"}',
        '{"history":[],"prompt":"p","outputs":["a"],"references":"[not a list"}',
        "no record",
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    read = lambda: sorted(map(str, records.read_generations(spark, str(tmp_path)).collect()))
    rows = records.read_generations(spark, str(tmp_path)).collect()
    assert len({r["sample_id"] for r in rows}) == 4 and read() == read()
    assert sorted(r["references"] for r in rows) == [["[not a list"], ["one text"], ["one text"], ["r", "s"]]
    assert [r["line"] for r in records.rejected_lines(spark, str(tmp_path)).collect()] == ["no record"]


def test_generator_must_return_as_many_texts_as_asked(spark):
    df = spark.createDataFrame([(2**62, "p")], "sample_id bigint, prompt string")
    many = lambda: lambda prompts, n, **kw: [["x"] * 3 for _ in prompts]
    rows = plugins.generate(df, many, n_samples=3).collect()
    assert [(r["sample_id"], r["output_idx"]) for r in rows] == [(2**62, i) for i in range(3)]
    with pytest.raises(Exception, match="must return 2 texts"):
        plugins.generate(df, many, n_samples=2).collect()


def test_embedder_skips_null_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i bigint, t string")
    rows = {r["i"]: r["embedding"] for r in plugins.embed(df, "t", lambda: lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert rows == {1: [2.0, 1.0], 2: None}
