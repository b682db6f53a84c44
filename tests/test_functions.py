"""Hand-computed values and edge rows of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from prefspark.functions import chat, judging, logprob, tokens, vectors
from prefspark.operators import preference as pref


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def messages(*pairs):
    return F.array(*[chat.message(role, F.lit(text)) for role, text in pairs])


def ints(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def flags(values):
    return F.array(*[F.lit(bool(v)) for v in values]).cast("array<boolean>")


def test_chatml(spark):
    talk = messages(("user", "hi"), ("assistant", "yo"))
    assert one(spark, chat.render(talk, add_generation_prompt=True)) == (
        "<|im_start|>user\nhi<|im_end|><|im_start|>assistant\nyo<|im_end|><|im_start|>assistant\n"
    )


def test_chatml_lone_answer_has_no_header(spark):
    assert one(spark, chat.render(messages(("assistant", "yo")), eos="</s>")) == "yo</s>"


def test_chatml_null_text_is_empty(spark):
    talk = F.array(chat.message("user", F.lit(None).cast("string")))
    assert one(spark, chat.render(talk)) == "<|im_start|>user\n<|im_end|>"


def test_llama_drops_system_and_has_no_cue(spark):
    talk = messages(("system", "s"), ("user", "hi"), ("assistant", "yo"))
    assert one(spark, chat.render(talk, "llama", add_generation_prompt=True)) == "<s>[INST]hi[/INST]yo</s>"


def test_pick_template():
    assert chat.pick_template(None) == "chatml"
    assert chat.pick_template("a [INST] b") == "llama"
    assert chat.pick_template("a [INST] b", relax=False) == "own"
    assert chat.pick_template("a [INST] b", generating=True) == "chatml"


def test_unknown_template():
    with pytest.raises(ValueError):
        chat.render(messages(("user", "hi")), "other")


@pytest.mark.parametrize("ids, kept", [([], []), ([1, 2], [1, 2]), ([1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4], [2, 3, 4])])
def test_keep_last(spark, ids, kept):
    assert one(spark, tokens.keep_last(ints(ids), 3)) == kept


def test_keep_first(spark):
    assert one(spark, tokens.keep_first(ints([1, 2, 3]), F.lit(2))) == [1, 2]
    assert one(spark, tokens.keep_first(ints([1, 2, 3]), F.lit(0))) == []


def test_labels_with_empty_prompt(spark):
    assert one(spark, tokens.labels_for(ints([]), ints([5, 6]))) == [5, 6]
    assert one(spark, tokens.labels_for(ints([7]), ints([5, 6]))) == [-100, 5, 6]


def test_pad(spark):
    assert one(spark, tokens.pad(ints([1]), 0, F.lit(3), "right")) == [1, 0, 0]
    assert one(spark, tokens.pad(ints([1]), 0, F.lit(3), "left")) == [0, 0, 1]


def test_default_tokens_keep_markers_apart(spark):
    text = F.lit("<|im_start|>user\na b<|im_end|><|im_start|>x <y")
    assert one(spark, tokens.words(text)) == [
        "<|im_start|>", "user", "a", "b", "<|im_end|>", "<|im_start|>", "x", "<", "y",
    ]


@pytest.mark.parametrize("x", [-800.0, -3.0, 0.0, 3.0, 800.0])
def test_log_sigmoid(spark, x):
    expected = x - math.log1p(math.exp(x)) if x < 0 else -math.log1p(math.exp(-x))
    assert one(spark, logprob.log_sigmoid(F.lit(x))) == pytest.approx(expected, abs=1e-12)


def test_neg_log_normal_cdf_from_minus_30_to_30(spark):
    values = [z / 8 for z in range(-240, 241)]
    df = spark.createDataFrame([(v,) for v in values], "z double").select("z", logprob.neg_log_normal_cdf(F.col("z")).alias("y"))
    for z, y in df.collect():
        tail = 0.5 * math.erfc(abs(z) / math.sqrt(2))
        assert y == pytest.approx(-math.log(tail) if z <= 0 else -math.log1p(-tail), rel=1e-12)
    assert "Python" not in df._jdf.queryExecution().toString()


def test_neg_log_normal_cdf(spark):
    values = [-50.0, -8.0, -1.0, 0.0, 1.0, 8.0, None]
    df = spark.createDataFrame([(v,) for v in values], "z double")
    got = [r[0] for r in df.select(logprob.neg_log_normal_cdf(F.col("z"))).collect()]
    assert got[0] == math.inf
    assert got[3] == pytest.approx(math.log(2))
    for z, y in list(zip(values, got))[1:6]:
        assert y == pytest.approx(-math.log(0.5 * math.erfc(-z / math.sqrt(2))), abs=1e-14)
    assert got[6] is None


@pytest.mark.parametrize(
    "mask, slid",
    [([0, 0, 1, 1], [0, 1, 1, 1]), ([1, 1], [1, 1]), ([0, 0], [0, 0]), ([0, 1], [1, 1]), ([0, 0, 1, 0], [0, 1, 1, 0])],
)
def test_slide_mask(spark, mask, slid):
    assert one(spark, logprob.slide_mask(flags(mask))) == [bool(m) for m in slid]


def test_last_true(spark):
    assert one(spark, logprob.last_true(flags([0, 1, 1, 0]))) == 3
    assert one(spark, logprob.last_true(flags([0, 0]))) == 0


def test_token_logps_from_logits(spark):
    rows = [[1.0, 2.0, 3.0], [0.0, 0.0, 1000.0], [5.0, 5.0, 5.0], [9.0, 9.0, 9.0]]
    labels = [-100, -100, 2, 1]
    df = spark.createDataFrame([(rows, labels)], "logits array<array<float>>, labels array<int>")
    got = pref.token_logps(df, temperature=2.0, slide_mask=True).head()

    def logp(row, y):
        z = [x / 2 for x in row]
        top = max(z)
        return z[y] - top - math.log(sum(math.exp(v - top) for v in z))

    assert got["mask"] == [True, True, True]
    assert got["logp"] == pytest.approx([logp(rows[0], 0), logp(rows[1], 2), logp(rows[2], 1)])
    plain = pref.token_logps(df).head()
    assert plain["mask"] == [False, True, True] and plain["logp"][0] == 0.0


def test_sequence_logp(spark):
    values, mask = doubles([-1, -2, -4]), flags([0, 1, 1])
    assert one(spark, pref.sequence_logp(values, mask, "sum")) == -6
    assert one(spark, pref.sequence_logp(values, mask, "mean")) == -3
    assert one(spark, pref.sequence_logp(values, mask, "none")) == [0, -2, -4]
    assert one(spark, pref.sequence_logp(values, flags([0, 0, 0]), "mean")) is None


@pytest.mark.parametrize(
    "text, letter",
    [
        ("Comparison: x\nPreferred: A", "a"),
        ("preferred: b because", "b"),
        ('Preferred: "A"', '"'),
        ("I like A", ""),
        ("Preferred:A", ""),
        ("Preferred: A\nPreferred: B", "a"),
    ],
)
def test_verdict(spark, text, letter):
    assert one(spark, judging.verdict(F.lit(text), "tldr")) == letter


def test_vote(spark):
    for letter, is_a, win in [("a", True, True), ("a", False, False), ("b", True, False), ("b", False, True), ("c", True, None)]:
        assert one(spark, judging.vote(F.lit(letter), F.lit(is_a))) is win


@pytest.mark.parametrize(
    "text, cleaned",
    [("One. Two! thr", "One. Two!"), ("none here", "none here"), ("a.\nb", "a."), ("", ""), ("end?", "end?")],
)
def test_clean_response(spark, text, cleaned):
    assert one(spark, judging.clean_response(F.lit(text))) == cleaned


def test_judge_prompt_wording(spark):
    history = messages(("user", "first"), ("assistant", "mid"), ("user", "last"))
    hh = one(spark, judging.judge_prompt(history, F.lit("x"), F.lit("y"), "hh", None))
    assert "Query:\nUSER: last\n\n\nResponse A: x\n\nResponse B: y\n\nFIRST" in hh
    tldr = one(spark, judging.judge_prompt(history, F.lit("x"), F.lit("y"), "tldr", "simple"))
    assert "Post:\nfirst\n\nSummary A: x\n\nSummary B: y\n\nFIRST" in tldr
    with pytest.raises(ValueError):
        judging.judge_prompt(history, F.lit("x"), F.lit("y"), "tldr", None)


def test_row_diversity(spark):
    rows = [
        ([[1.0, 0.0], [0.0, 1.0]], 1.0),
        ([[2.0, 0.0], [5.0, 0.0]], 0.0),
        ([[1.0, 0.0], [0.0, 0.0]], 1.0),
        ([[1.0, 0.0]], None),
        ([], None),
    ]
    df = spark.createDataFrame([(v,) for v, _ in rows], "v array<array<double>>")
    got = [r[0] for r in df.select(vectors.diversity_of_rows(F.col("v"))).collect()]
    for value, (_, expected) in zip(got, rows):
        assert value is None if expected is None else value == pytest.approx(expected, abs=1e-12)
