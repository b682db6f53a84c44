"""Pipeline stages on rows without doc_id and on texts that share one."""

import random

import corpus_pipeline
import pytest
from prefspark.llm import suffix_dedup, toxicity
from pyspark.sql import functions as F

rng = random.Random(2)
WORDS = "the quick brown fox jumps over a lazy dog and then runs far away from it all while nobody looks on".split()
line = lambda: " ".join(rng.choice(WORDS) for _ in range(9))
SHARED = "\n".join(line() for _ in range(3))
FIRST, UNIQUE, OTHER = (f"{line()}\n{line()}\n{line()}\n{line()}" for _ in range(3))
SECRET = "747e8edd6430861f24c6911d38d6f174e76a63b3"
ROWS = [(None, UNIQUE), (None, ""), (None, f"{SHARED}\n{FIRST}"), (3, SHARED), (5, OTHER), (5, None), (None, f'{FIRST}\ntoken = "{SECRET}"')]


def docs_of(spark):
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_rejection_meets_the_row_it_was_made_on(spark):
    kept = corpus_pipeline.language_id(spark, docs_of(spark), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in ROWS if t)


def test_lines_go_from_the_text_they_were_found_in(spark):
    cleaned = [r.text for r in corpus_pipeline.line_deduplication(spark, docs_of(spark), "").collect()]
    assert UNIQUE in cleaned and OTHER in cleaned
    assert sum(t.count(SHARED) for t in cleaned) == sum(t.count(FIRST) for t in cleaned) == 1


def test_secrets_of_rows_without_id_are_replaced(spark):
    redacted = corpus_pipeline.secret_scan(spark, docs_of(spark), "").collect()
    assert len(redacted) == len(ROWS) and not any(SECRET in (r.text or "") for r in redacted)
    assert {r.text for r in redacted if r.doc_id is None} >= {UNIQUE, f"{SHARED}\n{FIRST}"}


def test_another_text_of_a_doc_id_stays(spark):
    texts = [(5, " ".join(rng.choice(WORDS) + str(rng.random()) for _ in range(40))) for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in corpus_pipeline.ngram_jaccard(spark, docs, "").collect()} == {t for _, t in texts}


HELPERS = ("_row", "row", "kept_id", "_runs", "_run_id", "_run_key", "run_id", "RUN_KEY", "runs", "_span_id", "_spans", "span_id", "spans", "text_key", "own")


def test_stages_keep_columns_named_like_helpers(spark):
    docs = docs_of(spark)
    clashing = docs.withColumns({name: F.lit("x") for name in HELPERS})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns, name
        assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, stage(spark, docs, "").collect())), name
        assert {tuple(r) for r in out.select(*HELPERS).collect()} == {("x",) * len(HELPERS)}, name


def test_toxicity_goes_by_the_text_not_by_its_id(spark):
    texts = [(i, f"{line()} {'scoundrel' if i >= 60 else ''} {line()}") for i in range(90)]
    marks = spark.createDataFrame([(i, int(i >= 60)) for i, _ in texts], "doc_id long, toxic int")
    more = [(None, texts[70][1]), (None, texts[3][1]), (4, texts[71][1])]
    rows = toxicity.toxicity(spark.createDataFrame([*more, *texts], "doc_id long, text string"), marks).collect()
    low, high = (min(r.score for r in rows if r.doc_id == i) for i in (3, 70))
    assert sorted(r.score for r in rows if r.doc_id is None) == [low, high] and low < 0.5 < high
    assert sorted(r.score for r in rows if r.doc_id == 4) == [low, high]


@pytest.mark.parametrize("n", [1000, 20_000])
def test_a_rare_term_is_learned_from_few_and_from_many_labels(spark, n):
    rows = [(f"{line()} {'villain' if i < n // 2 else 'zounderkite' if i < n // 2 + 30 else 'rascal'}", 1) for i in range(n)]
    rows += [(line(), 0) for _ in range(3 * n)]
    entries = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert set(entries) == {"villain", "zounderkite", "rascal"}


def test_texts_of_one_id_are_cut_at_their_own_places(spark):
    copied, alone = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(2))
    rows = [(1, copied), (2, alone), (2, f"{alone[:40]}{copied}"), (2, None)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in out) == [(1, 200, 0), (2, 0, 0), (2, 200, 0), (2, 240, 200)]
