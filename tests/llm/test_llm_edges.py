"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import bpe, exact_dedup, langid, line_dedup, ngram_join, packing, quality_rules, secrets, suffix_dedup, toxicity
from prefspark.llm.common import vocabulary
from prefspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHES = ("key", "kept", "label", "node", "row", "start", "end", "runs", "value", "text_sha256", "features", "toxic", "score", "piece", "span", "digest", "n", "word")
WORDS = "the quick brown fox jumps over a lazy dog and then runs far away from it all while nobody looks on".split()
draw = random.Random(0)
PROSE = " ".join(draw.choice(WORDS) for _ in range(120)) + "."
NEAR = PROSE.replace("fox", "cat", 1)
LONG = "\n".join(" ".join(draw.choice(WORDS) + str(draw.randint(0, 999)) for _ in range(12)) + "." for _ in range(4000))
ROWS = [
    (1, PROSE, "en", "a", len(PROSE)),
    (2, NEAR, "en", "a", None),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (5, LONG, "en", "b", len(LONG)),
    (6, PROSE.upper(), None, "a", 1),
    (7, PROSE, "en", "a", 1),
    (7, PROSE, "en", "a", 1),
    (8, "?! 12", "en", "a", 5),
    (None, PROSE, "en", "a", 1),
    (9, "one line\ntwo lines\nthree lines\nfour\none line\ntwo lines\nthree lines", "en", "a", 1),
    (10, "one line\ntwo lines\n\n three lines \nend", "en", "a", 1),
    (11, 'token = "747e8edd6430861f24c6911d38d6f174e76a63b3" and 6044423740532315', "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(ROWS, SCHEMA)).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (5, 0), (None, 1), (9, None), (10, 0)], "doc_id long, toxic int")


def with_clashes(df):
    return df.withColumns({name: F.lit("x") for name in CLASHES})


def by_id(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.doc_id, []).append(row)
    return out


def test_quality_rules(docs, nothing):
    rows = by_id(quality_rules.quality_rules(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[3][0].n_words == rows[4][0].n_words == 0 and rows[3][0].base_failed and not rows[3][0].kept
    assert rows[7][0] == rows[7][1] and rows[5][0].kept and rows[5][0].n_words == 48000
    assert quality_rules.quality_rules(nothing).count() == 0


@pytest.mark.parametrize(
    "line,rule",
    [
        ("Home | News | Sport | Contact", "navigation"),
        ("buy### it%%% now$$$ or*** never&&&", "punctuation"),
        ("BUY!! IT!! NOW!! OR!! NEVER!!", "punctuation"),
        ("A heading without an end", "punctuation"),
        ("All rights reserved.", "boilerplate"),
        ("A clean sentence.", ""),
        ("a long line of prose that was broken by a line feed and so", ""),
    ],
)
def test_line_rules(line, rule):
    assert quality_rules.line_fails(line) == rule


def test_repeated_words_by_brute_force():
    for _ in range(300):
        words = [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 25))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_line_dedup(docs, nothing):
    rows = by_id(line_dedup.deduplicate_lines(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert (rows[3][0].text, rows[3][0].n_lines, rows[3][0].n_removed) == ("", 1, 0)
    assert rows[9][0].text == "one line\ntwo lines\nthree lines\nfour"
    assert rows[10][0].text == "end" and rows[10][0].n_removed == 4
    assert rows[5][0].text == LONG
    assert line_dedup.deduplicate_lines(nothing).count() == 0
    cleaned = line_dedup.with_clean_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.where("doc_id = 3 AND text IS NULL").count() == 1


def test_ngram_join(spark, docs, nothing):
    rows = by_id(ngram_join.near_duplicates(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert {rows[i][0].class_id for i in (1, 2, 6, 7)} == {1} and rows[None][0].class_id == 1
    assert rows[2][0].n_links == 1 and rows[1][0].n_links == 1
    assert rows[3][0].class_id == 3 and rows[4][0].n_links == 0
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_ngram_join_counts_links_across_blocks(spark):
    """A group far larger than a block: links equal those of all pairs."""
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(i % 7):
            words[draw.randrange(150)] = f"z{draw.randrange(5)}"
        texts.append((i, " ".join(words)))
    forest = ngram_join.Forest(block=16, verify_block=8)
    rows = by_id(ngram_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), forest))
    sets = {}
    for i, text in texts:
        words = text.split()
        sets.setdefault(text, (i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)}))
    for i, text in texts:
        mine = sets[text][1]
        links = sum(100 * len(mine & s) >= 80 * len(mine | s) for t, (_, s) in sets.items() if t != text)
        assert rows[i][0].n_links == links


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (7, 7)]
    draw.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 500}


def test_exact_dedup(spark, docs, nothing):
    rows = by_id(exact_dedup.exact_duplicates(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert {rows[i][0].keep_id for i in (1, 6, 7, None)} == {7} and rows[1][0].group_size == 5
    assert [r.kept for r in rows[7]] == [True, True] and not rows[6][0].kept and not rows[None][0].kept
    assert rows[3][0].keep_id == 4 and rows[4][0].kept
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_exact_dedup_is_the_same_on_either_side_of_the_split(spark):
    rows = [(i, "same" if i % 3 else f"Text {i % 40} É") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    results = [sorted(map(tuple, exact_dedup.exact_duplicates(df, heavy_rows=k).collect())) for k in (1, 64, 10**9)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 3000


def test_ascii_lower_leaves_other_letters(spark):
    df = spark.createDataFrame([(1, "ÀB"), (2, "Àb"), (3, "àb")], "doc_id long, text string")
    rows = by_id(exact_dedup.exact_duplicates(df))
    assert rows[1][0].keep_id == 2 and rows[3][0].group_size == 1


def test_toxicity(spark, docs, nothing, labels):
    rows = by_id(toxicity.toxicity(docs, labels))
    assert sum(map(len, rows.values())) == len(ROWS) and all(0 <= r.score <= 1 for rs in rows.values() for r in rs)
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_learns_stems_misspellings_and_counts(spark):
    clean = [" ".join(draw.choice(WORDS) for _ in range(40)) for _ in range(300)]
    bad = [" ".join([draw.choice(WORDS) for _ in range(30)] + [draw.choice(["scoundrel", "grobianisch", "grobianung"])]) for _ in range(60)]
    texts = list(enumerate(clean + bad))
    df = spark.createDataFrame([*texts, (1000, WORDS[0] * 2 + " you scoundrell you"), (1001, PROSE), (1002, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i >= 300)) for i, _ in texts], "doc_id long, toxic int")
    rows = by_id(toxicity.toxicity(df, marks))
    assert rows[1000][0].score >= 0.7 and rows[1001][0].score < 0.7 and rows[1002][0].score < 0.7
    assert all(rows[i][0].score >= 0.7 for i in range(300, 360))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_levenshtein_automaton_by_brute_force():
    entries = ["abcab", "bcabcacbb", "abc", "aabbcc"]
    lexicon = toxicity.Lexicon(entries)
    for _ in range(3000):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 11)))
        found = dict(lexicon.find(word))
        for k, entry in enumerate(entries):
            budget = 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2
            want = toxicity.EXACT if word.startswith(entry) else toxicity.MISSPELLED if distance(word, entry) <= budget else None
            if want is None and len(entry) >= toxicity.FUZZY_STEM and any(distance(word[:n], entry) <= budget for n in range(1, len(word))):
                want = toxicity.MISSPELLED_STEM
            assert found.get(k) == want


def test_quoted_matches_are_told_apart():
    lexicon = toxicity.Lexicon(["scoundrel"])
    assert lexicon.matches("they are a scoundrel") == {(0, toxicity.EXACT): [1, 0]}
    assert lexicon.matches('they said "scoundrel" again') == {(0, toxicity.EXACT): [1, 1]}


def test_packing(docs, nothing):
    rows = packing.pack_documents(docs, vocabulary()).collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths[3] == lengths[4] == 1 and lengths[7] == 2 * lengths[1] and None in lengths
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(nothing, vocabulary()).count() == 0


def test_packing_in_shards(spark):
    df = spark.createDataFrame([(i, "word " * draw.randint(0, 900)) for i in range(400)], "doc_id long, text string")
    rows = packing.pack_documents(df, vocabulary(), shard_pieces=50).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len({r.doc_id for r in rows}) == 400


def test_secrets(spark, docs, nothing):
    rows = secrets.scan_secrets(docs).collect()
    assert [(r.doc_id, r.start, r.length) for r in rows if r.is_secret] == [(11, 9, 40)]
    clean = by_id(secrets.redact(docs, spark.createDataFrame([(r.doc_id, r.start, r.length) for r in rows if r.is_secret], "doc_id long, start long, length long")))
    assert clean[11][0].text == 'token = "[secret]" and 6044423740532315' and clean[3][0].text is None and len(clean[7]) == 2
    assert secrets.scan_secrets(nothing).count() == 0


def test_secrets_learn_from_given_labels(spark):
    """People's labels: codes beside 'order' are harmless, beside 'access' they are not."""
    code = lambda: "".join(draw.choice("abcdef0123456789") for _ in range(24))
    rows = [(i, f"the {'order' if i % 2 else 'access key'} {code()} is here") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(t.split()[2 + (1 - i % 2)], 1 - i % 2) for i, t in rows[:120]], "value string, label int")
    found = by_id(secrets.scan_secrets(df, labelled=marks))
    assert all(found[i][0].is_secret == (i % 2 == 0) for i in range(120, 200))


def test_bpe(docs, nothing):
    rows = by_id(bpe.round_trips(docs, vocabulary()))
    assert rows[3][0].n_tokens == 0 and rows[3][0].decoded == "" and rows[5][0].decoded == LONG
    assert len(rows[7]) == 2 and rows[7][0] == rows[7][1]
    assert bpe.round_trips(nothing, vocabulary()).count() == 0


def test_language_id(spark, docs, nothing):
    rows = by_id(langid.identify(docs, langid.learn(docs)))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert {rows[i][0].lang_pred for i in (3, 4, 8)} == {"und"} and rows[1][0].lang_pred == "en" and rows[6][0].lang_pred == "en"
    untaught = langid.identify(docs, langid.learn(nothing)).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    assert langid.identify(nothing, langid.learn(docs)).count() == 0


def test_ngrams_do_not_cross_texts():
    together, owner, letters = langid.letter_ngrams(["ab c", None, "é", "1"])
    assert letters.tolist() == [3, 0, 1, 0]
    for i, text in enumerate(["ab c", None, "é", "1"]):
        alone, _, _ = langid.letter_ngrams([text])
        assert np.array_equal(np.sort(together[owner == i]), np.sort(alone))


def test_suffix_removal(docs, nothing):
    rows = by_id(suffix_dedup.remove_repeats(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[7][0].n_removed == rows[7][0].n_bytes == len(PROSE) and rows[None][0].n_removed == 0 and rows[1][0].n_removed == 0
    assert (rows[3][0].n_bytes, rows[3][0].n_spans, rows[3][0].kept) == (0, 0, b"") and rows[5][0].n_removed == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_pipeline_on_edges(spark, docs, nothing):
    for table, some in ((docs, True), (nothing, False)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = table.columns
            table = corpus_pipeline.stored(stage(spark, table, ""), name)
            assert table.columns == columns
        packed = corpus_pipeline.STAGES[-1][1](spark, table, "")
        assert (packed.count() > 0) == some
