"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from prefspark.llm import (
    bpe,
    exact_dedup,
    langid,
    line_dedup,
    ngram_join,
    packing,
    phrases,
    quality_rules,
    search,
    secrets,
    simhash,
    suffix_dedup,
    toxicity,
)
from prefspark.llm.common import documents, sha256, vocabulary


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), with_text=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicate_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_removed", sha256(F.col("text")).alias("kept_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    scored = toxicity.toxicity(docs, labels.where(~out))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return scored.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"), "n_entries")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "start", "length", sha256(F.col("value")).alias("value_sha256"), "keyed", "probability", "is_secret")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), vocabulary())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.held_out(F.col("doc_id"), 4, 2)
    filters = langid.learn(docs.where(~out))
    return langid.identify(docs, filters).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search.search(search.build_index(docs), docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_line_dedup,
        op3_ngram_jaccard,
        op4_exact_dedup,
        op5_toxicity,
        op6_best_fit_packing,
        op7_secret_scan,
        op8_bpe,
        op9_language_id,
        op10_suffix_dedup,
        op11_phrase_mining,
        op12_simhash,
        op13_lexical_search,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, text FROM d
),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
tri AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS gram
  FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM tri WHERE gram IS NOT NULL) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS s(k) GROUP BY 1),
line AS (
  SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    length(regexp_replace(line, '[^|]', '', 'g')) AS bars,
    length(regexp_replace(line, '[^!]', '', 'g')) AS marks,
    regexp_extract(line, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
),
judged AS (
  SELECT *, 3 * bars > words OR 3 * symbols > 2 * words OR 2 * marks > words + 1
    OR (words < {quality_rules.SHORT_LINE_WORDS} AND strpos('{quality_rules.LINE_ENDS.replace("'", "''")}', last) = 0)
    OR regexp_matches(line, '{quality_rules.BOILERPLATE}') AS failed
  FROM line WHERE words > 0
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(chars) AS word_chars, sum(symbols) AS n_symbols,
    sum(CASE WHEN failed THEN 1 ELSE 0 END) AS n_failed_lines, sum(CASE WHEN failed THEN chars ELSE 0 END) AS lost_chars
  FROM judged GROUP BY 1
),
r AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed,
    coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept, n_failed_lines, lost_chars FROM r
""",
    "op2_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
),
f AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (
  SELECT doc_id, i AS s, lead(i, 2) OVER p AS e, line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p AS win
  FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
later AS (
  SELECT doc_id, s, e FROM (
    SELECT *, rank() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM w WHERE win IS NOT NULL
  ) WHERE n > 1
),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN later ON l.doc_id = later.doc_id AND l.i BETWEEN later.s AND later.e),
m AS (SELECT l.doc_id, l.i, l.line, gone.i IS NOT NULL AS removed FROM l LEFT JOIN gone USING (doc_id, i))
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN removed THEN 1 ELSE 0 END)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM m GROUP BY 1
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
t AS (SELECT words, min(doc_id) AS node, count(*) AS n_copies FROM w WHERE len(words) > 0 GROUP BY 1),
s AS (
  SELECT DISTINCT node, array_to_string(words[i + 1:i + least(5, len(words))], ' ') AS gram
  FROM (SELECT node, words, unnest(range(greatest(1, len(words) - 4))) AS i FROM t)
),
n AS (SELECT node, count(*) AS size FROM s GROUP BY 1),
pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.node <> b.node GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pairs JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE 100 * shared >= 80 * (x.size + y.size - shared)
),
reach AS (SELECT a AS node, b AS other FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a),
class AS (SELECT node, least(node, min(other)) AS class_id FROM reach GROUP BY 1),
degree AS (SELECT a AS node, count(*) AS n_links FROM link GROUP BY 1)
SELECT w.doc_id, coalesce(class_id, t.node, w.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM w LEFT JOIN t ON t.words = w.words LEFT JOIN class ON class.node = t.node LEFT JOIN degree ON degree.node = t.node
""",
    "op4_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""",
    "op11_phrase_mining": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (
  SELECT lang, k AS m, words[i:i + k - 1] AS words, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE i + k - 1 <= len(words) GROUP BY 1, 2, 3
),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, words, f AS a FROM g WHERE m > 1 AND f >= 100),
inner_ AS (
  SELECT lang, words[i:i + k - 1] AS words, max(a) AS f
  FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM c), (VALUES (2), (3), (4)) AS s(k)
  WHERE k < m AND i + k - 1 <= m GROUP BY 1, 2
),
left_ AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN inner_ USING (lang, words) WHERE f IS NULL OR f < a),
cuts AS (
  SELECT c.lang, c.words, c.a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM left_ AS c JOIN n USING (lang)
  JOIN g AS x ON x.lang = c.lang AND x.words = c.words[1:k]
  JOIN g AS y ON y.lang = c.lang AND y.words = c.words[k + 1:]
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS p FROM cuts) WHERE p = 1),
ranked AS (
  SELECT *, array_to_string(words, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
    "op13_lexical_search": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY 1, 2
),
size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), whole
),
m AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM size, whole),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""",
}
