"""Secret scans with a random forest against false positives (operator 7, DataFrame functions only).

One regular expression proposes candidates; each is described by its length, the
transitions between its characters, how much of it is dictionary words, the path
it may be part of and the words beside it.  A random forest trained on labelled
findings tells secrets from look-alikes.  Transition counts and the dictionary
come from the words around all candidates of the whole corpus.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from prefspark.llm.common import id_and_text, stored, unused

KEYED = r"""(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s{0,2}[=:]\s{0,2}["']?"""
CANDIDATE = KEYED + r"""[^\s"']{6,}|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"""
#: Formats of issued keys, and words that stand in for a secret.
ISSUED = r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[\w-]{10,})$"
PLACEHOLDER = r"(?i)(example|changeme|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}|<|\$\{)"
SECRET_WORDS = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|credential|private|bearer)"
HARMLESS_WORDS = r"(?i)\b(sha\d*|hash|commit|checksum|digest|uuid|isbn|phone|tel|card|order|invoice|example|sample|dummy)\b"
#: Characters of text on each side of a candidate that are looked at.
BESIDE = 80
#: Labelled findings that the forest is trained on: the bound of its sample.
TRAINING_ROWS = 20_000
#: A word is in the dictionary if it stands beside candidates so often.
DICTIONARY_COUNT = 3
THRESHOLD = 0.5
FEATURES = (
    "length", "transition", "class_changes", "distinct_share", "digit_share", "upper_share", "dictionary_share", "slashes", "in_path", "keyed", "secret_words", "harmless_words", "quoted"
)


def findings(texts: DataFrame) -> DataFrame:
    """Every candidate of every whole text: doc_id, start (0-based, in code points), value, keyed, before, after."""
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found")
    ).where(F.size("found") > 0)
    gaps = F.split("text", CANDIDATE, -1)
    parts = F.arrays_zip("found", gaps, F.slice(gaps, 2, F.size("found")))
    each = rows.select("row", "doc_id", F.posexplode(parts).alias("at", "part")).select(
        "row", "doc_id", "at", F.col("part")["found"].alias("match"), F.col("part")["1"].alias("before"), F.col("part")["2"].alias("after")
    )
    each = each.where("match IS NOT NULL")
    order = Window.partitionBy("row").orderBy("at")
    passed = F.sum(F.char_length("before") + F.char_length("match")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lead = F.regexp_extract("match", "^" + KEYED, 0)
    placed = each.select(
        "doc_id", "match", (passed - F.char_length("match")).alias("at"), F.right("before", F.lit(BESIDE)).alias("before"), F.left("after", F.lit(BESIDE)).alias("after"), lead.alias("lead")
    )
    return placed.select(
        "doc_id",
        (F.col("at") + F.char_length("lead")).cast("long").alias("start"),
        F.expr("substring(match, char_length(lead) + 1)").alias("value"),
        (F.col("lead") != "").alias("keyed"),
        F.concat("before", "lead").alias("before"),
        "after",
    )


def _plain(text: Column) -> Column:
    """Lower-case letters; digits as 0, all else as a point."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", ".")


def _pairs(text: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def value_features(found: DataFrame) -> DataFrame:
    """value, transition, dictionary_share of each distinct value.

    The odds of 28 x 28 character pairs are broadcast; the dictionary, every word
    that is not rare beside candidates, meets the values by a shuffle.
    """
    words = found.select(F.explode(F.split(F.lower(F.concat_ws(" ", "before", "after")), "[^a-z]+")).alias("word")).where("char_length(word) >= 2")
    counted = stored(words.groupBy("word").agg(F.count("*").alias("n")), "context-words")
    pairs = counted.select("n", _pairs(F.col("word")).alias("pair")).where("char_length(pair) = 2").groupBy("pair").agg(F.sum("n").alias("n"))
    lead = Window.partitionBy(F.substring("pair", 1, 1))
    odds = pairs.select("pair", F.log2(F.col("n") / F.sum("n").over(lead)).alias("odds"))
    dictionary = counted.where((F.char_length("word") >= 3) & (F.col("n") >= DICTIONARY_COUNT)).select("word")
    values = stored(found.select("value").distinct(), "values")
    transitions = (
        values.select("value", _pairs(_plain(F.col("value"))).alias("pair"))
        .join(F.broadcast(odds), "pair", "left")
        .groupBy("value")
        .agg(F.avg(F.coalesce("odds", F.lit(-12.0))).alias("transition"))
    )
    runs = F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")
    covered = values.select("value", runs).join(dictionary, "word").groupBy("value").agg(F.sum(F.char_length("word")).alias("covered"))
    share = F.coalesce("covered", F.lit(0)) / F.char_length("value")
    return transitions.join(covered, "value", "left").select("value", "transition", share.alias("dictionary_share"))


def described(found: DataFrame) -> DataFrame:
    """Findings with all the forest's features."""
    value, length = F.col("value"), F.char_length("value")
    share = lambda pattern: F.char_length(F.regexp_replace(value, pattern, "")) / length
    changes = F.regexp_count(value, F.lit(r"(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])")) / length
    near = F.right("before", F.lit(32))
    columns = {
        "length": length.cast("double"),
        "class_changes": changes,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / length,
        "digit_share": share("[^0-9]"),
        "upper_share": share("[^A-Z]"),
        "slashes": F.regexp_count(value, F.lit("/")).cast("double"),
        "in_path": (F.rlike("before", F.lit(r"(/|://\S*)$")) | F.rlike("after", F.lit(r"^[./]\w"))).cast("double"),
        "keyed": F.col("keyed").cast("double"),
        "secret_words": F.rlike(near, F.lit(SECRET_WORDS)).cast("double"),
        "harmless_words": F.rlike(near, F.lit(HARMLESS_WORDS)).cast("double"),
        "quoted": F.rlike("before", F.lit(r"[\"'`]$")).cast("double"),
    }
    extra = value_features(found).withColumnRenamed("value", "same_value")
    return found.select("doc_id", "start", "value", "before", F.col("keyed").alias("is_keyed"), *[c.alias(n) for n, c in columns.items()]).join(
        extra, F.col("value") == F.col("same_value")
    )


def seed_label(value: Column, keyed: Column, before: Column) -> Column:
    """Labels where the finding speaks for itself: 1 secret, 0 look-alike, else null.

    Issued formats and keyed random digits-and-letters are secrets; bare numbers,
    bare words and placeholders are not.
    """
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    return (
        F.when(F.rlike(value, F.lit(PLACEHOLDER)), 0)
        .when(F.rlike(value, F.lit(ISSUED)), 1)
        .when(keyed & mixed & (F.char_length(value) >= 12) & F.rlike(value, F.lit("^[A-Za-z0-9+/_=-]+$")), 1)
        .when(~keyed & F.rlike(value, F.lit("^([0-9_=+/-]+|[A-Za-z_=+/-]+)$")), 0)
        .when(~mixed & F.rlike(before, F.lit(HARMLESS_WORDS)), 0)
    )


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """One row per finding: doc_id, start, length, value, keyed, probability, is_secret.

    Starts and lengths count code points of the whole text.  ``labelled`` (value,
    label 0/1) are findings people have judged; without it, findings that speak
    for themselves are the labels.  The forest is trained on at most
    ``TRAINING_ROWS`` distinct labelled values, in the order of their hashes, and
    judges every finding.  With labels of one kind only, that kind is every
    labelled finding's verdict and a keyed value counts as secret.  Null and
    empty texts have no finding; a repeated row has its findings again.
    """
    found = stored(findings(id_and_text(df, id_col, text_col)), "findings")
    label = seed_label(F.col("value"), F.col("is_keyed"), F.col("before"))
    facts = described(found)
    if labelled is None:
        facts = facts.withColumn("label", label)
    else:
        marks = labelled.where("label IS NOT NULL").groupBy(F.col("value").alias("marked")).agg(F.max("label").alias("label"))
        facts = facts.join(marks, F.col("value") == F.col("marked"), "left").drop("marked")
    facts = stored(facts.withColumn("features", F.array(*[F.col(c).cast("double") for c in FEATURES])), "described")
    known = facts.where("label IS NOT NULL")
    # Values that repeat in many documents count once; which of them is seen does not depend on partitions.
    once = known.groupBy("value").agg(F.min(F.struct("features", "label")).alias("x")).select("value", "x.*")
    sample = stored(once.orderBy(F.xxhash64("value"), "value").limit(TRAINING_ROWS).select(array_to_vector("features").alias("features"), F.col("label").cast("double")), "labelled")
    kinds = {int(r["label"]) for r in sample.select("label").distinct().collect()}
    base = facts.select("doc_id", "start", F.char_length("value").cast("long").alias("length"), "value", F.col("is_keyed").alias("keyed"), "label", array_to_vector("features").alias("features"))
    if kinds == {0, 1}:
        forest = RandomForestClassifier(labelCol="label", numTrees=30, maxDepth=6, seed=1).fit(sample)
        judged = forest.transform(base).withColumn("chance", vector_to_array("probability")[1])
    else:
        judged = base.withColumn("chance", F.coalesce(F.col("label").cast("double"), F.col("keyed").cast("double")))
    return judged.select("doc_id", "start", "length", "value", "keyed", F.col("chance").alias("probability"), (F.col("chance") >= THRESHOLD).alias("is_secret"))


def redact(df: DataFrame, secrets: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with the secrets of its texts replaced; all columns and rows stay.

    ``secrets``: doc_id, start, length of spans to replace.  They do not overlap;
    spans that repeated rows gave twice count once.
    """
    span_id, found = unused(df, "span_id"), unused(df, "spans")
    span = F.struct("start", "length")
    spans = secrets.groupBy(F.col("doc_id").alias(span_id)).agg(F.array_sort(F.collect_set(span)).alias(found))
    text = F.col(f"`{text_col}`")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(found, lambda s: s["start"] + s["length"]))
    ends = F.concat(F.transform(found, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    joined = df.join(spans, df[id_col].cast("long") == F.col(span_id), "left")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(F.array_join(pieces, mark))).select(*[F.col(f"`{c}`") for c in df.columns])
