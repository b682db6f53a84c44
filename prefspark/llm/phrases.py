"""Phrase collocation mining by best-first branch-and-bound growth (operator 11).

Phrases grow from their first word, a word at a time, through the trie of
frequent phrases.  A phrase scores its lowest cut, and the cut after the first
word alone gives at most ``1000 * n / f(first word)``, because the rest of a
phrase occurs at least as often as the phrase.  The count of its first word thus
bounds every phrase of a subtree.  Each language's frontier is expanded from the
highest bound (the rarest frequent first words) down, a range of bounds per
round, until the last score that is wanted lies above the bound of all that is
left; ties are expanded too.

Words become ids first.  A slice of text carries the ids and the counts of its
own frequent words, so no task holds the vocabulary, and growth counts arrays of
integers.  Frontier phrases are sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from prefspark.llm.common import stored
from prefspark.session import discard, scratch_path

UNKNOWN = "und"
#: Ends a piece; no word can hold it.
BREAK = b"."
#: A-Z to lower case, what ends a piece to ``BREAK``, a tab to a blank.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else BREAK[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256)
)
#: Bytes of text whose words get ids together.
SLICE = 8 << 20
_GROWN = ["parent", "word", "n", "low", "high"]
#: Widest phrase that a padded slice allows for.
PAD = 16


@dataclass(frozen=True)
class Mining:
    """Longest phrase, least count, phrases returned per language.

    first_words: first words that a language expands in its first round, and
    growth: how many times more in each later one.  They decide how much work a
    round has and never the result.  block: phrases sent to the tasks at a time.
    shares: pairs of at most one in so many words are counted at a time.
    """

    longest: int = 5
    least: int = 100
    top: int = 2000
    first_words: int = 8000
    growth: int = 4
    block: int = 200_000
    shares: int = 4


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    start = 0
    while len(text) - start > size:
        end = text.rfind(BREAK, start + 1, start + size)
        if end < 0:  # one piece longer than the size stays whole
            end = text.find(BREAK, start + size)
            if end < 0:
                break
        yield text[start:end]
        start = end
    yield text[start:]


def word_ids(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of translated texts, and their ids from 1 on in order of appearance; 0 ends a piece."""
    joined = (b" " + BREAK + b" ").join(t.replace(BREAK, b" " + BREAK + b" ") for t in texts)
    words = pc.ascii_split_whitespace(pa.array([joined], pa.large_binary()).cast(pa.large_string())).flatten()
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    names = distinct.to_pylist()
    real = np.fromiter((w not in ("", BREAK.decode()) for w in names), bool, len(names))
    new = np.where(real, np.cumsum(real), np.fromiter((-1 if w == "" else 0 for w in names), np.int64, len(names)))
    ids = new[coded.indices.to_numpy(zero_copy_only=False)]
    return distinct.filter(pa.array(real)).cast(pa.string()), ids[ids >= 0].astype(np.int32)


def tokenized(texts: DataFrame, size: int = SLICE) -> DataFrame:
    """Slices of one language each: slice, lang, size, words, counts, ids (int32, packed, as they are shuffled once)."""
    names = ["slice", "lang", "size", "words", "counts", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, sizes = TaskContext.get().partitionId() << 33, {}, {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            words, ids = word_ids(waiting.pop(lang))
            del sizes[lang]
            number += 1
            counts = np.bincount(ids, minlength=len(words) + 1)[1:]
            ends = pa.array([0, len(words)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (words, pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([lang]), pa.array([len(ids)]), *lists, pa.array([pa.compress(ids, "zstd", asbytes=True)], pa.binary())], names=names)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                name = lang.as_py()
                for part in _cut((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_TABLE), size):
                    waiting.setdefault(name, []).append(part)
                    sizes[name] = sizes.get(name, 0) + len(part) + 3
                    if sizes[name] >= size:
                        yield flush(name)
                if sum(sizes.values()) >= 2 * size:
                    yield flush(max(sizes, key=sizes.get))
        for name in list(waiting):
            yield flush(name)

    return texts.mapInArrow(run, "slice long, lang string, size long, words array<string>, counts array<long>, ids binary")


def frequent_words(slices: DataFrame, least: int) -> DataFrame:
    """lang, word, f, gid, slice, at, id: each place where a slice lists a word that occurs so often; gid is the word's least id.

    Counting, numbering and placing share one shuffle, whatever the size of the
    vocabulary.  A slice lists a word once, so a word has as many places as slices at most.
    """
    words = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    rows = words.select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), "slice", "at", (F.monotonically_increasing_id() + 1).alias("id"))
    same = Window.partitionBy("lang", "word")
    counted = rows.withColumn("f", F.sum("n").over(same)).withColumn("gid", F.min("id").over(same))
    return counted.where(F.col("f") >= least).drop("n")


def coded(slices: DataFrame, places: DataFrame) -> DataFrame:
    """Slices in which only frequent words are left: lang, gids and counts (int64, by gid), ids (int32 places in gids, from 1).

    Rare words end phrases as a piece's end does: no candidate holds one, and slices without others go.
    """
    known = places.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("gid", "f", "at"))).alias("known"))
    joined = slices.select("slice", "lang", "size", "ids", F.size("words").alias("n_words")).join(known, "slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, size, packed, n_words = (batch.column(k)[i].as_py() for k in range(4))
                raw = pa.decompress(packed, 4 * size, "zstd", asbytes=True) if size else b""
                entries = batch.column(4)[i].values
                gids, counts, at = (np.asarray(entries.field(k)) for k in range(3))
                new = np.zeros(n_words + 1, np.int32)
                new[at + 1] = np.arange(1, len(at) + 1)
                ids = new[np.frombuffer(raw, np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), *(pa.array([x.tobytes()], pa.binary()) for x in (gids.astype(np.int64), counts.astype(np.int64), ids))],
                    names=["lang", "gids", "counts", "ids"],
                )

    return joined.select("lang", "size", "ids", "n_words", "known").mapInArrow(run, "lang string, gids binary, counts binary, ids binary")


@dataclass
class Slice:
    """One slice in memory: global ids and counts of its words, and local ids padded with ends on both sides."""

    lang: str
    gids: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a row of ``grams`` (global ids) begins, and which row it is: a walk down the rows' trie."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(grams) or not len(self.gids):
            return nothing
        local = np.minimum(np.searchsorted(self.gids, grams), len(self.gids) - 1)
        here = np.flatnonzero((self.gids[local] == grams).all(1))
        if not len(here):
            return nothing
        local, wide = local[here].astype(np.int64) + 1, np.int64(len(self.gids) + 1)
        starts = np.zeros(len(self.gids) + 1, bool)
        starts[local[:, 0]] = True
        place = np.flatnonzero(starts[self.ids])
        rank, row = self.ids[place].astype(np.int64), local[:, 0]
        for k in range(1, grams.shape[1]):
            nodes, row = np.unique(row * wide + local[:, k], return_inverse=True)
            key = rank * wide + self.ids[place + k]
            rank = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
            hit = nodes[rank] == key
            place, rank = place[hit], rank[hit]
        which = np.zeros(int(row.max()) + 1, np.int64)
        which[row] = here
        return place, which[rank]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for i in range(batch.num_rows):
            lang, gids, counts, ids = (c[i].as_py() for c in batch.columns)
            ends = np.zeros(PAD, np.int32)
            yield Slice(lang, np.frombuffer(gids, np.int64), np.frombuffer(counts, np.int64), np.concatenate([ends, np.frombuffer(ids, np.int32), ends]))


def _following(part: Slice, place: np.ndarray, number: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (phrase number, next word's gid) of the phrases at ``place``, and their counts."""
    word = part.ids[place + width]
    wide = np.int64(len(part.gids) + 1)
    key, n = np.unique((number * wide + word)[word > 0], return_counts=True)
    return key // wide, part.gids[key % wide - 1], n


def _pairs(slices: DataFrame, ranges: dict[str, tuple[int, int]], block: int, blocks: int) -> DataFrame:
    """parent, word, n: phrases of two words whose first word's count lies in the language's range; one of ``blocks`` shares of them by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            low, high = ranges.get(part.lang, (0, 0))
            place = np.flatnonzero(np.concatenate([[False], (part.counts >= low) & (part.counts < high)])[part.ids])
            if blocks > 1:
                mixed = np.concatenate([[0], part.gids]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                both = (mixed[part.ids[place]] ^ (mixed[part.ids[place + 1]] >> np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9)
                place = place[(both >> np.uint64(33)) % np.uint64(blocks) == block]
            number, word, n = _following(part, place, part.ids[place].astype(np.int64) - 1, 1)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(part.gids[number]), pa.array(word), pa.array(n)], names=["parent", "word", "n"])

    return slices.mapInArrow(run, "parent long, word long, n long")


def _blocks(df: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """The rows in blocks of about ``size``, dealt by hash: what is sent to all tasks at a time is bounded."""
    count = -(-df.count() // size)
    for block in range(count):
        yield df.where(F.pmod(F.xxhash64(key), F.lit(count)) == block)


def _matrix(grams: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(pa.concat_arrays([c.flatten() for c in grams.chunks]) if grams.num_chunks else pa.array([], pa.int64())).reshape(-1, width)


def _longer(slices: DataFrame, phrases: DataFrame, width: int, block: int) -> DataFrame:
    """Phrases one word longer than the given ones of ``width`` words: parent, word, n.

    A row with word 0 is the phrase itself, with the least and greatest word that
    comes before it (0: none or a rare one).
    """
    parts = []
    for part in _blocks(phrases.select("node", "grams"), "node", block):
        table = part.toArrow()
        grams, nodes = _matrix(table["grams"], width), np.asarray(table["node"])

        def run(batches: Iterator[pa.RecordBatch], grams=grams, nodes=nodes) -> Iterator[pa.RecordBatch]:
            low, high = np.full(len(nodes), np.iinfo(np.int64).max), np.full(len(nodes), -1)
            for s in _slices(batches):
                place, number = s.find(grams)
                before = np.concatenate([[0], s.gids])[s.ids[place - 1]]
                np.minimum.at(low, number, before)
                np.maximum.at(high, number, before)
                number, word, n = _following(s, place, number, width)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[number]), pa.array(word), pa.array(n), none, none], names=_GROWN)
            met = np.flatnonzero(high >= 0)
            zero = pa.array(np.zeros(len(met), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[met]), zero, zero, pa.array(low[met]), pa.array(high[met])], names=_GROWN)

        parts.append(slices.mapInArrow(run, "parent long, word long, n long, low long, high long"))
    return reduce(DataFrame.unionByName, parts)


def _counted(slices: DataFrame, wanted: DataFrame, longest: int, block: int) -> DataFrame:
    """grams, r: how often each wanted phrase (two words or more) occurs."""
    parts = []
    for part in _blocks(wanted, "grams", block):
        table = part.toArrow()
        by_width = []
        for width in range(2, longest):
            rows = np.flatnonzero(np.asarray(pc.list_value_length(table["grams"])) == width)
            by_width.append((rows, _matrix(table["grams"].take(pa.array(rows)), width)))
        sent = table["sid"].to_numpy()

        def run(batches: Iterator[pa.RecordBatch], by_width=by_width, sent=sent) -> Iterator[pa.RecordBatch]:
            found = np.zeros(len(sent), np.int64)
            for s in _slices(batches):
                for rows, grams in by_width:
                    found[rows] += np.bincount(s.find(grams)[1], minlength=len(rows))
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(sent[some]), pa.array(found[some])], names=["sid", "n"])

        parts.append(slices.mapInArrow(run, "sid long, n long"))
    return reduce(DataFrame.unionByName, parts).groupBy("sid").agg(F.sum("n").alias("r"))


def _number(df: DataFrame, name: str, what: str) -> DataFrame:
    """Stored with a unique id per row, which storing fixes."""
    return stored(df.withColumn(name, F.monotonically_increasing_id() + 1), what)


def _whole(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def _ratio(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), in 38 digits."""
    above = (_whole(a) * _whole(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (_whole(left) * _whole(right)).cast("decimal(38,0)"))


def _grow(slices: DataFrame, frequent: DataFrame, ranges: dict[str, tuple[int, int]], shares: int, shape: Mining) -> DataFrame:
    """All candidates whose first word lies in its language's range and that no longer candidate swallows.

    lang, phrase, grams (word ids), before (counts of the phrase's beginnings, its own last), singles (counts of its words).
    Phrases of two words, by far the most, are counted in ``shares``, one after the other.
    """
    word = frequent.select(F.col("gid").alias("word"), "lang", F.col("word").alias("name"), "f")
    first = word.select(
        F.col("word").alias("node"), "lang", F.col("name").alias("phrase"), F.array("word").alias("grams"), F.array("f").alias("before"), F.array("f").alias("singles")
    )

    def level(counted: DataFrame, shorter: DataFrame, width: int) -> DataFrame:
        joined = counted.where(F.col("a") >= shape.least).join(shorter.withColumnRenamed("node", "parent"), "parent").join(word.drop("lang"), "word")
        extended = joined.select(
            "lang",
            "parent",
            "a",
            F.concat_ws(" ", "phrase", "name").alias("phrase"),
            F.concat("grams", F.array("word")).alias("grams"),
            F.concat("before", F.array("a")).alias("before"),
            F.concat("singles", F.array("f")).alias("singles"),
        )
        return _number(extended, "node", f"phrases-{width}")

    pairs = []
    for share in range(shares):
        counted = _pairs(slices, ranges, share, shares).groupBy("parent", "word").agg(F.sum("n").alias("a"))
        pairs.append(stored(counted.where(F.col("a") >= shape.least), "pair-counts"))
    here, surviving = level(reduce(DataFrame.unionByName, pairs), first, 2), []
    for width in range(2, shape.longest):
        if here.isEmpty():
            break
        grown = _longer(slices, here, width, shape.block).groupBy("parent", "word")
        grown = stored(grown.agg(F.sum("n").alias("a"), F.min("low").alias("low"), F.max("high").alias("high")), "grown")
        # Every occurrence follows the same word: the phrase with that word in front occurs as often.
        led = grown.where("word = 0 AND low = high AND low > 0").select(F.col("parent").alias("node"))
        longer = level(grown.where("word > 0").select("parent", "word", "a"), here.drop("parent", "a"), width + 1)
        # So it does where it always goes on the same way.
        same = longer.select(F.col("parent").alias("node"), "a")
        surviving.append(here.join(led, "node", "left_anti").join(same, ["node", "a"], "left_anti"))
        here = longer
    surviving.append(here)
    columns = ["lang", "phrase", "grams", "before", "singles"]
    return _number(reduce(DataFrame.unionByName, [x.select(*columns) for x in surviving]), "uid", "survivors")


def _thresholds(scored: DataFrame, top: int) -> DataFrame:
    """lang, last: the score of the last phrase wanted, where there are so many."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return scored.select("lang", "score", place.alias("place")).where(F.col("place") == top).select("lang", F.col("score").alias("last"))


def _scored(slices: DataFrame, phrases: DataFrame, totals: DataFrame, known: DataFrame | None, shape: Mining) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases that may still be among the first."""
    a, size = F.element_at("before", -1), F.size("grams")
    last = _ratio(a, F.col("n"), F.element_at("before", -2), F.element_at("singles", -1))
    bound = F.least(last, _ratio(F.lit(1), F.col("n"), F.element_at("before", 1), F.lit(1)))
    bounded = phrases.join(F.broadcast(totals), "lang").withColumn("bound", bound)
    result = ["lang", "phrase", "a", "l", "r", "n", "score"]
    pairs = bounded.where(size == 2).select(
        "lang", "phrase", a.alias("a"), F.element_at("before", 1).alias("l"), F.element_at("singles", 2).alias("r"), "n", last.alias("score")
    )
    pairs = stored(pairs, "pairs")
    exact = pairs if known is None else known.unionByName(pairs)
    # One row per language, as totals.
    longer = bounded.where(size > 2).join(F.broadcast(_thresholds(exact, shape.top)), "lang", "left").where("last IS NULL OR bound >= last")
    longer = stored(longer.drop("last"), "longer")
    if longer.isEmpty():
        return pairs
    cuts = longer.select("uid", "grams", F.explode(F.sequence(F.lit(1), size - 2)).alias("k")).select(
        "uid", "k", F.slice("grams", F.col("k") + 1, F.size("grams") - F.col("k")).alias("grams")
    )
    wanted = _number(cuts.select("grams").distinct(), "sid", "endings")
    endings = wanted.join(stored(_counted(slices, wanted, shape.longest, shape.block), "ending-counts"), "sid").select("grams", "r")
    rest = cuts.join(endings, "grams").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("rest"))

    def at(k: Column) -> Column:
        right = F.when(k == size - 1, F.element_at("singles", -1)).otherwise(F.col("rest")[k])
        return F.struct(_ratio(a, F.col("n"), F.get("before", k - 1), right).alias("score"), k.alias("k"), F.get("before", k - 1).alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), at))
    scored = longer.join(rest, "uid").withColumn("best", best)
    return pairs.unionByName(stored(scored.select("lang", "phrase", a.alias("a"), "best.l", "best.r", "n", "best.score").select(*result), "scored"))


class _Frontier:
    """What a language has not expanded yet: ranges of first-word counts, rarest first, with their numbers of words and occurrences."""

    def __init__(self, n: int, shape: Mining):
        self.n, self.steps, self.words, self.last = n, [], shape.first_words, None

    def advance(self, growth: int) -> tuple[tuple[int, int], int]:
        """The counts [low, high) to expand now, and the occurrences of their words; nothing that is below the last wanted score already."""
        low, taken, occurrences = self.steps[0][0], 0, 0
        while not taken or not self.settled() and taken + self.steps[0][1] <= self.words:
            _, words, some = self.steps.pop(0)
            taken, occurrences = taken + words, occurrences + some
        self.words *= growth
        return (low, self.steps[0][0] if self.steps else 2**62), occurrences

    def settled(self) -> bool:
        """Whether nothing left can reach the score of the last phrase wanted, not even as a tie."""
        return not self.steps or (self.last is not None and 1000 * self.n // self.steps[0][0] < self.last)


def collocations(df: DataFrame, shape: Mining = Mining(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``; null and empty texts have no words.  Repeated rows
    count as often as they occur.  Ties in score go by count, then by the phrase's
    bytes, so the result is unique.  A language without candidates has no rows, an
    empty table none at all.  Columns other than the two do not travel.
    """
    if shape.longest > PAD:
        raise ValueError(f"phrases of more than {PAD} words are not supported")
    texts = df.select(F.coalesce(df[lang_col], F.lit(UNKNOWN)).alias("lang"), df[text_col].alias("text"))
    spark = df.sparkSession
    path = scratch_path(spark, "slices")
    tokenized(texts).write.option("compression", "zstd").parquet(path)
    slices = spark.read.parquet(path)
    totals = stored(slices.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n")), "totals")
    places = stored(frequent_words(slices, shape.least), "places")
    frequent = stored(places.where("id = gid").select("gid", "lang", "word", "f"), "words")
    slices = stored(coded(slices, places), "coded")
    discard(spark, path)
    n_words = {row.lang: row.n for row in totals.collect()}
    open_: dict[str, _Frontier] = {}
    # Sixteen steps for each doubling of the count: a few hundred rows per language.
    step = F.floor(16 * F.log2(F.col("f") / F.lit(shape.least)))
    for row in frequent.groupBy("lang", step.alias("step")).agg(F.min("f").alias("low"), F.count("*").alias("words"), F.sum("f").alias("n")).orderBy("low").collect():
        open_.setdefault(row.lang, _Frontier(n_words[row.lang], shape)).steps.append((row.low, row.words, row.n))
    scored = None
    while open_:
        moves = {lang: f.advance(shape.growth) for lang, f in open_.items()}
        shares = -(-sum(n for _, n in moves.values()) * shape.shares // sum(n_words.values()))
        grown = _grow(slices, frequent, {lang: r for lang, (r, _) in moves.items()}, shares, shape)
        new = _scored(slices, grown, totals, scored, shape)
        scored = new if scored is None else scored.unionByName(new)
        for row in _thresholds(scored, shape.top).where(F.col("lang").isin(list(open_))).collect():
            open_[row.lang].last = row["last"]
        open_ = {lang: f for lang, f in open_.items() if not f.settled()}
    if scored is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= shape.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
