"""Toxicity by a learned lexicon, Levenshtein automata and context windows (operator 5).

The lexicon is learned from a bounded number of labelled texts: word beginnings
that toxic ones have and clean ones lack, chosen greedily so that together they
cover the toxic texts.  A trie of it, intersected with Levenshtein automata, finds its entries in
a text exactly and misspelled.  Each way of matching an entry gets a weight from
all training rows, and a match in a quoting context counts by what quoted
matches turned out to mean there.  The share of toxic training rows and a text's
summed evidence give the score as odds.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.bpe import in_slices
from prefspark.llm.common import id_and_text, stored

#: Shortest and longest word beginning that can become an entry.
STEM_LENGTHS = (4, 16)
#: Toxic texts that a beginning needs, and new ones that it must add to the cover.
SUPPORT, NEW_TEXTS = 3, 2
#: Labelled texts of each label that the lexicon is learned from, and toxic ones from which its cover is chosen.
LEARNING_ROWS, COVER_ROWS = 25_000, 20_000
#: A beginning is this much likelier in toxic texts.
LIFT = 8.0
#: Entries of so many letters may be misspelled by one edit, or by two.
ONE_EDIT, TWO_EDITS = 5, 9
#: Misspelled beginnings of longer words are looked for from this length on.
FUZZY_STEM = 7
#: Words to each side of a match that are its context.
WINDOW = 8
QUOTES = re.compile(
    r"[\"“”„«»‹›]|\b(said|says|wrote|writes|called|quote[sd]?|quoted|word|term|sagte|schrieb|zitat|dijo|escribió|cita|dit|écrit|citation)\b"
)
EXACT, MISSPELLED, MISSPELLED_STEM = 0, 1, 2
#: Matches of an entry in a text are told apart up to so many.
TIMES = 4
REMEMBERED = 600_000

_WORDS = re.compile(r"\w+").findall


class Lexicon:
    """A trie of entries and, on demand, the deterministic automaton of their misspellings."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for k, entry in enumerate(entries):
            node = 0
            for char in entry:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][char]
            self.ends[node] = k
        self.budget = [0 if len(e) < ONE_EDIT else 1 if len(e) < TWO_EDITS else 2 for e in entries]
        # Edits that any entry below a node allows: states beyond that are dead.
        self.allowed = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            own = self.budget[self.ends[node]] if self.ends[node] >= 0 else 0
            self.allowed[node] = max([own, *(self.allowed[c] for c in self.children[node].values())])
        self.seen: dict[str, tuple] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.start = self._state({(0, 0)})

    def _state(self, positions: set[tuple[int, int]]) -> int:
        """Number of a state; skipping letters of an entry costs an edit each."""
        best: dict[int, int] = {}
        todo = list(positions)
        while todo:
            node, edits = todo.pop()
            if edits > self.allowed[node] or best.get(node, 9) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.accepts.append(tuple(k for node, edits in best.items() if (k := self.ends[node]) >= 0 and edits <= self.budget[k]))
        return self.number[key]

    def _step(self, state: int, char: str) -> int:
        positions = set()
        for node, edits in self.states[state]:
            positions.add((node, edits + 1))  # a letter too many
            for letter, child in self.children[node].items():
                positions.add((child, edits + (letter != char)))
        return self._state(positions)

    def find(self, word: str) -> tuple[tuple[int, int], ...]:
        """(entry, way of matching) for every entry that the word matches."""
        if (known := self.seen.get(word)) is not None:
            return known
        found: dict[int, int] = {}
        node = 0
        for char in word:
            node = self.children[node].get(char, -1)
            if node < 0:
                break
            if self.ends[node] >= 0:
                found[self.ends[node]] = EXACT
        state, last = self.start, len(word) - 1
        for i, char in enumerate(word):
            onward = self.steps[state].get(char)
            if onward is None:
                onward = self.steps[state][char] = self._step(state, char)
            state = onward
            if not self.states[state]:
                break
            for k in self.accepts[state]:
                if i == last:
                    if found.get(k) != EXACT:
                        found[k] = MISSPELLED
                elif len(self.entries[k]) >= FUZZY_STEM:
                    found.setdefault(k, MISSPELLED_STEM)
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        if len(self.states) > 100_000:
            self._reset()
        self.seen[word] = result = tuple(found.items())
        return result

    def matches(self, text: str) -> dict[tuple[int, int], list[int]]:
        """(entry, way) -> [occurrences, those of them in a quoting context]."""
        low = text.lower()
        words = _WORDS(low)
        hit = {w: m for w in set(words) if (m := self.find(w))}
        if not hit:
            return {}
        spans = [m.span() for m in re.finditer(r"\w+", low)]
        found: dict[tuple[int, int], list[int]] = {}
        for i, word in enumerate(words):
            if word in hit:
                a, b = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
                quoted = QUOTES.search(low[max(0, a - 1) : b + 1]) is not None
                for match in hit[word]:
                    cell = found.setdefault(match, [0, 0])
                    cell[0] += 1
                    cell[1] += quoted
        return found


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many toxic and clean texts a word occurs, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(set(_WORDS(text.lower())))
            for toxic in (0, 1):
                words, n = list(counts[toxic]), list(counts[toxic].values())
                zeros = [0] * len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array(n if toxic else zeros, pa.int64()), pa.array(zeros if toxic else n, pa.int64())], names=["word", "toxic", "clean"]
                )

    counted = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Entries from labelled rows (text, toxic).

    All rows count for the candidates: beginnings in at least ``SUPPORT`` toxic
    texts that are ``LIFT`` times as frequent in these, and more often than chance
    would bring one of so many beginnings there (a likelihood ratio).  A beginning
    that only one longer one continues in all its texts gives way to that.  The
    cover is chosen from a bounded number of toxic texts, equal texts once, taken
    in the order of their digests.
    """
    totals = rows.groupBy("toxic").count().collect()
    n = {int(r["toxic"]): r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        return []
    low, high = STEM_LENGTHS
    lengths = F.sequence(F.lit(low), F.least(F.char_length("word"), F.lit(high)))
    stems = (
        word_counts(rows)
        .where(F.char_length("word") >= low)
        .select(F.explode(F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).alias("stem"), "toxic", "clean")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= SUPPORT)
    )
    stems = stored(stems, "stems")
    tested = max(1, stems.count())
    toxic, clean, both = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    rate = n[1] / (n[0] + n[1])
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (both * share))).otherwise(0.0)
    surprise = 2 * (part(toxic, rate) + part(clean, 1 - rate))
    likely = (toxic / n[1] >= LIFT * (clean + 3) / n[0]) & (surprise >= 2 * float(np.log(tested)))
    # The first so many letters of a longer beginning that has the same counts.
    shorter = F.expr("substring(stem, 1, char_length(stem) - 1)").alias("shorter")
    longer = stems.select(shorter, toxic.alias("same_toxic"), clean.alias("same_clean"))
    same = (F.col("stem") == F.col("shorter")) & (toxic == F.col("same_toxic")) & (clean == F.col("same_clean"))
    known = {r["stem"] for r in stems.where(likely).join(longer, same, "left_anti").select("stem").collect()}
    if not known:
        return []

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [
                sorted({w[:k] for w in set(_WORDS(text.lower())) for k in range(low, min(high, len(w)) + 1)} & known)
                for text in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(held, pa.list_(pa.string()))], names=["digest", "stems"])

    toxic = rows.where("toxic = 1").select("text", F.xxhash64("text").alias("digest")).mapInArrow(cover, "digest long, stems array<string>")
    sample = toxic.orderBy("digest").limit(COVER_ROWS).collect()
    return greedy_cover([r["stems"] for r in {r["digest"]: r for r in sample}.values()])


def greedy_cover(held: list[list[str]]) -> list[str]:
    """Entries that cover the texts, most new texts first, longest on ties.

    Then those that are a quarter as frequent as the usual entry and not the
    beginning of, or begun by, one already chosen.
    """
    where: dict[str, set[int]] = {}
    for i, stems in enumerate(held):
        for stem in stems:
            where.setdefault(stem, set()).add(i)
    support = {stem: len(rows) for stem, rows in where.items()}
    chosen: list[str] = []
    covered: set[int] = set()
    # The number of new texts only falls, so a stem is counted again when its old number comes up.
    order = lambda stem, new: (-new, -len(stem), [-ord(c) for c in stem], stem)
    heap = [order(stem, len(rows)) for stem, rows in where.items()]
    heapq.heapify(heap)
    while heap and -heap[0][0] >= NEW_TEXTS:
        before, *_, stem = heapq.heappop(heap)
        new = where[stem] - covered
        if len(new) < -before:
            heapq.heappush(heap, order(stem, len(new)))
            continue
        chosen.append(stem)
        covered |= new
    if chosen:
        usual = sorted(support[s] for s in chosen)[len(chosen) // 2]
        nested = lambda s: any(s.startswith(c) or c.startswith(s) for c in chosen)
        for stem in sorted(support, key=lambda s: (-support[s], -len(s), s)):
            if 4 * support[stem] < usual:
                break
            if not nested(stem):
                chosen.append(stem)
    return chosen


def find_matches(texts: DataFrame, entries: list[str]) -> DataFrame:
    """(text_key, entry, way, n, quoted) of every whole text; quoted: the share in a quoting context."""
    words = texts.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words.value)
        for batch in batches:
            for part in in_slices(batch):
                out = [
                    (key, entry, way, n, quoted / n)
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for (entry, way), (n, quoted) in sorted(lexicon.matches(text).items())
                ]
                columns = list(zip(*out)) or [[]] * 5
                types = pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.float64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["text_key", "entry", "way", "n", "quoted"])

    return texts.mapInArrow(run, "text_key binary, entry int, way int, n long, quoted double")


def weigh(matches: DataFrame, labels: DataFrame) -> tuple[dict[tuple[int, int, int], float], float]:
    """Log-odds of each (entry, way, times) from all labelled training rows, and the factor of quoted matches.

    ``labels``: text_key, toxic and clean, the numbers of training rows with that text.

    More matches never weigh less than fewer.
    Ways that training texts hardly show lean on the entry's exact matches, the
    less the more often clean texts have them.  What is collected is a few rows
    per entry.
    """
    n = labels.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    hits = matches.join(labels, "text_key").groupBy("entry", "way", F.least("n", F.lit(TIMES)).alias("times"), (F.col("quoted") > 0.5).alias("is_quoted"))
    rows = hits.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    seen: dict[tuple[int, int, int], list[int]] = {}
    context = {True: [0, 0], False: [0, 0]}
    for r in rows:
        cell = seen.setdefault((r["entry"], r["way"], r["times"]), [0, 0])
        cell[0] += r["toxic"]
        cell[1] += r["clean"]
        if r["way"] == EXACT:
            context[r["is_quoted"]][0] += r["toxic"]
            context[r["is_quoted"]][1] += r["clean"]
    toxic, clean = max(1, n["toxic"] or 0), max(1, n["clean"] or 0)
    odds = lambda t, c: float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 1.5) / (clean + 1)))
    weights = {}
    for entry in {e for e, _, _ in seen}:
        exact = 0.0
        for times in range(1, TIMES + 1):
            t, c = seen.get((entry, EXACT, times), (0, 0))
            exact = max(exact, odds(t, c)) if t else exact
            weights[entry, EXACT, times] = exact
            for way, share in ((MISSPELLED, 0.9), (MISSPELLED_STEM, 0.6)):
                t, c = seen.get((entry, way, times), (0, 0))
                rare = 1 / (1 + 1000 * c / clean) if c else 1.0
                weights[entry, way, times] = max(0.0, min(share * exact, odds(t, c) if t + c >= 20 else share * exact * rare))
    precision = lambda t, c: (t + 1) / (t + c + 2)
    return weights, min(1.0, precision(*context[True]) / precision(*context[False]))


def toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic"
) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), n_entries (entries of the lexicon found).

    ``labels`` holds the rows to learn from; null labels and ids count for
    nothing, and a doc_id labelled twice is toxic if one label says so.  Null and
    empty texts have no evidence and the lowest score.  A score depends on the
    text alone, so equal texts score alike, and rows without doc_id, or different
    texts of one doc_id, by what is in them.
    Without labels of both kinds every score is 0.  All texts are scored whole.
    """
    spark = df.sparkSession
    texts = id_and_text(df, id_col, text_col)
    marks = (
        labels.select(labels[label_id].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # A bounded number of ids, so the texts need not move to meet their labels.
    some = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARNING_ROWS) for k in (0, 1)]
    some = stored(some[0].unionByName(some[1]), "learning-rows")
    entries = learn_lexicon(texts.join(F.broadcast(some), "doc_id").select("text", "toxic"))
    if not entries:
        return texts.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_entries"))
    key = F.unhex(F.md5("text")).alias("text_key")
    keys = stored(texts.select("doc_id", key), "text-keys")
    matches = stored(find_matches(texts.select(key, "text"), entries).distinct(), "lexicon-matches")
    labelled = keys.join(marks, "doc_id").distinct()
    training = stored(labelled.groupBy("text_key").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "training-texts")
    weights, quoting = weigh(matches, training)
    table = spark.createDataFrame([(*k, v) for k, v in sorted(weights.items())], "entry int, way int, times long, weight double")
    counted = matches.withColumn("times", F.least("n", F.lit(TIMES)))
    worth = F.col("weight") * (1 - F.col("quoted") * F.lit(1 - quoting))
    evidence = (
        counted.join(F.broadcast(table), ["entry", "way", "times"])
        .groupBy("text_key", "entry")
        .agg(F.max(worth).alias("worth"))
        .where("worth > 0")
        .groupBy("text_key")
        .agg(F.least(F.sum("worth"), F.lit(12.0)).alias("evidence"), F.count("*").alias("n_entries"))
    )
    evidence = stored(evidence, "toxic-evidence")
    amount = F.coalesce("evidence", F.lit(0.0))
    seen = training.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    logit = amount + F.lit(float(np.log((seen["toxic"] + 0.5) / (seen["clean"] + 0.5))))
    return keys.join(evidence, "text_key", "left").select(
        "doc_id", (1 / (1 + F.exp(-logit))).alias("score"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries")
    )
