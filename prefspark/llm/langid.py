"""Language identification with language-bitmask n-gram filters (operator 9).

Training counts the letter n-grams of each language over all training rows and
keeps those that are typical of it.  They go into Bloom filters that are stored
bit-sliced: a slot holds one bit per language, so reading an n-gram's slots and
AND-ing them returns all languages whose filter contains it.  A text's n-grams
are counted per language, the counts corrected for each filter's false positive
rate, and the largest corrected share decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from prefspark.llm.bpe import in_slices
from prefspark.llm.common import stored

UNKNOWN = "und"
ORDERS = (3, 4)
#: Least slots of the filters; there are more where a language has too many typical n-grams for the rate of false positives.
SLOT_BITS = 20
HASHES = 2
FALSE_POSITIVES = 0.1
#: Slots that a task puts together at a time.
RANGE_BITS = 16
#: A language contains an n-gram that it has so many times, and at this rate beside the language that has it most.
MIN_COUNT = 3
MIN_RATE = 0.1
SLICE = 2 << 20


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows kept from learning; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all letter n-grams, the text each belongs to, and each text's number of letters.

    Letters are lower-cased; every run of other characters counts as one blank,
    and so do both ends of a text.
    """
    padded = [f" {t.lower()} " if t else "  " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(padded)))
    letter = _letters()[points.astype(np.int64)]
    n_letters = np.bincount(text[letter], minlength=len(texts))
    points[~letter] = 32
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (text[1:] != text[:-1])
    points, text = points[keep], text[keep]
    hashes, owners = [], []
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        key = np.full(n, order, np.uint64)
        for k in range(order):
            key = key * np.uint64(1_000_003) + points[k : k + n]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        whole = text[:n] == text[order - 1 :]
        hashes.append(key[whole])
        owners.append(text[:n][whole])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    return np.concatenate(hashes), np.concatenate(owners), n_letters


def slots_of(keys: np.ndarray, slot_bits: int, hashes: int) -> list[np.ndarray]:
    """The slots of each key: ``hashes`` disjoint runs of its bits, mixed anew when they run out."""
    out, rest = [], keys
    for k in range(hashes):
        if k:
            rest = (rest ^ (rest >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append((rest >> np.uint64(64 - slot_bits)).astype(np.int64))
    return out


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filters: ``slots[word, slot]`` has the bits of as many languages as its type has bits."""

    languages: list[str]
    slots: np.ndarray
    hashes: int

    @property
    def slot_bits(self) -> int:
        return self.slots.shape[1].bit_length() - 1

    @property
    def width(self) -> int:
        return 8 * self.slots.itemsize

    def _bit(self, masks: np.ndarray, language: int) -> np.ndarray:
        return masks & self.slots.dtype.type(1 << language % self.width)

    def false_positive_rates(self) -> np.ndarray:
        """Per language: the share of its slots that are set, to the power of the hashes."""
        size = self.slots.shape[1]
        return np.array([(int(np.count_nonzero(self._bit(self.slots[i // self.width], i))) / size) ** self.hashes for i in range(len(self.languages))])

    def contains(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each word of languages, the mask of those that contain each key."""
        at = slots_of(keys, self.slot_bits, self.hashes)
        masks = []
        for word in self.slots:
            mask = word[at[0]]
            for slot in at[1:]:
                mask = mask & word[slot]
            masks.append(mask)
        return masks

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) corrected shares of the n-grams, and the letters of each text."""
        keys, owner, letters = letter_ngrams(texts)
        total = np.bincount(owner, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for w, mask in enumerate(self.contains(keys)):
            for i in range(self.width * w, min(self.width * (w + 1), len(self.languages))):
                hits[:, i] = np.bincount(owner[self._bit(mask, i) != 0], minlength=len(texts))
        wrong = self.false_positive_rates()
        share = (hits / np.maximum(total, 1)[:, None] - wrong) / np.maximum(1 - wrong, 1e-9)
        return np.clip(share, 0, 1), letters

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and margin of each text."""
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        shares, letters = self.shares(texts)
        first = shares.argmax(1)
        best = np.where(letters > 0, shares[np.arange(n), first], 0.0)
        names = [self.languages[i] if some else UNKNOWN for i, some in zip(first.tolist(), (letters > 0).tolist())]
        shares[np.arange(n), first] = 0
        return names, best, np.where(letters > 0, best - shares.max(1), 0.0)


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of (lang, text); equal n-grams are counted together before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for part in in_slices(batch, SLICE):
                langs = np.array(part.column(0).to_pylist(), object)
                keys, owner, _ = letter_ngrams(part.column(1).to_pylist())
                for lang in set(langs.tolist()):
                    found, n = np.unique(keys[(langs == lang)[owner]], return_counts=True)
                    held.setdefault(lang, []).append((found, n))
            for lang, parts in held.items():
                found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([p[1] for p in parts]), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "key", "n"]
                )

    counted = rows.mapInArrow(run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def slot_bits_for(n_keys: int, hashes: int) -> int:
    """Least number of bits with which a filter of so many keys keeps the rate of false positives."""
    free = 1 - FALSE_POSITIVES ** (1 / hashes)
    return max(SLOT_BITS, math.ceil(math.log2(max(1.0, hashes * n_keys / -math.log(free)))))


def learn(rows: DataFrame, slot_bits: int | None = None, hashes: int = HASHES, min_count: int = MIN_COUNT, min_rate: float = MIN_RATE) -> LanguageFilters:
    """Filters from all rows of (lang, text) with a language and a text.

    Without ``slot_bits`` the filters are as large as the language with the most
    typical n-grams needs for ``FALSE_POSITIVES``.  What reaches the driver is
    the filter itself, a range of slots at a time, and one row per language.
    """
    counts = stored(count_ngrams(rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")), "ngram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    order = {r["lang"]: r["total"] for r in totals.collect()}
    languages = sorted(order, key=lambda x: (-order[x], x))
    width = next((w for w in (8, 16, 32) if len(languages) <= w), 64)
    words, dtype = max(1, -(-len(languages) // width)), np.dtype(f"u{width // 8}")
    if not languages:
        return LanguageFilters(languages, np.zeros((words, 1 << (slot_bits or SLOT_BITS)), dtype), hashes)
    rate = F.col("n") / F.col("total")
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    typical = (
        counts.join(F.broadcast(totals), "lang")
        .withColumn("best", F.max(rate).over(Window.partitionBy("key")))
        .where((F.col("n") >= min_count) & (rate >= min_rate * F.col("best")))
        .select(number[F.col("lang")].cast("long").alias("lang"), "key")
    )
    if slot_bits is None:
        typical = stored(typical, "typical-ngrams")
        slot_bits = slot_bits_for(typical.groupBy("lang").count().agg(F.max("count")).first()[0] or 0, hashes)
    range_bits = min(RANGE_BITS, slot_bits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate(slots_of(keys, slot_bits, hashes))
            lang = np.tile(batch.column(0).to_numpy(zero_copy_only=False), hashes)
            part = (lang // width << (slot_bits - range_bits)) + (at >> range_bits)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(at & ((1 << range_bits) - 1)), pa.array(lang % width)], names=["part", "slot", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            part, slot, bit = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(part).tolist():
                if p not in held and held:  # rows are sorted by part
                    yield packed(held)
                some = part == p
                np.bitwise_or.at(held.setdefault(p, np.zeros(1 << range_bits, dtype)), slot[some], np.left_shift(1, bit[some].view(np.uint64)).astype(dtype))
        if held:
            yield packed(held)

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        p, data = held.popitem()
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=["part", "data"])

    placed = typical.mapInArrow(place, "part long, slot long, bit long")
    ranges = stored(placed.repartition("part").sortWithinPartitions("part").mapInArrow(fill, "part long, data binary"), "filter-ranges")
    slots = np.zeros((words << (slot_bits - range_bits), 1 << range_bits), dtype)
    for row in ranges.toLocalIterator():
        slots[row["part"]] = np.frombuffer(row["data"], dtype)
    return LanguageFilters(languages, slots.reshape(words, -1), hashes)


def identify(df: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (share of n-grams the language contains), margin.

    Null texts and texts without a letter are ``und`` with score 0, and so are
    all when nothing was learned.  Ties go to the language with more training
    text, then by name.  The whole text counts; each row is judged by itself.
    """
    model = df.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, SLICE):
                names, best, margin = model.value.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(best), pa.array(margin)], names=["doc_id", "lang_pred", "score", "margin"]
                )

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")


def accepted(df: DataFrame, filters: LanguageFilters, least_share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of a learned language with at least this share; each is judged where it is, whatever its id."""
    model = df.sparkSession.sparkContext.broadcast(filters)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, SLICE):
                names, best, _ = model.value.judge(part.column(at).to_pylist())
                yield part.filter(pa.array((np.array(names, object) != UNKNOWN) & (best >= least_share)))

    return df.mapInArrow(run, df.schema)
