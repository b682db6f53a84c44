"""Best-fit packing of token sequences with swap-based local search (operator 6).

Documents become pieces of at most ``capacity`` tokens.  Whole pieces fill a
sequence each where they are.  The others are dealt over shards by a hash, and
each shard, one Spark group, packs its pieces: best fit, longest first, then a
local search over all underfull bins for the exchange of each piece - one for one, two
for one, or a move - that raises the sum of squared fills most, until no bin can
be spared or nothing improves.  Only ids and lengths are shuffled.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.bpe import in_slices, tokenizer
from prefspark.llm.common import id_and_text, stored

CAPACITY = 2048
#: Part pieces that a shard packs: enough that its last bins do not matter, few enough for one task.
SHARD_PIECES = 100_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    first = n_tokens % capacity or capacity
    return [(0, min(first, n_tokens))] + [(s, capacity) for s in range(first, n_tokens, capacity)]


def document_pieces(df: DataFrame, vocabulary: str, separator: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each row: its tokens and then the separator; ``row`` tells repeated ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(vocabulary), np.array([separator], "<u4").tobytes()
        for batch in batches:
            for part in in_slices(batch):
                out: list[tuple] = []
                for doc, row, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), coder.encode(part.column(2).to_pylist())):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        out.append((doc, row, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    rows = id_and_text(df, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, PIECES)


class Bins:
    """Open bins by free space; the contents are piece numbers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.content: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, lengths: np.ndarray, order: np.ndarray) -> None:
        """Put each piece in the fullest bin that takes it, or in a new one."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        frees: list[int] = []  # the free spaces that some bin has, sorted
        for i in order.tolist():
            length = int(lengths[i])
            at = bisect.bisect_left(frees, length)
            if at == len(frees):
                b = len(self.fill)
                self.content.append([])
                self.fill.append(0)
            else:
                free = frees[at]
                b = by_free[free].pop()
                if not by_free[free]:
                    frees.pop(at)
            self.content[b].append(i)
            self.fill[b] += length
            left = self.capacity - self.fill[b]
            if left:
                if not by_free[left]:
                    bisect.insort(frees, left)
                by_free[left].append(b)

    def least(self, lengths: np.ndarray) -> int:
        """No packing has fewer bins: long pieces need one each, and all tokens their space."""
        long = lengths[2 * lengths > self.capacity]
        return max(-(-int(lengths.sum()) // self.capacity), len(long))

    def improve(self, lengths: np.ndarray, rounds: int | None = None) -> None:
        """Empty underfull bins by moves and exchanges that raise the sum of squared fills.

        Each round goes through the bins that are not full, emptiest first.  A
        piece moves (nothing comes back), or replaces a shorter piece (one for
        one) or two pieces (two for one) of any other such bin, where that raises
        the sum most; what it replaced comes back to the bin it left.  Without
        ``rounds``, until a round changes nothing or no bin can be spared.
        """
        size, least = lengths.tolist(), self.least(lengths)
        used = sum(1 for fill in self.fill if fill)
        if used <= least or rounds == 0:
            return
        index = _Exchanges(self, size)
        done = 0
        while rounds is None or done < rounds:
            done += 1
            changed = False
            open_bins = sorted((b for b in range(len(self.fill)) if 0 < self.fill[b] < self.capacity), key=self.fill.__getitem__)
            for b in open_bins:
                if not 0 < self.fill[b] < self.capacity:
                    continue
                index.remove(b)
                for i in sorted(self.content[b], key=size.__getitem__, reverse=True):
                    found = index.best(size[i], self.fill[b])
                    if found is None:
                        continue
                    c, back = found
                    index.remove(c)
                    self._shift(b, c, i, back, size)
                    index.add(c)
                    changed = True
                index.add(b)
                if not self.fill[b]:
                    used -= 1
                    if used <= least:
                        return
            if not changed:
                return

    def _shift(self, b: int, c: int, i: int, back: tuple[int, ...], size: list[int]) -> None:
        self.content[b] = [x for x in self.content[b] if x != i] + list(back)
        self.content[c] = [x for x in self.content[c] if x not in back] + [i]
        gain = size[i] - sum(size[x] for x in back)
        self.fill[b] -= gain
        self.fill[c] += gain


class _Exchanges:
    """What open bins can give back, by its tokens and the bin's free space.

    ``tight[r, d]`` is the least free space of at least ``d`` among the open bins
    that can give back ``r`` tokens with two pieces at most: the fullest bin that
    can take ``d`` tokens more that way.  Two to four bytes times the square of the capacity.
    """

    def __init__(self, bins: Bins, size: list[int]):
        self.bins, self.size, self.capacity = bins, size, bins.capacity
        self.none = self.capacity + 1
        self.tight = np.full((self.capacity + 1, self.capacity + 2), self.none, np.int16 if self.none < 1 << 15 else np.int32)
        self.holds: dict[tuple[int, int], dict[int, None]] = {}  # tokens given back, free space -> bins
        self.listed: dict[int, list[int]] = {}
        self.gains = np.arange(self.capacity + 1, dtype=np.int64)
        for b, fill in enumerate(bins.fill):
            if 0 < fill < self.capacity:
                self.add(b)

    def _sums(self, b: int) -> list[int]:
        alone = sorted({*(self.size[i] for i in self.bins.content[b])})
        counts = Counter(self.size[i] for i in self.bins.content[b])
        out = {0, *alone}
        for k, x in enumerate(alone):
            if counts[x] > 1:
                out.add(2 * x)
            out.update(x + y for y in alone[k + 1 :])
        return list(out)

    def add(self, b: int) -> None:
        free = self.capacity - self.bins.fill[b]
        if not 0 < free < self.capacity:
            return
        self.listed[b] = sums = self._sums(b)
        for r in sums:
            held = self.holds.get((r, free))
            if held is None:
                self.holds[r, free] = {b: None}
                row = self.tight[r]
                row[row[: free + 1].searchsorted(free, "right") : free + 1] = free
            else:
                held[b] = None

    def remove(self, b: int) -> None:
        free = self.capacity - self.bins.fill[b]
        for r in self.listed.pop(b, ()):
            held = self.holds[r, free]
            del held[b]
            if not held:
                del self.holds[r, free]
                row = self.tight[r]
                row[row[: free + 1].searchsorted(free, "left") : free + 1] = row[free + 1]

    def best(self, length: int, fill: int) -> tuple[int, tuple[int, ...]] | None:
        """The bin, and the pieces it gives back, with which a piece that leaves a bin of this fill gains most."""
        gain = self.gains[1 : length + 1]
        # tight[length - d, d] for d = 1 .. length
        width = self.tight.shape[1]
        free = self.tight.reshape(-1)[(length - 1) * width + 1 :: -(width - 1)][:length] if length > 1 else self.tight[0, 1:2]
        value = gain * (self.capacity - free.astype(np.int64) - fill + gain)
        value[free == self.none] = 0
        at = int(value.argmax())
        if value[at] <= 0:
            return None
        given, room = length - at - 1, int(free[at])
        c = next(iter(self.holds[given, room]))
        return c, self._pieces(c, given)

    def _pieces(self, c: int, tokens: int) -> tuple[int, ...]:
        if not tokens:
            return ()
        seen: dict[int, int] = {}
        pair: tuple[int, ...] = ()
        for j in self.bins.content[c]:
            if self.size[j] == tokens:
                return (j,)
            if not pair and tokens - self.size[j] in seen:
                pair = (seen[tokens - self.size[j]], j)
            seen[self.size[j]] = j
        return pair


def pack(lengths: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    bins = Bins(capacity)
    bins.best_fit(lengths, np.lexsort((np.arange(len(lengths)), -lengths)))
    bins.improve(lengths, rounds)
    number, offset = np.zeros((2, len(lengths)), np.int64)
    for k, content in enumerate(c for c in bins.content if c):
        at = 0
        for i in sorted(content):
            number[i], offset[i] = k, at
            at += int(lengths[i])
    return number, offset


def pack_documents(
    df: DataFrame, vocabulary: str, separator: int = 0, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one separator.  Repeated rows are packed
    once each.  No sequence exceeds ``capacity``; ``sequence_id`` is unique over
    shards.  An empty table gives an empty result.  The number of shards follows
    the number of part pieces, so a shard stays of one size; a shard leaves at
    most about one bin underfull.
    """
    pieces = stored(document_pieces(df, vocabulary, separator, capacity, id_col, text_col), "pieces")
    whole = pieces.where(F.col("length") == capacity)
    part = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_pieces))

    def pack_shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "piece"], ignore_index=True)
        number, group["offset"] = pack(group["length"].to_numpy(), capacity, rounds)
        group["sequence_id"] = number * (2 * shards) + 2 * group["shard"]
        return group.drop(columns=["shard", "row"])

    columns = "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    shard = F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard")
    packed = part.select("*", shard).groupBy("shard").applyInPandas(
        pack_shard, "doc_id long, piece int, start long, length long, ids_crc32 long, offset long, sequence_id long"
    )
    filled = whole.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return filled.select(*columns).unionByName(packed.select(*columns))
