"""SimHash near duplicates by covering locality-sensitive hashing (operator 12).

A text's fingerprint is the bitwise majority of the hashes of its word shingles.
Two fingerprints link when they differ in at most ``radius`` bits.  To find the
links, every bit position gets a non-zero vector of ``radius + 1`` bits, and each
non-zero vector v of that length makes one table: its mask keeps the positions
whose vector has an odd inner product with v.  Any set of ``radius`` positions
leaves a v that is orthogonal to all their vectors, so a pair within the radius
agrees on the whole mask of at least one table.  No pair is left to chance.

Members of a bucket are compared inside tasks.  A bucket with more members than
``bucket`` is not compared: its members go to every point within half the radius
instead.  Two fingerprints within the radius share such a point, and all that
share one are within the radius, so a star around each point has every link,
and the rows grow with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from prefspark.llm.bpe import in_slices
from prefspark.llm.common import id_and_text, stored
from prefspark.llm.components import components
from prefspark.operators.heavy import join_on, salted_join, split_heavy, with_summary

BITS = 64


@dataclass(frozen=True)
class Covering:
    """Words of a shingle, seed of its hash, differing bits of a link, and the largest bucket that is compared."""

    shingle: int = 4
    seed: int = 42
    radius: int = 4
    bucket: int = 4096
    #: Documents of one fingerprint, or fingerprints of one component, that one task may hold.
    heavy: int = 20_000

    def masks(self) -> list[int]:
        """One 64-bit mask per table."""
        vectors = 2 ** (self.radius + 1) - 1
        return [
            sum(1 << bit for bit in range(BITS) if ((bit % vectors + 1) & table).bit_count() % 2)
            for table in range(1, vectors + 1)
        ]


def fingerprint(text: str, shape: Covering = Covering(), block: int = 1 << 16) -> int:
    """The majority of all shingle hashes; 0 for a text without words.

    Long texts are hashed in blocks of ``block`` shingles, so memory is bounded
    by the text itself.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(len(words), shape.shingle)
    starts, ends = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    ones, digest, seed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest, shape.seed
    for at in range(0, len(starts), block):
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at : at + block], ends[at : at + block])), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shape: Covering = Covering(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long), row (place in its task) for every input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for part in in_slices(batch):
                fp = np.array([fingerprint(t, shape) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fp), pa.array(np.arange(row, row + len(fp)))], names=["doc_id", "fp", "row"]
                )
                row += len(fp)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long, row long")


def stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least found member) within every linked group of distinct fingerprints."""
    left = np.sort(fps.view(np.uint64))
    members, roots = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        reached = [root]
        while reached and len(left):
            near = np.bitwise_count(left ^ reached.pop()) <= radius
            if near.any():
                found = left[near]
                members.append(found)
                roots.append(np.full(len(found), root))
                reached.extend(found)
                left = left[~near]
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(members).view(np.int64), np.concatenate(roots).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of the sorted buckets, and where each bucket begins; a bucket is never cut."""
    kept = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        table, key, fp = (np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns))
        new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        last = int(new[-1]) if len(new) else 0
        kept = [table[last:], key[last:], fp[last:]]
        if last:
            yield fp[:last], np.concatenate([[0], new])
    if len(kept[2]):
        yield kept[2], np.array([0, len(kept[2])])


def _compared(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of buckets of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, starts in _runs(batches):
            sizes = np.diff(starts)
            pairs = starts[:-1][sizes == 2]
            linked = pairs[np.bitwise_count(fp[pairs].view(np.uint64) ^ fp[pairs + 1].view(np.uint64)) <= radius]
            found = [(fp[linked], fp[linked + 1])]
            found += [stars(fp[s : s + n], radius) for s, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2])]
            a, b = (np.concatenate(x) for x in zip(*found))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    order = ["table", "key"]
    return buckets.select("table", "key", "fp").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _around(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of fingerprints through the points that lie within half the radius of both.

    A point has a bounded number of fingerprints around it, however many there are in all.
    """
    points = fps.select("fp", F.col("fp").alias("point"), F.lit(0).alias("low"))
    for _ in range(radius // 2):
        # Bits are flipped in rising order and BITS stands for none, so every set of bits comes once.
        steps = points.select("fp", "point", F.explode(F.sequence("low", F.lit(BITS))).alias("bit"))
        flip = F.when(F.col("bit") < BITS, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).otherwise(F.lit(0).cast("long"))
        points = steps.select("fp", F.col("point").bitwiseXOR(flip).alias("point"), F.least(F.col("bit") + 1, F.lit(BITS)).alias("low"))
    least = F.min("fp").over(Window.partitionBy("point"))
    return points.select("fp", least.alias("b")).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, shape: Covering = Covering()) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints ``fp``."""
    if shape.radius % 2:
        raise ValueError("the radius must be even: points around a bucket lie at half of it")
    fp = F.col("fp")
    signed = [m - 2**BITS if m >> (BITS - 1) else m for m in shape.masks()]
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)]))
    buckets = fps.select("fp", tables.alias("t")).select("fp", F.col("t.table").alias("table"), F.col("t.key").alias("key"))
    ordinary, heavy = split_heavy(buckets, ["table", "key"], shape.bucket, "fp")
    edges = _compared(ordinary.withColumn("table", F.col("table").cast("long")), shape.radius)
    if heavy is None:
        return edges
    return edges.unionByName(_around(heavy.select("fp").distinct(), shape.radius))


def simhash_components(df: DataFrame, shape: Covering = Covering(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_fingerprints of the component.

    ``component_id`` is the least doc_id that links reach, its own included.  Null
    and empty texts have fingerprint zero and link like any other.  Rows that
    share a doc_id are rows of their own; a null doc_id is no component's name
    unless all its rows have none (then null).  Equal fingerprints are one node,
    so copies cost one row each.  Columns other than the two do not travel.
    """
    rows = stored(fingerprints(df, shape, id_col, text_col), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "distinct")
    nodes = components(links(distinct.select("fp"), shape)).select(F.col("node").alias("fp"), "component")
    placed = stored(distinct.join(nodes, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")

    def named(part: DataFrame) -> DataFrame:
        return part.groupBy("component").agg(F.min("low_id").alias("component_id"), F.count("*").alias("n_fingerprints"))

    found = stored(with_summary(placed, ["component"], named, "fp", shape.heavy).select("fp", "component_id", "n_fingerprints"), "named")
    ordinary, heavy = split_heavy(rows, ["fp"], shape.heavy, "row")
    joined = join_on(ordinary, found, ["fp"])
    if heavy is not None:
        joined = joined.unionByName(salted_join(heavy, found.join(heavy.select("fp").distinct(), "fp", "left_semi"), ["fp"], "row"))
    return joined.select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id", "n_fingerprints")


def _hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), BITS // 4, "0")
