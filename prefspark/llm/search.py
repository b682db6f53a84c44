"""Ranked lexical search over bit-sliced Bloom signatures (operator 13).

The index holds documents in blocks of similar size.  A block is a bit matrix: a
row per signature position, a column per document.  Every term of a document sets
some positions of its column, once for each step of its count that it reaches, so
AND-ing the rows of a term yields a bitmap of the documents that may hold it, and
the rows of its further steps bound how often.  Bitmaps miss no document, hence
the weighted sum of a query's bitmaps is never below a document's score.

A search first scores the documents with the highest bounds; the score of their
k-th is one that the result must reach.  All documents whose bound reaches it for
some query are then scored exactly from their texts, and nothing else can rank.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from prefspark.llm.bpe import in_slices
from prefspark.llm.common import id_and_text, stored
from prefspark.operators.heavy import BROADCAST_ROWS
from prefspark.session import scratch_path

#: ASCII letters and digits and all other characters from 0x80 on make terms; A-Z count as a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Signature positions per key and hashes of a key: about 0.24 % of absent keys look present.
BITS_PER_KEY, HASHES = 16, 4
#: Documents and bytes of a block.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
#: Counts at which a term sets further positions.
STEPS = np.array(sorted({1, 2, 3, *(2**i for i in range(2, 40)), *(3 * 2**i for i in range(1, 39))}), np.int64)
#: Queries and their terms that are worked on together.
QUERY_ITEMS, QUERY_TERMS = 256, 20_000
#: Query terms whose bounds are added at a time.
CHUNK = 4096


@dataclass(frozen=True)
class Index:
    """blocks: doc_ids, lengths, steps, bits. terms: term, df (partial counts)."""

    blocks: DataFrame
    terms: DataFrame


def term_lists(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, and for every occurrence its text and its term."""
    plain = pa.array([(t or "").encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts], pa.large_binary())
    lists = pc.ascii_split_whitespace(plain.cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if blank >= 0:
        text, term = text[term != blank], term[term != blank]
    return coded.dictionary, text, term


def term_hashes(terms: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64, len(terms))


def positions(hashes: np.ndarray, step: np.ndarray | int, rows: int) -> np.ndarray:
    """Signature rows of (term, step) keys, ``HASHES`` each."""
    x = hashes + np.asarray(step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    first, stride = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + stride[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(rows)).astype(np.int64)


def _blocks(texts: list[str | None], ids: pa.Array) -> Iterator[tuple]:
    """(doc_ids, lengths, steps, bits) of all texts with a term, and at last (terms, df)."""
    names, text, term = term_lists(texts)
    lengths = np.bincount(text, minlength=len(texts))
    keys, counts = np.unique(text * max(1, len(names)) + term, return_counts=True)
    text, term = keys // max(1, len(names)), keys % max(1, len(names))
    steps = np.searchsorted(STEPS, counts, "right")
    n_keys = np.bincount(text, steps, minlength=len(texts)).astype(np.int64)
    np.maximum.at(most := np.zeros(len(texts), np.int64), text, steps)
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    hashes = term_hashes(names.to_pylist())
    order = np.argsort(n_keys, kind="stable")
    order = order[n_keys[order] > 0]
    at = 0
    while at < len(order):
        size, docs = BLOCK_DOCS, order[at : at + BLOCK_DOCS]
        while size > 8 and BITS_PER_KEY * int(n_keys[docs[-1]]) * size > 8 * BLOCK_BYTES:
            size //= 2
            docs = docs[:size]
        # The signatures of huge texts are fuller, so their bounds are looser but as safe.
        rows = min(BITS_PER_KEY * int(n_keys[docs[-1]]), BLOCK_BYTES)
        at += len(docs)
        matrix = np.zeros((rows, -(-len(docs) // 8) * 8), bool)
        for column, doc in enumerate(docs):
            mine = slice(begin[doc], begin[doc + 1])
            n = steps[mine]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            matrix[positions(np.repeat(hashes[term[mine]], n), step, rows), column] = True
        yield ids.take(pa.array(docs)), lengths[docs], int(most[docs].max()), np.packbits(matrix, axis=1).tobytes()
    yield names, np.bincount(term, minlength=len(names))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows, stored in the shared folder.

    Null texts and texts without a term are in no block: no query finds them.
    A row is a column of its own, also where it shares its doc_id or has none.
    Every task indexes its own rows; nothing is shuffled.
    """
    names = ["kind", "doc_ids", "lengths", "steps", "bits", "term", "df"]
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.string(), pa.int64()]

    def rows(kind: str, n: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array([kind] * n), *(columns.get(c, pa.nulls(n, t)) for c, t in zip(names[1:], types[1:]))]
        return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(zip(names, types))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch):
                for found in _blocks(part.column(1).to_pylist(), part.column(0)):
                    if len(found) == 4:
                        ids, lengths, steps, bits = found
                        ends = pa.array([0, len(ids)], pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, x) for x in (ids, pa.array(lengths, pa.int64()))]
                        yield rows("block", 1, doc_ids=lists[0], lengths=lists[1], steps=pa.array([steps], pa.int32()), bits=pa.array([bits], pa.binary()))
                    else:
                        seen = np.flatnonzero(found[1])
                        terms = found[0].take(pa.array(seen)).cast(pa.string())
                        yield rows("term", len(seen), term=terms, df=pa.array(found[1][seen], pa.int64()))

    spark = df.sparkSession
    schema = "kind string, doc_ids array<long>, lengths array<long>, steps int, bits binary, term string, df long"
    path = scratch_path(spark, "signatures")
    id_and_text(df, id_col, text_col).mapInArrow(run, schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    return Index(table.where("kind = 'block'").select("doc_ids", "lengths", "steps", "bits"), table.where("kind = 'term'").select("term", "df"))


@dataclass
class Queries:
    """A block of queries: their ids, the weighted terms, and which query holds which term how often."""

    ids: list
    n_docs: int
    n_terms: int
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    item: np.ndarray | None = None
    term: np.ndarray | None = None
    factor: np.ndarray | None = None

    @classmethod
    def of(cls, ids: list, counts: list[Counter], df: dict[str, int], n_docs: int, n_terms: int) -> Queries:
        out = cls(ids, n_docs, n_terms)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        out.terms = sorted(t for t, w in weight.items() if w > 0)
        place = {t: i for i, t in enumerate(out.terms)}
        found = [(i, place[t], n) for i, c in enumerate(counts) for t, n in c.items() if t in place]
        out.item, out.term, times = np.array(found, np.int64).reshape(-1, 3).T
        out.weights = np.array([weight[t] for t in out.terms], np.int64)
        out.factor = out.weights[out.term] * times
        return out

    def spread(self, lengths) -> np.ndarray:
        """The m of documents with so many terms."""
        return np.array([75 + 25 * int(n) * self.n_docs // self.n_terms for n in lengths], np.int64)

    def sums(self, values: np.ndarray, shown: np.ndarray) -> np.ndarray:
        """Per query, the weighted sum of its terms' rows of ``values``; ``shown`` gives the row of a term, or -1."""
        total = np.zeros((len(self.ids), values.shape[1]), np.int64)
        pairs = np.flatnonzero(shown[self.term] >= 0)
        for at in range(0, len(pairs), CHUNK):
            mine = pairs[at : at + CHUNK]
            item = self.item[mine]
            first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
            total[item[first]] += np.add.reduceat(values[shown[self.term[mine]]] * self.factor[mine, None], first, axis=0)
        return total

    def bounds(self, hashes: np.ndarray, lengths: np.ndarray, steps: int, bits: bytes) -> np.ndarray:
        """Upper bounds of the scores (queries, documents) of a block."""
        n = len(lengths)
        matrix = np.frombuffer(bits, np.uint8).reshape(-1, -(-n // 8))
        reached = np.zeros((len(hashes), n), np.int8)
        alive, held = np.arange(len(hashes)), None
        for step in range(steps):
            mask = np.bitwise_and.reduce(matrix[positions(hashes[alive], step, len(matrix))], axis=1)
            if held is not None:
                mask &= held
            some = mask.any(1)
            alive, held = alive[some], mask[some]
            if not len(alive):
                break
            reached[alive] += np.unpackbits(held, axis=1)[:, :n].view(np.int8)
        present = np.flatnonzero(reached.any(1))
        shown = np.full(len(hashes), -1)
        shown[present] = np.arange(len(present))
        most = np.concatenate([[0], STEPS[1 : steps + 1] - 1])[:, None]
        gain = 1_000_000_000 * most // (1000 * most + 12 * self.spread(lengths)[None, :])
        return self.sums(gain[reached[present], np.arange(n)[None, :]], shown)


def _best(item: np.ndarray, doc: np.ndarray, none: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of every item: highest score, then least doc_id, rows without one last."""
    order = np.lexsort((doc, none, -score, item))
    item = item[order]
    first = np.searchsorted(item, item)
    order = order[np.arange(len(item)) - first < k]
    return item[np.arange(len(item)) - first < k], doc[order], none[order], score[order]


class _Kept:
    """The first k of every item among the rows seen so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: (items, documents); those above 0 count."""
        none = np.asarray(ids.is_null())
        doc = np.asarray(ids.fill_null(0), np.int64)
        last = np.zeros(len(scores), np.int64)
        full = np.bincount(self.rows[0], minlength=len(scores)) >= self.k
        np.minimum.at(least := np.full(len(scores), np.iinfo(np.int64).max), self.rows[0], self.rows[3])
        last[full] = least[full]
        item, at = np.nonzero((scores > 0) & (scores >= last[:, None]))
        new = (item, doc[at], none[at], scores[item, at])
        self.rows = _best(*(np.concatenate([a, b]) for a, b in zip(self.rows, new)), self.k)

    def batch(self) -> pa.RecordBatch:
        item, doc, none, score = self.rows
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, pa.int64(), mask=none), pa.array(score)], names=["item", "doc_id", "score"])


RANKED = "item long, doc_id long, score long"


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of every item, in two steps: what many tasks found never meets in one at once."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")
    near = rows.select("*", part).withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    near = near.where(F.col("place") <= k).drop("place", "part")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _probe(blocks: DataFrame, queries: Queries, k: int) -> DataFrame:
    """Per query and task, the documents with the k highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = term_hashes(queries.terms), _Kept(k)
        for ids, lengths, steps, bits in _read(batches):
            kept.add(queries.bounds(hashes, lengths, steps, bits), ids)
        yield kept.batch()

    return blocks.mapInArrow(run, RANKED)


def _candidates(blocks: DataFrame, queries: Queries, least: np.ndarray) -> DataFrame:
    """doc_id of every document that is not provably below the k-th score of all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = term_hashes(queries.terms)
        for ids, lengths, steps, bits in _read(batches):
            may = (queries.bounds(hashes, lengths, steps, bits) >= least[:, None]).any(0)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(may))], names=["doc_id"])

    return blocks.mapInArrow(run, "doc_id long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, np.asarray(batch.column(1)[i].values), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()


def exact_scores(texts: DataFrame, queries: Queries, k: int) -> DataFrame:
    """Per query and task, the k best of the given documents, scored from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, place = _Kept(k), {t: i for i, t in enumerate(queries.terms)}
        for batch in batches:
            for part in in_slices(batch, 1 << 20):
                names, text, term = term_lists(part.column(1).to_pylist())
                known = np.fromiter((place.get(t, -1) for t in names.to_pylist()), np.int64, len(names))[term]
                m = queries.spread(np.bincount(text, minlength=part.num_rows))
                text, (here, row) = text[known >= 0], np.unique(known[known >= 0], return_inverse=True)
                shown = np.full(len(queries.terms), -1)
                shown[here] = np.arange(len(here))
                step = max(1, (1 << 20) // max(1, len(here)))
                for at in range(0, part.num_rows, step):
                    width, mine = min(step, part.num_rows - at), (text >= at) & (text < at + step)
                    tf = np.bincount(row[mine] * width + text[mine] - at, minlength=len(here) * width).reshape(-1, width)
                    gain = 1_000_000_000 * tf // (1000 * tf + 12 * m[None, at : at + width])
                    kept.add(queries.sums(gain, shown), part.column(0).slice(at, width))
        yield kept.batch()

    return texts.mapInArrow(run, RANKED)


def _holding(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose doc_id is wanted, a missing one included; the ids are broadcast only where they are counted few."""
    ids = wanted.select(F.col("doc_id").alias("wanted"))
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[Counter]]]:
    """The queries in blocks of bounded size; the driver holds one block."""
    ids, counts, terms = [], [], 0
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        names, _, term = term_lists([row.text])
        if ids and (len(ids) >= QUERY_ITEMS or terms + len(names) > QUERY_TERMS):
            yield ids, counts
            ids, counts, terms = [], [], 0
        words = names.to_pylist()
        ids.append(row.id)
        counts.append(Counter(words[t] for t in term))
        terms += len(names)
    if ids:
        yield ids, counts


def search(
    index: Index, docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The k best documents of every query: item_id, rank, doc_id, score.

    ``index`` must be that of ``docs``.  Every row of ``items`` is a query of its
    own; one without a term, or whose terms no document holds, has no rows.
    Equal scores rank by doc_id, rows without one last; rows that share a doc_id
    are documents of their own.  Columns other than the named ones do not travel.
    """
    spark = docs.sparkSession
    size = index.blocks.agg(
        F.sum(F.size("doc_ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("terms")
    ).first()
    texts, found = id_and_text(docs, id_col, text_col), None
    for ids, counts in query_blocks(items, item_id, item_text) if size.n else ():
        queries = Queries.of(ids, counts, _document_counts(spark, index, counts), size.n, size.terms)
        if not queries.terms:
            continue
        best = _first(_probe(index.blocks, queries, k), k).select("doc_id").distinct()
        known = _first(exact_scores(_holding(texts, stored(best, "probed")), queries, k), k).where(F.col("rank") == k)
        least = np.ones(len(ids), np.int64)
        for row in known.select("item", "score").collect():
            least[row.item] = row.score
        wanted = stored(_candidates(index.blocks, queries, least).distinct(), "candidates")
        ranked = _first(exact_scores(_holding(texts, wanted), queries, k), k)
        named = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {items.schema[item_id].dataType.simpleString()}")
        rows = ranked.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        kind = items.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found


def _document_counts(spark: SparkSession, index: Index, counts: list[Counter]) -> dict[str, int]:
    """In how many documents each term of a block of queries occurs."""
    terms = sorted(set().union(*counts))
    if not terms:
        return {}
    # At most QUERY_TERMS terms, or those of one query.
    asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    return {r.term: r.df for r in index.terms.join(asked, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
