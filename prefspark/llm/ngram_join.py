"""N-gram Jaccard self-join by a MinHash LSH forest (operator 3).

Texts with the same words are one node.  A node's MinHash signature is cut into
trees of labels; the prefixes of a tree's label sequences are its trie.  Nodes that
share the longest prefixes meet first and are united; then all shorter prefixes,
down to where pairs of the least similarity meet with the probability asked for,
are gone through in one job, where not all that share them are united.
Candidates that signatures do not rule out are gathered into clusters, and the
exact Jaccard similarity of all pairs in a cluster is computed inside tasks, in
blocks, so pairs are counted but never become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.bpe import in_slices
from prefspark.llm.common import id_and_text, stored
from prefspark.llm.components import components
from prefspark.session import shuffle_partitions


@dataclass(frozen=True)
class Forest:
    """words per shingle, similarity, and the forest's shape.

    recall: probability with which the prefixes must bring a pair of just that similarity
    together; it sets the shortest prefix, and no count or sample of the texts does.
    margin: signatures this far below the similarity rule a pair out (over four
    standard deviations at 128 labels).
    """

    shingle: int = 5
    similarity_percent: int = 80
    trees: int = 16
    labels: int = 8
    recall: float = 0.9995
    margin: float = 0.15
    block: int = 1024
    verify_block: int = 256

    def prefixes(self) -> list[int]:
        """Lengths of the trie's levels, from the longest to the one that reaches the recall."""
        lengths = range(self.labels, 0, -1)
        enough = (k for k in lengths if self.meets(self.similarity_percent / 100, k) >= self.recall)
        return list(range(self.labels, next(enough, 1) - 1, -1))

    def meets(self, similarity: np.ndarray | float, prefix: int):
        """Probability that two nodes share a prefix of this length in some tree."""
        return 1 - (1 - np.asarray(similarity, float) ** prefix) ** self.trees


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.lower().encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes], size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; a shorter text is one run, an empty one none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(n, size)
    key = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - span + 1 + k]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


def minhash(keys: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least product with each odd factor, upper half."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(keys), 2048):
        np.minimum(low, (keys[start : start + 2048, None] * factors).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch(texts: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, digest (of the words; null without words), labels (int array)."""
    factors = np.random.default_rng(1).integers(0, 2**63, forest.trees * forest.labels, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in in_slices(batch):
                digests, labels = [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                    labels.append(minhash(shingles(words, forest.shingle, hashes), factors).view(np.int32) if words else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.binary()), pa.array(labels, pa.list_(pa.int32()))], names=["doc_id", "digest", "labels"]
                )

    return texts.mapInArrow(run, "doc_id long, digest binary, labels array<int>")


def shingle_sets(texts: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, keys: the sorted distinct shingle hashes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in in_slices(batch):
                keys = [np.unique(shingles(words_of(t), forest.shingle, hashes)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary())], names=["doc_id", "keys"])

    return texts.mapInArrow(run, "doc_id long, keys binary")


def in_cells(members: DataFrame, group: str, block: int) -> DataFrame:
    """Members of each group of two or more, with the block pairs (cells) they take part in.

    A group of up to ``block`` members is one cell.  A larger one is cut into
    blocks by a hash; each pair of blocks is a cell, so that no task ever holds
    more than two blocks and all pairs of the group meet in some cell.
    """
    sizes = stored(members.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), "group-sizes")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    others = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    paired = placed.select("*", others)
    cell = F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))
    return paired.select(group, "node", "block", (F.col("block") == F.col("other")).alias("inner"), cell.alias("cell"))


def runs_of_equal(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values in a sorted column, however batches cut them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy()
        last = int(np.flatnonzero(column[:-1] != column[1:])[-1]) + 1 if (column[:-1] != column[1:]).any() else 0
        fresh = held and held[-1].column(key)[-1] != batch.column(key)[0]
        if fresh:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


class _Sets:
    """Disjoint sets of row numbers, all labels up to date."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Unite the pairs; the pairs that did unite two sets."""
        apart = self.label[a] != self.label[b]
        done = []
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = self.label[i], self.label[j]
            if x != y:
                self.label[self.label == max(x, y)] = min(x, y)
                done.append((i, j))
        return done


def _near(a: np.ndarray, b: np.ndarray, forest: Forest) -> np.ndarray:
    """Whether the signatures' low bytes (rows of ``a`` and ``b``) leave the similarity possible."""
    similar = ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)
    return similar >= forest.similarity_percent / 100 - forest.margin


def _codes(column: pa.ChunkedArray | pa.Array, forest: Forest) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return flat.reshape(-1, forest.trees * forest.labels)


def trie_level(leaders: DataFrame, placed: DataFrame | None, prefix: int, forest: Forest) -> DataFrame:
    """(bucket, node, component) for each tree: the trie node that ``prefix`` labels lead to.

    Without ``placed``, the leaders bring their components along.
    """
    tree = F.sequence(F.lit(0), F.lit(forest.trees - 1))
    keys = F.transform(tree, lambda t: F.xxhash64(t, F.slice("labels", t * forest.labels + 1, prefix)))
    whole = leaders if placed is None else with_component(leaders, placed)
    return whole.select("node", "component", F.explode(keys).alias("bucket"))


def with_component(leaders: DataFrame, placed: DataFrame) -> DataFrame:
    """The leaders with the component they are placed in; their own where they are not."""
    whole = leaders.join(placed.select(F.col("node").alias("placed_node"), F.col("component").alias("found")), F.col("node") == F.col("placed_node"), "left")
    return whole.select("node", "labels", F.coalesce("found", "node").alias("component"))


def open_buckets(entries: DataFrame) -> DataFrame:
    """(bucket, head, head_component, n) of trie nodes with members that are not all united yet."""
    found = entries.groupBy("bucket").agg(
        F.min(F.struct("node", "component")).alias("first"), F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    return found.where("low < high").select("bucket", F.col("first.node").alias("head"), F.col("first.component").alias("head_component"), "n")


def by_node(rows: DataFrame, coded: DataFrame) -> DataFrame:
    """(node, codes, held): one row per node, ``held`` its rows as structs of the other columns.

    So the codes meet each node once, however many trie nodes or cells it is in.
    """
    held = rows.groupBy("node").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "node"])).alias("held"))
    return held.join(coded, F.col("node") == F.col("code_node")).select("node", "codes", "held")


def star_pairs(entries: DataFrame, heads: DataFrame, coded: DataFrame, forest: Forest) -> DataFrame:
    """(bucket, node, head, n, near, settled, united): every member of an open trie node with the least one, a row each.

    Trie nodes with more than a partition's share of the entries are dealt out in
    slices, each with a copy of the head; there are fewer of them than partitions,
    so their list may be broadcast.
    """
    share = F.lit(max(forest.block, (heads.agg(F.sum("n")).first()[0] or 0) // shuffle_partitions(heads.sparkSession)))
    heavy = F.broadcast(heads.where(F.col("n") > share).select(F.col("bucket").alias("heavy_bucket"), F.ceil(F.lit(8) * F.col("n") / share).cast("int").alias("slices")))
    is_heavy = F.col("bucket") == F.col("heavy_bucket")
    slices = F.coalesce("slices", F.lit(1))
    head_codes = coded.select(F.col("code_node").alias("head_node"), F.col("codes").alias("head_codes"))
    copies = heads.join(head_codes, F.col("head") == F.col("head_node")).join(heavy, is_heavy, "left")
    copies = copies.select(F.col("bucket").alias("at"), "head", "head_component", "n", "head_codes", F.explode(F.sequence(F.lit(0), slices - 1)).alias("at_slice"))
    members = entries.join(heavy, is_heavy, "left").select("bucket", "node", "component", F.pmod(F.xxhash64("node"), slices).cast("int").alias("slice"))
    met = members.join(copies, (F.col("bucket") == F.col("at")) & (F.col("slice") == F.col("at_slice"))).where("node <> head")
    met = met.select("node", "bucket", "head", "n", (F.col("component") == F.col("head_component")).alias("united"), "head_codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                node, codes, held = batch.slice(start, 1024).columns
                owner = np.repeat(np.arange(len(node)), held.value_lengths().to_numpy())
                bucket, head, n, united, head_codes = held.flatten().flatten()
                near = _near(_codes(codes, forest)[owner], _codes(head_codes, forest), forest)
                columns = [bucket, node.take(pa.array(owner)), head, n, pa.array(near), pa.array(near | united.to_numpy(zero_copy_only=False)), united]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "head", "n", "near", "settled", "united"])

    return by_node(met, coded).mapInArrow(run, "bucket long, node long, head long, n long, near boolean, settled boolean, united boolean")


def rest_edges(stars: DataFrame, coded: DataFrame, forest: Forest) -> DataFrame:
    """Edges (a, b) between members that are not with their trie node's head and all others of it.

    The rest of a trie node and all its members are cut into blocks; every block
    of the rest meets every block of members in a cell of its own.
    """
    rest = stars.where("n > 2 AND NOT settled").groupBy("bucket").agg(F.count("*").alias("n_rest"), F.first("n").alias("n_all"))
    rest = stored(rest, "rest-sizes").withColumnRenamed("bucket", "rest_bucket")
    placed = stars.join(rest, F.col("bucket") == F.col("rest_bucket"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(forest.block)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    as_rest = placed.where("NOT settled").select("bucket", "node", F.lit(True).alias("is_rest"), own("n_rest").alias("i"), F.explode(F.sequence(F.lit(0), blocks("n_all") - 1)).alias("j"))
    as_all = placed.select("bucket", "node", F.lit(False).alias("is_rest"), F.explode(F.sequence(F.lit(0), blocks("n_rest") - 1)).alias("i"), own("n_all").alias("j"))
    cells = as_rest.unionByName(as_all).select(F.xxhash64("bucket", "i", "j").alias("cell"), "node", "is_rest")
    ready = by_node(cells, coded).select("node", "codes", F.explode("held").alias("at")).select("at.cell", "node", "at.is_rest", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of_equal(batches, 0):
            cells, nodes = table.column(0).to_numpy(), table.column(1).to_numpy()
            is_rest, codes = table.column(2).to_numpy(), _codes(table.column(3), forest)
            cuts = [0, *(np.flatnonzero(cells[:-1] != cells[1:]) + 1).tolist(), len(cells)]
            edges: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                every, (ids, at) = codes[a:b], np.unique(nodes[a:b], return_inverse=True)
                sets = _Sets(len(ids))
                for k in np.flatnonzero(is_rest[a:b]).tolist():
                    near = at[_near(every, every[k], forest)]
                    edges += [(ids[i], ids[j]) for i, j in sets.join(np.full(len(near), at[k]), near)]
            columns = list(zip(*edges)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return ready.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def candidate_edges(entries: DataFrame, coded: DataFrame, forest: Forest) -> DataFrame:
    """Edges (a, b) that unite the candidates within trie nodes, beyond what is united already.

    Members of a trie node meet its least one; those that its signature rules
    out meet all others there.
    """
    heads = stored(open_buckets(entries), "trie-nodes")
    stars = stored(star_pairs(entries, heads, coded, forest), "stars")
    return stars.where("near AND NOT united").select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(rest_edges(stars, coded, forest))


def forest_clusters(leaders: DataFrame, forest: Forest) -> DataFrame:
    """(node, component): clusters of candidates, by descending the trees from their deepest trie nodes.

    Most candidates share a deepest trie node in some tree and are united first.
    The shorter prefixes, down to where the recall is reached at the least
    similarity, then leave out trie nodes whose members are all united; as
    they start from the same components, they are one job and not one each.
    """
    codes = F.unhex(F.array_join(F.transform("labels", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")), ""))
    coded = stored(leaders.select(F.col("node").alias("code_node"), codes.alias("codes")), "codes")
    deepest, *shorter = forest.prefixes()
    nowhere = leaders.sparkSession.createDataFrame([], "node long, component long")
    placed = components(candidate_edges(trie_level(leaders, nowhere, deepest, forest), coded, forest))
    if not shorter:
        return placed
    met = stored(with_component(leaders, placed), "placed")
    entries = reduce(DataFrame.unionByName, [trie_level(met, None, prefix, forest) for prefix in shorter])
    fresh = candidate_edges(entries, coded, forest)
    return components(placed.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh))


def _block_links(keys: list[np.ndarray], block: np.ndarray, inner: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of a cell whose Jaccard similarity reaches the percentage, exactly."""
    n = len(keys)
    size = np.fromiter(map(len, keys), np.int64, n)
    owner = np.repeat(np.arange(n), size)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1  # a shingle of one set adds nothing to an intersection
    column = (np.cumsum(shared) - 1)[column][keep := shared[column]]
    owner = owner[keep]
    both = np.zeros((n, n), np.int64)
    step = max(256, (4 << 20) // n)
    for start in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [start, start + step])
        held = np.zeros((n, step), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        both += np.rint(held @ held.T).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    linked = 100 * both >= percent * union
    if not inner:
        linked &= block[:, None] != block[None, :]
    return np.nonzero(np.triu(linked, 1))


def verified_links(clustered: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """(node, other, n_links): links of a node within a cell, and a node that it hangs on there."""
    cells = in_cells(clustered, "component", forest.verify_block)
    ready = cells.join(sets, cells["node"] == sets["doc_id"]).select("cell", "node", "block", "inner", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of_equal(batches, 0):
            cells, nodes, blocks, inner = (table.column(k).to_numpy() for k in range(4))
            cuts = [0, *(np.flatnonzero(cells[:-1] != cells[1:]) + 1).tolist(), len(cells)]
            keys = [np.frombuffer(x, np.uint64) for x in table.column(4).to_pylist()]
            out: list[tuple[int, int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                i, j = _block_links(keys[a:b], blocks[a:b], inner[a], forest.similarity_percent)
                links = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
                unions = _Sets(b - a)
                unions.join(i, j)
                out += zip(nodes[a:b].tolist(), nodes[a:b][unions.label].tolist(), links.tolist())
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "other", "n_links"])

    dealt = ready.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "node long, other long, n_links long")


def near_duplicates(df: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies.

    class_id: the least doc_id that is tied to the document by links.  n_links:
    other texts (texts with the same words are one) of at least the similarity.
    n_copies: documents with the same words, itself included.  Texts of fewer
    words than a shingle are one shingle.  Texts without words, null ones too,
    are a class of their own with no link.  Repeated rows are copies of each other.
    """
    texts = id_and_text(df, id_col, text_col)
    sketches = stored(sketch(texts, forest), "sketches")
    worded = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    leaders = stored(
        worded.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_copies"), F.first("labels").alias("labels")), "leaders"
    )
    clusters = forest_clusters(leaders.select("node", "labels"), forest)
    wanted = stored(clusters.select(F.col("node").alias("doc_id")), "wanted")
    sets = shingle_sets(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), forest)
    links = stored(verified_links(clusters.select("component", "node"), sets, forest), "links")
    totals = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    facts = stored(classes.join(totals, "node"), "classes").withColumnsRenamed({"component": "class_id"})
    copied = stored(leaders.where("n_copies > 1").select(F.col("digest").alias("copied"), F.col("node").alias("first"), "n_copies"), "copied")
    rows = sketches.select("doc_id", "digest").join(copied, F.col("digest") == F.col("copied"), "left")
    rows = rows.withColumn("own", F.coalesce("first", "doc_id"))
    return rows.join(facts, F.col("own") == F.col("node"), "left").select(
        "doc_id", F.coalesce("class_id", "own").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )
