"""Removal of byte strings that an earlier document holds, by suffix sorting (operator 10).

Two equal windows of 50 bytes hold the same least-hashed substring of 20 bytes
(their anchor) at the same place, so windows can be dealt out by anchor - those of
an anchor that exceeds a shard by themselves, and compared by digest.  A window also holds the 15 bytes
before its anchor or the 15 behind, so a run of windows repeats nowhere unless
another document has its anchor with the same bytes on that side.  The others are
cut out, equal pieces are put together on the map side, and shards of pieces are
suffix-sorted by external induced sorting (``induced.py``), but for those alone
under their anchor; neighbours that share 50 bytes form a class, and the least
doc_id of a class removes its windows from all other documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prefspark.llm.bpe import in_slices
from prefspark.llm.common import id_and_text, stored
from prefspark.llm.induced import MEMORY_ITEMS, sorted_windows
from prefspark.llm.ngram_join import runs_of_equal
from prefspark.session import shuffle_partitions

LENGTH = 50
ANCHOR = 20
#: Bytes beside its anchor that every window holds on one side at least.
SIDE = (LENGTH - ANCHOR) // 2
#: Bytes of texts whose runs a task holds at a time: about a third of an Arrow batch of ordinary texts.
BATCH_BYTES = 8 << 20
#: Runs of one anchor in such a part from which on all others of it are kept unseen.
HOT = 64
#: Bytes of pieces that one task sorts.
SHARD_BYTES = 4 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 32) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, to start the hashes from.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def substring_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size a number for every substring of so many bytes, from those of powers of two; not mixed yet."""
    power, span, out, done = _BYTES[data], 1, [None] * len(sizes), [0] * len(sizes)
    while True:
        factor = _mix(np.uint64([span]))[0] | np.uint64(1)
        for k, size in enumerate(sizes):
            if size & span:
                part = power[done[k] :]
                out[k] = part if out[k] is None else out[k][: len(part)] * factor + part
                done[k] += span
        if 2 * span > max(sizes):
            return out
        power = power[:-span] * factor + power[span:]
        span *= 2


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor, text number, first window, windows, left, right.

    The anchor is the leftmost of the least substrings of a window.  ``left`` and
    ``right`` are 16 bits of a hash of the anchor with the bytes on that side, 0
    where the text has none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(text[: max(0, len(data) - LENGTH + 1)] == text[LENGTH - 1 :])
    if not len(inside):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 5
    hashes, stretch = substring_hashes(data, ANCHOR, ANCHOR + SIDE)
    hashes, span, window = _mix(hashes), 1, LENGTH - ANCHOR + 1
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    while span < window:
        step = min(span, window - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    spot = (low[inside] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    count = np.diff(np.append(first, len(inside)))
    spot, start = spot[first], inside[first]
    owner = text[start]
    begin, end = (ends - sizes)[owner], ends[owner]
    side = lambda at: np.maximum((_mix(stretch[np.clip(at, 0, len(stretch) - 1)]) >> np.uint64(48)).astype(np.int64), 1)
    left = np.where(spot - SIDE >= begin, side(spot - SIDE), 0)
    right = np.where(spot + ANCHOR + SIDE <= end, side(spot), 0)
    return hashes[spot], owner, start - begin, count, left, right


def matched(anchor: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which runs have their anchor and this side in another document too."""
    key = (anchor & ~np.uint64(0xFFFF)) | side.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    docs = doc[order]
    shared = (np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)) & (side[order][first] > 0)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(shared, np.diff(np.append(first, len(key))))
    return out


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Integer columns of one length, compressed: offsets from the least, byte by byte."""
    parts = [len(columns[0]).to_bytes(4, "little")]
    for column in columns:
        least = int(column.min())
        rest = (column - least).astype("<u8").view(np.uint8).reshape(-1, 8)
        width = max(1, (int(rest.view("<u8").max()).bit_length() + 7) // 8)
        parts += [least.to_bytes(8, "little", signed=True), bytes([width]), rest[:, :width].T.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_columns(data: bytes, n_columns: int) -> list[np.ndarray]:
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    rows, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for _ in range(n_columns):
        least, width = int.from_bytes(raw[at : at + 8], "little", signed=True), raw[at + 8]
        planes = np.frombuffer(raw, np.uint8, rows * width, at + 9).reshape(width, rows)
        value = np.zeros((rows, 8), np.uint8)
        value[:, :width] = planes.T
        out.append(value.view("<u8").reshape(-1).astype(np.int64) + least)
        at += 9 + rows * width
    return out


def anchors(texts: DataFrame, bucket_bits: int) -> DataFrame:
    """(bucket, lead, data): every run, packed, by the leading bits of its anchor.

    Runs that match another document of the same part (of ``BATCH_BYTES``) are known to repeat: they
    come in buckets of their own, below 0, dealt out evenly, and one run of no
    windows for each side tells the anchor's bucket.  Anchors with ``HOT`` runs in
    a part are known as a whole, and one run without sides tells that.  So what
    much of the corpus shares adds a run or two per part to a bucket, not one
    per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(part for whole in batches for part in in_slices(whole, BATCH_BYTES)):
            found = []
            for part in in_slices(batch, BATCH_BYTES >> 4):
                docs = part.column(0).to_numpy()
                anchor, owner, *rest = anchor_runs([t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
                found.append((anchor, docs[owner], *rest))
            columns = [np.concatenate(x) for x in zip(*found)]
            del found
            if not columns or not len(columns[0]):
                continue
            order = np.argsort(columns[0], kind="stable")
            anchor, doc, start, count, left, right = (c[order] for c in columns)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(first, len(anchor)))
            hot = (size >= HOT) & (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
            near = matched(anchor, left, doc) | matched(anchor, right, doc)
            known = near | np.repeat(hot, size)
            beacons = []
            for side in (left, right):
                spots = np.flatnonzero(near & (side > 0) & ~np.repeat(hot, size))
                _, one = np.unique((anchor[spots] & ~np.uint64(0xFFFF)) | side[spots].astype(np.uint64), return_index=True)
                beacons.append(spots[one])
            beacons = np.unique(np.concatenate([first[hot], *beacons]))
            sides = left << 16 | right
            told = np.concatenate([np.flatnonzero(~known), beacons])
            told_count = np.concatenate([count[~known], np.zeros(len(beacons), np.int64)])
            told_sides = np.concatenate([sides[~known], np.where(np.repeat(hot, size)[beacons], 0, sides[beacons])])
            order = np.argsort(anchor[told], kind="stable")
            told, told_count, told_sides = told[order], told_count[order], told_sides[order]
            out = []

            def add(number: int, spots: np.ndarray, counts: np.ndarray, sides_: np.ndarray) -> None:
                steps = np.diff(anchor[spots], prepend=np.uint64(0)).view(np.int64)
                lead, steps = int(steps[0]), np.concatenate([[0], steps[1:]])
                out.append((number, lead, pack_columns([steps, doc[spots], start[spots], counts, sides_])))

            bucket = (anchor[told] >> np.uint64(64 - bucket_bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    add(int(bucket[a]), told[a:b], told_count[a:b], told_sides[a:b])
            spots = np.flatnonzero(known)
            for k in range(0, len(spots), 4096):  # evenly, a few thousand runs each
                some = spots[k : k + 4096]
                add(-1 - hash((turn, int(doc[some[0]]), k)) % (1 << bucket_bits), some, count[some], sides[some])
            columns = list(zip(*out))
            types = pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "lead", "data"])

    return texts.mapInArrow(run, "bucket long, lead long, data binary")


def repeated_runs(packed: DataFrame) -> DataFrame:
    """The runs that match another document: doc_id, anchor, start, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of_equal(batches, 0):
            buckets = table.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                parts = []
                for lead, data in zip(table.column(1)[a:b].to_pylist(), table.column(2)[a:b].to_pylist()):
                    steps, *rest = unpack_columns(data, 5)
                    parts.append((np.cumsum(steps) + lead, *rest))
                anchor, doc, start, count, sides = (np.concatenate(x) for x in zip(*parts))
                if buckets[a] >= 0:
                    keep = matched(anchor.view(np.uint64), sides >> 16, doc) | matched(anchor.view(np.uint64), sides & 0xFFFF, doc)
                    keep |= np.isin(anchor, anchor[(count == 0) & (sides == 0)])
                    keep &= count > 0
                    anchor, doc, start, count = anchor[keep], doc[keep], start[keep], count[keep]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, anchor, start, count)], names=["doc_id", "anchor", "start", "windows"])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, anchor long, start long, windows long")


def cut_out(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(piece, anchor, doc_id, text_key, start, content): the bytes of each run's windows; piece is their digest.

    Texts of one doc_id are told apart by ``text_key``; each is cut at the places
    of all of them, and what is cut is judged by its own bytes.
    """
    listed = places.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("places"))
    columns = [F.col(f"places.{c}").alias(f"{c}s") for c in ("anchor", "start", "windows")]
    joined = texts.join(listed, "doc_id").select("doc_id", F.xxhash64("text").alias("text_key"), "text", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 4 << 20):
                sizes = part.column(3).value_lengths().to_numpy()
                anchor, start, windows = (part.column(k).flatten() for k in (3, 4, 5))
                starts = start.to_numpy()
                spans, contents = zip(starts.tolist(), (starts + windows.to_numpy() + LENGTH - 1).tolist()), []
                for text, size in zip(part.column(2).to_pylist(), sizes.tolist()):
                    data = text.encode("utf-8", "surrogatepass")
                    contents += [data[a:b] for a, b in islice(spans, size)]
                digests = pa.array([hashlib.md5(c).digest() for c in contents], pa.binary())
                doc, key = (pa.array(np.repeat(part.column(k).to_numpy(), sizes)) for k in (0, 1))
                names = ["piece", "anchor", "doc_id", "text_key", "start", "content"]
                yield pa.RecordBatch.from_arrays([digests, anchor, doc, key, start, pa.array(contents, pa.binary())], names=names)

    return joined.mapInArrow(run, "piece binary, anchor long, doc_id long, text_key long, start long, content binary")


def first_documents(contents: list[bytes], first: np.ndarray, memory_items: int = MEMORY_ITEMS) -> list[tuple[int, int, int, int]]:
    """(content number, from, to, least doc_id): runs of windows of a shard with the document that has them first."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.frombuffer(b"".join(c + b"\0" for c in contents), np.uint8).astype(np.int64) + 2
    symbols[starts + sizes] = 1  # the end of a content, whatever its bytes are
    order, classes = sorted_windows(symbols, LENGTH, memory_items)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    order, classes = order[1:], classes[1:]  # without the end mark
    offset = order - starts[owner[order]]
    windows = offset + LENGTH <= sizes[owner[order]]
    order, classes, offset = order[windows], classes[windows], offset[windows]
    content = owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    least = np.repeat(np.minimum.reduceat(first[content], cuts), np.diff(np.append(cuts, len(order))))
    back = np.argsort(order)
    content, offset, least = content[back], offset[back], least[back]
    cuts = np.flatnonzero(np.concatenate([[True], (content[1:] != content[:-1]) | (least[1:] != least[:-1])]))
    last = np.append(cuts[1:], len(content)) - 1
    return list(zip(content[cuts].tolist(), offset[cuts].tolist(), offset[last].tolist(), least[cuts].tolist()))


def shard_verdicts(anchor: np.ndarray, contents: list[bytes], first: np.ndarray, n: np.ndarray, memory_items: int = MEMORY_ITEMS) -> list[tuple[int, int, int, int]]:
    """What ``first_documents`` finds that removes anything, for contents of whole anchors.

    A content alone under its anchor shares no window with another one: all windows
    are its own, each with the anchor at another place, so it needs no sorting.
    """
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    alone = size[group] == 1
    among = np.flatnonzero(~alone)
    found = first_documents([contents[k] for k in among], first[among], memory_items) if len(among) else []
    # What only its own first document holds removes nothing.
    found = [(k, *x) for j, *x in found if x[2] < first[k := int(among[j])] or n[k] > 1]
    found += [(k, 0, len(contents[k]) - LENGTH, int(first[k])) for k in np.flatnonzero(alone & (n > 1)).tolist() if len(contents[k]) >= LENGTH]
    return found


def window_verdicts(contents: DataFrame) -> DataFrame:
    """(piece, from, to, least) of contents whose anchor exceeds a shard: a row per window, dealt out by its digest.

    A content has at most ``LENGTH - ANCHOR + 1`` windows.  The first documents of
    repeated windows are stored, so that the join back meets plain shuffles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 1 << 20):
                out = []
                for content, first, n in zip(*(part.column(k).to_pylist() for k in range(3))):
                    piece = hashlib.md5(content).digest()
                    out += [(piece, at, hashlib.md5(content[at : at + LENGTH]).digest(), first, n) for at in range(len(content) - LENGTH + 1)]
                columns = list(zip(*out)) or [[]] * 5
                types = pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["piece", "from", "window", "first", "n"])

    windows = contents.select("content", "first", "n").mapInArrow(run, "piece binary, from long, window binary, first long, n long")
    earliest = windows.groupBy("window").agg(F.min("first").alias("least"), F.max("first").alias("latest"))
    repeated = stored(earliest.where("least < latest").select(F.col("window").alias("same_window"), "least"), "repeated-windows")
    both = windows.join(repeated, F.col("window") == F.col("same_window"), "left").withColumn("least", F.coalesce("least", "first"))
    # What only its own first document holds removes nothing.
    return both.where("least < first OR n > 1").select("piece", "from", F.col("from").alias("to"), "least")


def removed_windows(pieces: DataFrame, shard_bytes: int = SHARD_BYTES, memory_items: int = MEMORY_ITEMS) -> DataFrame:
    """(doc_id, text_key, start, end): byte intervals covered by windows of an earlier document; end is the last byte."""
    contents = stored(pieces.groupBy("content", "anchor").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "contents")
    sizes = stored(contents.groupBy("anchor").agg(F.sum(F.octet_length("content") + 1).alias("size")), "anchor-sizes")
    # At most one anchor for each shard of contents, so the list may be broadcast.
    large = F.broadcast(sizes.where(F.col("size") > shard_bytes).select(F.col("anchor").alias("large_anchor")))
    is_large = F.col("anchor") == F.col("large_anchor")
    total = sizes.where(F.col("size") <= shard_bytes).agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        texts, (anchor, first, n) = whole.column(0).to_pylist(), (whole.column(k).to_numpy() for k in (1, 2, 3))
        found = shard_verdicts(anchor, texts, first, n, memory_items)
        digests = {k: hashlib.md5(texts[k]).digest() for k in {x[0] for x in found}}
        columns = list(zip(*found)) or [[]] * 4
        arrays = [pa.array([digests[k] for k in columns[0]], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])]
        yield pa.RecordBatch.from_arrays(arrays, names=["piece", "from", "to", "least"])

    dealt = contents.join(large, is_large, "left_anti").repartition(shards, "anchor").select("content", "anchor", "first", "n")
    sorted_out = dealt.mapInArrow(run, "piece binary, from long, to long, least long")
    verdicts = stored(sorted_out.unionByName(window_verdicts(contents.join(large, is_large, "left_semi"))), "verdicts")
    hits = pieces.select("piece", "doc_id", "text_key", "start").join(verdicts, "piece").where("least < doc_id")
    return hits.select("doc_id", "text_key", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to") + LENGTH - 1).alias("end"))


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Intervals in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(starts, ends)):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    A byte goes if a 50-byte string that covers it also starts in a document with
    a smaller doc_id; strings are judged on the input.  Repeats inside a document
    and between rows of one doc_id stay, and so does a document without doc_id;
    different texts of one doc_id lose only what is in them.
    Null texts are empty.  ``kept`` may cut a UTF-8 sequence, so it is binary.
    """
    texts = id_and_text(df, id_col, text_col)
    known = texts.where("doc_id IS NOT NULL")
    # Sixteen buckets a partition, so that a task holds a small part of one at a time.
    bucket_bits = max(8, (16 * shuffle_partitions(df.sparkSession)).bit_length())
    places = stored(repeated_runs(anchors(known, bucket_bits)), "repeated-runs")
    pieces = stored(cut_out(known, places), "pieces")
    covers = removed_windows(pieces, shard_bytes)
    runs = covers.groupBy(F.col("doc_id").alias("run_id"), "text_key").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    runs = stored(runs.select("run_id", "text_key", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends")), "removed-runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch):
                out = []
                for doc, text, starts, ends in zip(*(part.column(k).to_pylist() for k in range(4))):
                    data = text.encode("utf-8", "surrogatepass")
                    spans = merged(starts or [], ends or [])
                    cuts = [0, *(x for a, b in spans for x in (a, b + 1)), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                    out.append((doc, len(data), len(data) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
                types = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
                )

    own = (F.col("doc_id") == F.col("run_id")) & (F.xxhash64("text") == F.col("text_key"))
    both = texts.join(runs, own, "left").select("doc_id", "text", "starts", "ends")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
