"""Byte-pair encoding and decoding with segment trees (operator 8).

A piece of text is encoded by a segment tree whose leaves hold the rank of each
adjacent pair, tied by position: the root is the leftmost merge of lowest rank.
A merge updates the two pairs beside it, each in logarithmic time, until the
root says that nothing can be merged.  The trees of all new pieces of an Arrow
batch are rows of one array and step together; very long pieces get a tree each.

Pieces are remembered by each Python worker, up to a fixed number of them, as
the ids of a piece do not depend on what surrounds it.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from prefspark.llm.common import id_and_text

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Leaves of the largest trees that step together; longer pieces have one of their own.
WIDE = 64
#: Chunks that a worker remembers before it starts afresh with those in use.
REMEMBERED = 600_000
#: Marks that often end a word.
MARKS = ".,;:!?|&#*$%"
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class BytePairTokenizer:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE vocabularies are understood")
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.token_bytes = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_bytes |= {i: token.encode() for token, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab[char]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self._build_table()
        self.known: dict[str, bytes] = {}
        self.decoder = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN).findall

    def _build_table(self) -> None:
        """An open-addressing table of the pairs, sparse enough for one or two reads a look-up."""
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        ranks, merged = (np.array(x, np.int64) for x in zip(*self.ranks.values()))
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.table_rank, self.table_id = np.full((2, 1 << self.bits), -1, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = keys[left[free]]
            won = self.table[at] == keys[left]
            self.table_rank[at[won]], self.table_id[at[won]] = ranks[left[won]], merged[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair in the merge table, or -1; an id below 0 is no token."""
        keys = left << 32 | right
        found = self._slot(keys)
        there = self.table[found]
        go_on = np.flatnonzero((there != keys) & (there >= 0))
        while len(go_on):
            found[go_on] = (found[go_on] + 1) & ((1 << self.bits) - 1)
            there[go_on] = self.table[found[go_on]]
            go_on = go_on[(there[go_on] != keys[go_on]) & (there[go_on] >= 0)]
        return np.where((there == keys) & (left >= 0) & (right >= 0), found, -1)

    def _merge_together(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Encode pieces of at most ``leaves`` bytes, one tree a row, all rows in step."""
        rows = len(pieces)
        text = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(rows, leaves)
        length = np.fromiter(map(len, pieces), np.int64, rows)
        inside = np.arange(leaves) < length[:, None]
        ids = np.where(inside, self.byte_id[text], -1)
        after = np.where(np.arange(1, leaves + 1) < length[:, None], np.arange(1, leaves + 1), leaves)
        before = np.tile(np.arange(-1, leaves - 1), (rows, 1))
        slots = np.full((rows, leaves), -1, np.int64)
        slots[:, :-1] = self._look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, leaves - 1)
        tree = np.full((rows, 2 * leaves), NONE, np.int64)
        tree[:, leaves:] = np.where(slots >= 0, self.table_rank[slots] * leaves + np.arange(leaves), NONE)
        for k in range(leaves.bit_length() - 1, 0, -1):
            lo, hi = 1 << (k - 1), 1 << k
            tree[:, lo:hi] = np.minimum(tree[:, hi : 2 * hi : 2], tree[:, hi + 1 : 2 * hi : 2])
        flat_tree, flat_ids, flat_after, flat_before = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node, base = leaf + leaves, row * 2 * leaves
            flat_tree[base + node] = value
            while leaves > 1 and node[0] > 1:  # all leaves lie equally deep
                node = node >> 1
                flat_tree[base + node] = np.minimum(flat_tree[base + 2 * node], flat_tree[base + 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            left = flat_tree[row * 2 * leaves + 1] % leaves
            cell = row * leaves + left
            right = flat_after[cell]
            slot = self._look_up(flat_ids[cell], flat_ids[row * leaves + right])
            flat_ids[cell] = self.table_id[slot]
            flat_ids[row * leaves + right] = -1
            onward = flat_after[row * leaves + right]
            flat_after[cell] = onward
            has = onward < leaves
            flat_before[(row * leaves + onward)[has]] = left[has]
            put(row, right, np.full(len(row), NONE))
            next_id = np.where(has, flat_ids[row * leaves + np.minimum(onward, leaves - 1)], -1)
            slot = self._look_up(flat_ids[cell], next_id)
            put(row, left, np.where(slot >= 0, self.table_rank[slot] * leaves + left, NONE))
            back = flat_before[cell]
            has = back >= 0
            if has.any():
                r, b = row[has], back[has]
                slot = self._look_up(flat_ids[r * leaves + b], flat_ids[cell[has]])
                put(r, b, np.where(slot >= 0, self.table_rank[slot] * leaves + b, NONE))
            row = row[flat_tree[row * 2 * leaves + 1] != NONE]
        alive = ids >= 0
        ends = np.cumsum(alive.sum(1)) * 4
        packed = ids[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_alone(self, piece: bytes) -> bytes:
        """The same for one long piece: a tree in a list, updates from leaf to root."""
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        ids: list[int] = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        none = (1 << 62, 0)
        rank = lambda a, b: self.ranks.get((ids[a], ids[b]), none)[0]
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            if (r := rank(i, i + 1)) < none[0]:
                tree[leaves + i] = (r, i)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: tuple[int, int]) -> None:
            node = leaf + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            left = tree[1][1]
            right = after[left]
            ids[left], ids[right] = self.ranks[ids[left], ids[right]][1], -1
            onward = after[left] = after[right]
            put(right, none)
            if onward < n:
                before[onward] = left
            put(left, (r, left) if onward < n and (r := rank(left, onward)) < none[0] else none)
            if (back := before[left]) >= 0:
                put(back, (r, back) if (r := rank(back, left)) < none[0] else none)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 4 bytes each) of pieces that the pattern has split."""
        out = np.full(len(pieces), b"", object)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        classes = np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        for k in np.unique(classes[sizes > 0]).tolist():
            members, leaves = np.flatnonzero((classes == k) & (sizes > 0)), 1 << k
            if leaves > WIDE:
                for i in members.tolist():
                    out[i] = self._merge_alone(pieces[i])
                continue
            step = (1 << 19) // leaves
            for start in range(0, len(members), step):
                part = members[start : start + step]
                out[part] = self._merge_together([pieces[i] for i in part.tolist()], leaves)
        return out.tolist()

    def _learn(self, keys: set[str]) -> None:
        """Encode the chunks of ``keys`` (see ``chunk_keys``) that are not remembered yet."""
        known = self.known
        words = {key for key in keys if key.isalpha()}  # a blank and letters: one piece
        ended: list[tuple[str, str, str]] = []  # such a word and the marks behind it
        split: dict[str, list[str]] = {}
        for key in keys - words:
            lead, body = (" ", key) if key[:1] not in ("\n", "\0") else (key[0].strip("\0"), key[1:])
            stem = body.rstrip(MARKS)
            if lead and stem.isalpha():  # marks are neither letters, digits nor blanks: those behind a word are one piece
                if lead == " ":
                    ended.append((key, stem, body[len(stem) :]))
                else:
                    split[key] = [lead, stem, body[len(stem) :]] if len(stem) < len(body) else [lead, stem]
            else:
                split[key] = self.pieces(lead + body)
        pieces = {piece for parts in split.values() for piece in parts}
        pieces.update({marks for _, _, marks in ended})
        words.update([stem for _, stem, _ in ended])
        fresh = list(words - known.keys())
        known.update(zip(fresh, self.encode_pieces([b" " + w.encode() for w in fresh])))
        others = list(pieces)
        ids = dict(zip(others, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in others])))
        for key, stem, marks in ended:
            known[key] = known[stem] + ids[marks]
        for key, parts in split.items():
            known[key] = b"".join([ids[p] for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles: passes over them free nothing
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list] = []
        for text in texts:
            spans = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
            parts.append([np.array([self.special[s]], "<u4").tobytes() if s in self.special else chunk_keys(s) for s in spans])
        out: list[bytes] = []
        start = 0
        while start < len(parts):  # so many texts at a time that their chunks fit what is remembered
            stop, wanted = start, set()
            while stop < len(parts) and (stop == start or len(wanted) < REMEMBERED // 4):
                for span in parts[stop]:
                    if not isinstance(span, bytes):
                        wanted.update(span)
                stop += 1
            fresh = wanted - self.known.keys()
            if len(self.known) + len(fresh) > REMEMBERED:
                # Start afresh with what is in use now: that has the frequent chunks.
                self.known = {key: self.known[key] for key in wanted - fresh}
            if fresh:
                self._learn(fresh)
            get = self.known.__getitem__
            for spans in parts[start:stop]:
                out.append(b"".join([s if isinstance(s, bytes) else b"".join(map(get, s)) for s in spans]))
            start = stop
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        tokens = self.decoder
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _plain_blanks(text: str) -> bool:
    """True when all white space is single blanks and line feeds between other characters."""
    if text[0] in " \n" or text[-1] in " \n" or "\0" in text or any(two in text for two in ("  ", " \n", "\n ", "\n\n")):
        return False
    return not any(map(text.__contains__, _ODD_ASCII)) if text.isascii() else _ODD_BLANK.search(text) is None


def chunk_keys(text: str) -> list[str]:
    """Cut a text into chunks that can be encoded by themselves.

    Before a blank or line feed that stands between two other characters a piece
    of the pattern ends, and none looks beyond.  A key is a chunk without the
    blank it begins with, or a chunk that begins with a line feed, or "\\0" and
    a chunk that begins with neither.  A text with other white space is one chunk.
    """
    if not text:
        return []
    if not _plain_blanks(text):
        return _odd_chunks(text)
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = "\0" + keys[0]
    return keys


def _odd_chunks(text: str) -> list[str]:
    """The same for any text: cut only before blanks and line feeds with neighbours of other kinds."""
    keys, start = [], 0
    for m in _PLAIN_BLANK.finditer(text):
        keys.append(text[start : m.start()])
        start = m.start()
    keys.append(text[start:])
    return [k[1:] if k[0] == " " and k[1:2] not in ("\n", "\0") else k if k[0] == "\n" else "\0" + k for k in keys]


#: White space other than blanks and line feeds.
_ODD_ASCII = [c for c in map(chr, range(128)) if c.isspace() and c not in " \n"]
_ODD_BLANK = re.compile(r"[^\S \n]")
_PLAIN_BLANK = regex.compile(r"(?<=\S)[ \n](?=\S)")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BytePairTokenizer:
    """One tokenizer per Python worker and vocabulary file."""
    return BytePairTokenizer(path)


def in_slices(batch: pa.RecordBatch, target_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``target_bytes``, a row at least."""
    rows = max(1, int(batch.num_rows * min(1.0, target_bytes / max(1, batch.nbytes))))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def round_trips(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (binary, 4 bytes each), decoded.

    Null and empty texts have no token.  Special tokens spelled out in a text are
    recognised, as the vocabulary's own library does.  Repeated rows give equal
    rows.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            for part in in_slices(batch):
                ids = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``round_trips`` with digests in place of ids and text, taken where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, digest = tokenizer(vocabulary), lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for part in in_slices(batch):
                ids = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array([digest(coder.decode(x).encode()) for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
