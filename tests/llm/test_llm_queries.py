"""The registered training-data queries: against SQL, the tokenizers library, brute force or labels."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import check
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefspark.llm import bpe, induced, langid, packing, suffix_dedup
from prefspark.llm.common import vocabulary
from prefspark.llm.queries import ORACLES, QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return check.connect(SMALL)


@pytest.fixture(scope="module")
def texts(db):
    return {i: t or "" for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    assert check.compare(spark, db, SMALL, name) == ""


def test_bpe_equals_the_library(spark, texts, library):
    for row in QUERIES["op8_bpe"](spark, SMALL).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_white_space_specials_and_long_pieces(library):
    draw = random.Random(1)
    alphabet = [" ", "\n", "a", "b", "'", "s", "1", "é", "!", "\t", " ", "th", "\x1c", "​", "\0", "<|endoftext|>", "日本"]
    hard = ["", " ", "  a", "a \nb", "a\n b", "x" * 3000, "ab" * 200, "0123456789" * 30, "a\0b", "\0", " \0x"]
    hard += ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 50))) for _ in range(1500)]
    coder = bpe.tokenizer(vocabulary())
    for text, ids in zip(hard, coder.encode(hard)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_packing_tiles_documents_and_sequences(spark, texts, library):
    rows = QUERIES["op6_best_fit_packing"](spark, SMALL).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = library.encode(texts[doc], add_special_tokens=False).ids + [0]
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at and (p.length == 2048 or p.piece == 0)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in pieces])
        assert [p.offset for p in pieces] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.02 * total / 2048 + 1


def test_local_search_never_adds_bins_and_raises_fill():
    draw = np.random.default_rng(0)
    for _ in range(20):
        lengths = draw.integers(1, 100, 200)
        before, _ = packing.pack(lengths, 100, rounds=0)
        after, offset = packing.pack(lengths, 100, rounds=4)
        fill = lambda x: (np.bincount(x, lengths) ** 2).sum()
        assert after.max() <= before.max() and np.bincount(after, lengths).max() <= 100 and fill(after) >= fill(before)


def test_swaps_empty_a_bin_that_best_fit_leaves():
    lengths = np.array([6, 5, 4, 3, 2])  # best fit by length: 6+4, 5+3+2
    number, _ = packing.pack(lengths, 10)
    assert number.max() == 1
    bins = packing.Bins(10)
    bins.content, bins.fill = [[0], [1, 2], [3]], [6, 7, 4]
    bins.improve(np.array([6, 4, 3, 4]), 4)
    assert sorted(f for f in bins.fill if f) == [7, 10]


def test_language_of_held_out_documents(spark):
    lang = dict(check.connect(LARGER).execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op9_language_id"](spark, LARGER).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_filters_return_all_languages_with_an_ngram():
    keys = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slots = np.zeros((2, 1 << 12), np.uint64)
    for i, key_range in ((0, keys[:100]), (70, keys[50:150])):
        for at in langid.slots_of(key_range, 12, 2):
            slots[i // 64, at] |= np.uint64(1 << i % 64)
    known = langid.LanguageFilters([f"l{i}" for i in range(71)], slots, 2)
    masks = known.contains(keys)
    assert all((masks[0][:100] & np.uint64(1)) == 1) and all((masks[1][50:150] >> np.uint64(6)) & np.uint64(1) == 1)


def test_toxicity_of_held_out_documents(spark):
    toxic = dict(check.connect(LARGER).execute("SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL").fetchall())
    rows = QUERIES["op5_toxicity"](spark, LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    caught = sum(r.predicted for r in held if toxic[r.doc_id]) / sum(toxic[r.doc_id] for r in held)
    wrong = sum(r.predicted for r in held if not toxic[r.doc_id]) / sum(not toxic[r.doc_id] for r in held)
    assert caught >= 0.6 and wrong <= 0.05


def test_secrets_are_found_and_numbers_left(spark, texts):
    rows = QUERIES["op7_secret_scan"](spark, SMALL).collect()
    pattern = re.compile(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}', re.I)
    want = {(doc, m.start(), m.end() - m.start()) for doc, text in texts.items() for m in pattern.finditer(text)}
    assert {(r.doc_id, r.start, r.length) for r in rows if r.is_secret} == want
    for r in rows:
        value = texts[r.doc_id][r.start : r.start + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256


def brute_force_removal(documents):
    """doc_id -> (bytes, removed, spans, digest) by looking every window up."""
    seen, out = set(), {}
    for doc in sorted(documents):
        data = documents[doc].encode()
        gone, own = bytearray(len(data)), set()
        for at in range(len(data) - 49):
            window = data[at : at + 50]
            own.add(window)
            if window in seen:
                gone[at : at + 50] = b"\1" * 50
        seen |= own
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_removal_equals_brute_force(spark, texts):
    rows = QUERIES["op10_suffix_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_force_removal(texts)


def test_suffix_removal_on_periodic_and_overlapping_texts(spark):
    draw = random.Random(4)
    words = ["a", "ab", "ß", "x" * 30, "passage of words ", "\n"]
    documents = {i: "".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for i in range(60)}
    documents |= {100: "ab" * 400, 101: "ab" * 300, 102: "ba" * 26, 103: "é" * 120, 104: "x" * 49, 105: "x" * 49}
    df = spark.createDataFrame(list(documents.items()), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df, shard_bytes=5000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_force_removal(documents)


def test_suffix_removal_with_a_phrase_that_most_documents_share(spark):
    """More runs of one anchor in a batch than are looked at one by one."""
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choice("abcdefghijklmnop ") for _ in range(n))
    phrase, passage = "a phrase of some thirty letters", noise(90)
    documents = {i: noise(80) + phrase + noise(80) for i in range(200)}
    documents |= {300 + i: noise(40) + (passage if i % 2 else passage[20:]) + noise(draw.randint(0, 9)) for i in range(150)}
    df = spark.createDataFrame(list(documents.items()), "doc_id long, text string").repartition(2)
    rows = suffix_dedup.remove_repeats(df, shard_bytes=5000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_force_removal(documents)


def test_induced_sorting_in_memory_and_on_disk():
    draw = np.random.default_rng(0)
    for _ in range(150):
        text = draw.integers(1, draw.integers(2, 6), draw.integers(1, 80))
        whole = [*text.tolist(), 0]
        want = sorted(range(len(whole)), key=lambda i: whole[i:])
        for memory_items in (1 << 20, 7):
            order, classes = induced.sorted_windows(text, 5, memory_items)
            assert order.tolist() == want
        full = [k for k in range(1, len(want)) if max(want[k - 1], want[k]) + 5 <= len(whole)]
        for k in full:
            assert (classes[k] == classes[k - 1]) == (whole[want[k] : want[k] + 5] == whole[want[k - 1] : want[k - 1] + 5])


def test_pipeline_keeps_clean_documents_and_applies_decisions(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        after = docs.collect()
        assert {r.doc_id for r in after} <= before and len(after) == len({r.doc_id for r in after})
        assert all(r.n_chars == len(r.text) for r in after if r.text != texts[r.doc_id])
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "secret_scan":
            assert {r.doc_id for r in after} == before
            assert not any(re.search(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}", r.text) for r in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in after}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
