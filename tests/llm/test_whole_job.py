"""Inputs on which the operators once did less than the whole job."""

import itertools
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefspark.llm import components, induced, langid, ngram_join, packing, suffix_dedup


def test_language_filters_grow_with_their_ngrams(spark):
    """More typical n-grams than 2**20: the filters keep their rate of false positives, and texts their language."""
    rng = random.Random(1)
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000)) for _ in range(200)]
    hangul = ["".join(chr(rng.randrange(0xAC00, 0xD7A3)) for _ in range(4000)) for _ in range(20)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "zh") for t in han] + [(t, "ko") for t in hangul])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    filters = langid.learn(docs, min_count=1)
    assert filters.slots.shape[1] > 1 << 20
    assert (filters.false_positive_rates() <= 1.02 * langid.FALSE_POSITIVES).all()
    found = {r.doc_id: r for r in langid.identify(docs, filters).collect()}
    assert all(found[i].lang_pred == lang and found[i].score > 0.99 and found[i].margin > 0.9 for i, _, lang in rows)
    shares, _ = filters.shares(["nothing of these languages", han[0]])
    assert np.allclose(shares[0], 0, atol=0.3) and shares[1].argmax() == filters.languages.index("zh")


def test_packing_exchanges_with_all_open_bins():
    """20,000 mid-sized pieces fit poorly: exchanges with the 16 fullest bins saved none of 9,160 bins."""
    lengths = np.random.default_rng(0).integers(600, 1101, 20_000)
    before, _ = packing.pack(lengths, 2048, rounds=0)
    after, _ = packing.pack(lengths, 2048)
    assert np.bincount(after, lengths).max() <= 2048 and np.bincount(after).min() > 0
    assert after.max() <= before.max() - 150


def test_packing_ends_when_no_exchange_gains():
    """Brute force: no move, one-for-one or two-for-one exchange between open bins raises the sum of squared fills."""
    lengths = np.random.default_rng(1).integers(20, 60, 60)
    bins = packing.Bins(100)
    bins.best_fit(lengths, np.argsort(-lengths, kind="stable"))
    bins.improve(lengths)
    used = [b for b in range(len(bins.fill)) if bins.fill[b]]
    if len(used) > bins.least(lengths):
        for b, c in itertools.permutations([b for b in used if bins.fill[b] < 100], 2):
            for i in bins.content[b]:
                for k in range(3):
                    for back in itertools.combinations(bins.content[c], k):
                        gain = int(lengths[i]) - int(lengths[list(back)].sum())
                        assert not (0 < gain <= 100 - bins.fill[c] and bins.fill[c] - bins.fill[b] + gain > 0)


def test_windows_of_a_hot_anchor_are_dealt_out(spark, monkeypatch):
    """A phrase that all documents share in contexts of their own: its windows go by digest, no task sorts them all."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    phrase, texts = letters(45), []
    for _ in range(150):
        texts.append(letters(20) + phrase + letters(20) if rng.random() < 0.7 or not texts else letters(9) + rng.choice(texts)[rng.randrange(25) :])
    dealt = []

    def spy(contents):
        dealt.append(contents.agg(F.sum(F.octet_length("content"))).first()[0])
        return real(contents)

    real = suffix_dedup.window_verdicts
    monkeypatch.setattr(suffix_dedup, "window_verdicts", spy)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(df, shard_bytes=1000).collect()}
    assert dealt[0] > 3000
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
    for i, t in enumerate(texts):
        gone = {p for k in range(len(t) - 49) if seen[t[k : k + 50]] < i for p in range(k, k + 50)}
        assert rows[i] == "".join(c for p, c in enumerate(t) if p not in gone)
    assert any(rows[i] != t for i, t in enumerate(texts))


def test_pairs_at_the_threshold_meet_beside_a_huge_group(spark):
    """What a group of near copies finds easily must not end the descent before the least similar pairs meet."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(1500):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    for _ in range(150):  # two changed words far apart: 10 of 106 shingles, a similarity of about 0.83
        one = [word() for _ in range(110)]
        two = list(one)
        two[rng.randrange(10, 50)], two[rng.randrange(60, 100)] = word(), word()
        texts += [" ".join(one), " ".join(two)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    assert {rows[i].class_id for i in range(1500)} == {0}
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    for i in range(0, 1500, 300):
        assert rows[i].n_links == sum(alike(i, j) for j in range(1500) if texts[j] != texts[i])
    wanted = [i for i in range(1500, len(texts), 2) if alike(i, i + 1)]
    assert len(wanted) > 100
    found = sum(rows[i].class_id == rows[i + 1].class_id == i for i in wanted)
    assert found >= 0.99 * len(wanted)


def test_members_of_a_hot_trie_node_make_a_row_each(spark, monkeypatch):
    """Star rows are linear in the members, also where slices and blocks are smaller than the group."""
    monkeypatch.setattr(ngram_join, "shuffle_partitions", lambda spark: 50)
    forest = ngram_join.Forest(block=8)
    n, labels = 200, [1] * 128
    far = [1] * 8 + list(range(2, 122))
    rows = [(i, labels if i < 150 else [x + 300 * (k >= 8) for k, x in enumerate(far)]) for i in range(n)]
    leaders = spark.createDataFrame(rows, "node long, labels array<int>").repartition(3)
    empty = spark.createDataFrame([], "node long, component long")
    codes = F.unhex(F.array_join(F.transform("labels", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")), ""))
    coded = leaders.select(F.col("node").alias("code_node"), codes.alias("codes"))
    entries = ngram_join.trie_level(leaders, empty, 8, forest)
    heads = ngram_join.open_buckets(entries)
    stars = ngram_join.star_pairs(entries, heads, coded, forest)
    assert stars.count() == heads.agg(F.sum(F.col("n") - 1)).first()[0]
    edges = stars.where("near").select("head", "node").collect() + ngram_join.rest_edges(stars, coded, forest).collect()
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    assert set(label[:150]) == {0} and set(label[150:]) == {150}


def test_prefixes_end_where_the_least_similarity_asks_whatever_pairs_there_are(spark, monkeypatch):
    """Pairs of 0.844 alone meet at five labels; texts of 0.8 elsewhere would not."""
    texts = []
    for i in range(150):
        words = [f"p{i}w{k}" for k in range(300)]
        texts += [words, words[:100] + [f"p{i}v{k}" for k in range(21)] + words[121:]]
    seen, real = [], ngram_join.trie_level
    monkeypatch.setattr(ngram_join, "trie_level", lambda leaders, placed, prefix, forest: seen.append(prefix) or real(leaders, placed, prefix, forest))
    df = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    assert seen == [8, 7, 6, 5, 4]
    assert all(rows[i].class_id == i - i % 2 and rows[i].n_links == 1 for i in rows)


def test_codes_meet_a_node_once_however_many_trie_nodes_hold_it(spark):
    rows = spark.createDataFrame([(bucket, node) for bucket in range(16) for node in range(40)], "bucket long, node long")
    coded = spark.createDataFrame([(node, bytes([node])) for node in range(40)], "code_node long, codes binary")
    got = ngram_join.by_node(rows, coded).collect()
    assert sorted((r.node, r.codes, sorted(x.bucket for x in r.held)) for r in got) == [(k, bytes([k]), list(range(16))) for k in range(40)]


def test_memory_for_anchors_follows_the_part_and_not_the_arrow_batch(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1 << 20, raising=False)
    held = []
    suffix_dedup.anchors(SimpleNamespace(mapInArrow=lambda run, schema: held.append(run)), 8)

    def peak(n):
        texts = [random.Random(k).randbytes(2000).hex() for k in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], names=["doc_id", "text"])
        tracemalloc.start()
        found = sum(part.num_rows for part in held[0](iter([batch])))
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert found
        return most

    assert peak(2000) < 1.3 * peak(500) and peak(2000) < 64 << 20


def test_a_shard_is_induced_once_and_without_contents_alone_under_their_anchor(monkeypatch):
    draw, induced_, sorted_ = random.Random(8), [], []
    letters = lambda n: bytes(draw.choice(b"abcdefgh ") for _ in range(n))
    contents, anchor = [], []
    for k in range(300):  # a third of the anchors have two or three contents that share windows
        whole = letters(80)
        for copy in range(k % 3 and 1 or 2 + k % 2):
            contents.append(whole[copy * 6 : 75 + copy])
            anchor.append(k)
    first, n = np.arange(len(contents))[::-1].copy(), np.full(len(contents), 2)
    real, both = induced.induce, suffix_dedup.first_documents
    monkeypatch.setattr(induced, "induce", lambda symbols, *rest: induced_.append(len(symbols)) or real(symbols, *rest))
    monkeypatch.setattr(suffix_dedup, "first_documents", lambda texts, *rest: sorted_.append(len(texts)) or both(texts, *rest))
    found = suffix_dedup.shard_verdicts(np.array(anchor), contents, first, n)
    assert sorted_ == [sum(anchor.count(k) > 1 for k in anchor)] and len(induced_) == 2
    earliest = {}
    for text, doc in zip(contents, first.tolist()):
        for at in range(len(text) - 49):
            earliest[text[at : at + 50]] = min(doc, earliest.get(text[at : at + 50], doc))
    got = {(k, at): least for k, a, b, least in found for at in range(a, b + 1)}
    assert got == {(k, at): earliest[text[at : at + 50]] for k, text in enumerate(contents) for at in range(len(text) - 49)}


@pytest.mark.parametrize("rounds", [0, 1, 32])
def test_suffixes_that_tie_for_long_are_sorted_by_their_substrings(monkeypatch, rounds):
    monkeypatch.setattr(induced, "ROUNDS", rounds)
    draw = np.random.default_rng(3)
    for k in range(60):
        text = np.tile(draw.integers(1, 4, draw.integers(1, 9)), 40) * (40_000 if k % 3 == 0 else 1)
        whole = [*text.tolist(), 0]
        for memory_items in (1 << 20, 7):
            order, classes = induced.sorted_windows(text, 50, memory_items)
            assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
            same = [whole[a : a + 50] == whole[b : b + 50] for a, b in zip(order, order[1:])]
            assert (np.diff(classes) == 0).tolist() == same


def test_shorter_prefixes_start_from_the_same_components_and_are_one_job(spark, monkeypatch):
    seen, real = [], ngram_join.star_pairs
    monkeypatch.setattr(ngram_join, "star_pairs", lambda *given: seen.append(1) or real(*given))
    rng = random.Random(3)
    bases = [[f"b{i}w{k}" for k in range(120)] for i in range(3)]
    texts = [" ".join(f"z{rng.randrange(9)}" if rng.random() < 0.01 else w for w in bases[k % 3]) for k in range(60)]
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(seen) == 2
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    for i, row in rows.items():
        assert row.n_links == len({texts[j] for j in rows if texts[j] != texts[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])})


def test_components_write_each_round_once_and_stop_at_stars(spark, monkeypatch):
    written, real = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or real(df, name))
    stars = [(k % 3, 10 + k) for k in range(60)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 7: 7, **{b: a for a, b in stars}}
    assert written == ["edges", "components"]
    written.clear()
    cross = [(a, 100 + (a + s) % 40) for a in range(40) for s in (0, 1)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(cross, "a long, b long")).collect()}
    assert len(found) == 80 and set(found.values()) == {0}
    assert len(written) <= 2 + 7
