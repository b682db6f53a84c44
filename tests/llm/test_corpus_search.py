"""Phrase mining, SimHash linking and ranked search: against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prefspark.llm import phrases, search, simhash
from prefspark.llm.common import documents
from prefspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that these operators use inside or return.
CLASHES = (
    "fp row low_id component component_id fingerprint table key point a b node m "
    "slice words counts ids word f gid n phrase grams before singles score rank "
    "kind doc_ids lengths steps bits term df item wanted place part item_id"
).split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in CLASHES})


# --- phrases -----------------------------------------------------------------


def mined(rows, shape):
    """Brute force over (text, lang) rows."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for size in range(1, shape.longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][words[i : i + size]] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= shape.least}
        ranked = []
        for p, a in candidates.items():
            inside = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(candidates[q] >= a for q in inside):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[: shape.top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["É", "A|", "x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["red green blue", "new york city hall", "a|\tx", "w1 w2 w3 w4 w5 w6 w7"]
    rows = []
    for i in range(250):
        text = []
        for _ in range(draw.randint(0, 40)):
            text.append(draw.choice(fixed) if draw.random() < 0.1 else draw.choices(words, weights)[0])
            text.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]))
        rows.append(("".join(text), draw.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", "en"), (None, None), (". , ;", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize(
    "shape",
    [
        phrases.Mining(least=5, top=40),
        phrases.Mining(least=5, top=10, first_words=4, growth=8, block=20, shares=9),
        phrases.Mining(least=4, top=7, longest=3),
    ],
)
def test_phrases_equal_brute_force(spark, prose, shape):
    df = odd_rows(spark, [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(prose)]).repartition(5)
    assert sorted(map(tuple, phrases.collocations(df, shape).collect())) == mined(prose, shape)


def test_phrases_do_not_depend_on_slices(spark, prose, monkeypatch):
    """Texts far longer than a slice are cut where pieces end."""
    monkeypatch.setattr(phrases.tokenized, "__defaults__", (64,))
    df = odd_rows(spark, [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(prose)])
    shape = phrases.Mining(least=5, top=40)
    assert sorted(map(tuple, phrases.collocations(df, shape).collect())) == mined(prose, shape)


def test_growth_stops_at_the_bound(spark, monkeypatch):
    """Frequent first words are not expanded once the wanted phrases score higher than any of theirs."""
    asked, pairs = [], phrases._pairs
    monkeypatch.setattr(phrases, "_pairs", lambda slices, ranges, *share: asked.append(ranges) or pairs(slices, ranges, *share))
    rare = " . ".join(f"rare{i} pair{i}" for i in range(10))
    rows = [(i, f"{rare} . the of . the of . the of . the and . the of", "en", "s", 0) for i in range(20)]
    found = phrases.collocations(odd_rows(spark, rows), phrases.Mining(least=10, top=10, first_words=10)).collect()
    assert {r.phrase for r in found} == {f"rare{i} pair{i}" for i in range(10)}
    assert {r["en"] for r in asked} == {(20, 80)}


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_words_of_slices_are_shuffled_once(spark, prose, broadcast):
    """Counting words and placing them in slices take one shuffle of all words, also where frequent ones are too many to broadcast."""
    texts = odd_rows(spark, [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(prose)]).selectExpr("coalesce(lang, 'und') AS lang", "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        slices = phrases.stored(phrases.tokenized(texts, 256), "slices")
        found = phrases.frequent_words(slices, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        places = phrases.stored(found, "places")
        rows, counted = places.collect(), Counter()
        listed = {r.slice: (r.lang, r.words, r.counts) for r in slices.collect()}
        for lang, words, counts in listed.values():
            for word, n in zip(words, counts):
                counted[lang, word] += n
        assert {(r.lang, r.word): r.f for r in rows} == {k: n for k, n in counted.items() if n >= 5}
        assert len({(r.lang, r.word, r.gid) for r in rows}) == len({r.gid for r in rows}) == sum(r.id == r.gid for r in rows) == len({(r.lang, r.word) for r in rows})
        assert all(listed[r.slice][1][r.at] == r.word for r in rows)
        assert len(rows) == sum(counted[lang, word] >= 5 for lang, words, _ in listed.values() for word in words)
        assert plan.count("Exchange hashpartitioning") == 1
        assert phrases.coded(slices, places)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_phrases_of_nothing(spark):
    empty = odd_rows(spark, [])
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(odd_rows(spark, [(1, None, None, None, None)])).count() == 0
    assert phrases.collocations(odd_rows(spark, [(1, "one two", "en", None, None)])).columns == "lang rank phrase a l r n score".split()


# --- SimHash -----------------------------------------------------------------


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, links):
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for x in fps:
        out[find(x)].add(x)
    return {frozenset(g) for g in out.values()}


def all_links(fps, radius):
    every = np.array(sorted(fps), np.uint64)
    for i, x in enumerate(every[:-1]):
        for j in np.flatnonzero(np.bitwise_count(every[i + 1 :] ^ x) <= radius):
            yield int(x), int(every[i + 1 + j])


def test_masks_cover_every_set_of_bits():
    draw = random.Random(0)
    for radius in (2, 4):
        masks = simhash.Covering(radius=radius).masks()
        assert len(masks) == 2 ** (radius + 1) - 1 and all(20 < m.bit_count() < 45 for m in masks)
        for _ in range(3000):
            differing = sum(1 << b for b in draw.sample(range(64), radius))
            assert any(m & differing == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_equal_all_pairs(spark, bucket):
    """Clusters around the radius, dense balls and lone points; with and without buckets that are too large."""
    draw, fps = random.Random(5), {0, 1, 2**63, 2**64 - 1}
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 25])):
            x = centre
            for bit in draw.sample(range(64), draw.randint(0, 6)):
                x ^= 1 << bit
            fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long").repartition(5)
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, simhash.Covering(bucket=bucket)).collect()]
    assert all((a ^ b).bit_count() <= 20 for a, b in found)
    assert groups(fps, found) == groups(fps, all_links(fps, 4))


def test_simhash_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark, SMALL).collect()}
    rows = QUERIES["op12_simhash"](spark, SMALL).collect()
    prints = {i: reference_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints and len(rows) == len(texts)
    fps = set(prints.values())
    least = {x: min(i for i, p in prints.items() if p in g) for g in groups(fps, all_links(fps, 4)) for x in g}
    assert all(r.component_id == least[prints[r.doc_id]] for r in rows)


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    base = " ".join(f"v{i}" for i in range(400))
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "one two"), (8, "ONE two"), (7, long), (None, base), (None, "lonely words here"), (6, base), (6, "shared id, other text"), (6, base)]
    df = odd_rows(spark, [(i, t, "en", "s", 0) for i, t in rows])
    for shape in (simhash.Covering(), simhash.Covering(heavy=1)):
        found = simhash.simhash_components(df, shape).collect()
        assert len(found) == len(rows)
        by_print = defaultdict(set)
        for r in found:
            by_print[r.fingerprint].add((r.doc_id, r.component_id))
        assert by_print["0" * 16] == {(5, 3), (3, 3), (4, 3)}
        assert by_print[f"{reference_fingerprint('one two'):016x}"] == {(9, 8), (8, 8)}
        assert by_print[f"{reference_fingerprint(long):016x}"] == {(7, 7)}
        assert by_print[f"{reference_fingerprint(base):016x}"] == {(None, 6), (6, 6)}
        assert by_print[f"{reference_fingerprint('lonely words here'):016x}"] == {(None, None)}
        assert by_print[f"{reference_fingerprint('shared id, other text'):016x}"] == {(6, 6)}
    assert simhash.simhash_components(odd_rows(spark, [])).count() == 0


# --- search ------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def ranked(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            if c:
                m = 75 + 25 * c.total() * n_docs // n_terms
                weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score = sum(weight(t) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
                if score > 0:
                    scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scored[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


@pytest.fixture(scope="module")
def library():
    draw = random.Random(11)
    words = [f"term{i}" for i in range(400)] + ["Été", "日本", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, draw.choice(" ,.-").join(draw.choices(words, weights, k=draw.choice([0, 1, 5, 30, 200])))) for i in range(400)]
    docs += [(900, None), (901, "?! "), (902, ""), (None, docs[5][1] + " term7 term8"), (None, "term9 term9"), (7, docs[3][1]), (7, docs[3][1])]
    docs.append((903, " ".join(draw.choices(words, weights, k=60_000))))
    docs += [(i, docs[17][1]) for i in range(1000, 1060)]
    items = [(i, " ".join(draw.choices(words, weights, k=draw.choice([1, 3, 25])))) for i in range(40)]
    items += [(50, None), (51, "... "), (52, "nowhere to be found"), (53, docs[17][1]), (None, "term7 term7"), (3, "term8 x9")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, library, monkeypatch, small):
    if small:
        monkeypatch.setattr(search, "QUERY_ITEMS", 7)
        monkeypatch.setattr(search, "BLOCK_DOCS", 16)
        monkeypatch.setattr(search, "CHUNK", 5)
    docs, items = library
    df = odd_rows(spark, [(i, t, "en", "s", 0) for i, t in docs]).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    for k in (20, 3):
        found = search.search(search.build_index(df), df, asked, k).collect()
        assert sorted(map(tuple, found), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3])) == ranked(docs, items, k)


def test_bounds_hold_and_exclude(library):
    """No bound is below its score, and most documents are provably out of a rare query's result."""
    docs, _ = library
    import pyarrow as pa

    *blocks, (names, df) = search._blocks([t for _, t in docs], pa.array([i for i, _ in docs], pa.int64()))
    n_docs, n_terms = sum(len(b[0]) for b in blocks), sum(int(b[1].sum()) for b in blocks)
    counts = [Counter(["term300", "term200", "term200"]), Counter(["term0", "term5"])]
    queries = search.Queries.of([0, 1], counts, dict(zip(names.to_pylist(), df.tolist())), n_docs, n_terms)
    hashes, texts = search.term_hashes(queries.terms), defaultdict(list)
    for i, t in docs:
        texts[i].append(Counter(terms_of(t)))
    possible = 0
    for ids, lengths, steps, bits in blocks:
        bounds = queries.bounds(hashes, lengths, steps, bits)
        possible += int((bounds[0] > 0).sum())
        for column, (doc, n) in enumerate(zip(ids.to_pylist(), lengths)):
            held = next(c for c in texts[doc] if c.total() == n)
            m = int(queries.spread([n])[0])
            for row, asked in enumerate(counts):
                score = sum(x * int(queries.weights[queries.terms.index(t)]) * (10**9 * held[t] // (1000 * held[t] + 12 * m)) for t, x in asked.items())
                assert bounds[row, column] >= score
    assert possible < 0.2 * n_docs


def test_search_of_nothing(spark):
    empty = odd_rows(spark, [])
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(search.build_index(empty), empty, asked).count() == 0
    some = odd_rows(spark, [(1, "a b", "en", "s", 0)])
    assert search.search(search.build_index(some), some, asked.where("item_id > 1")).count() == 0
    assert [tuple(r) for r in search.search(search.build_index(some), some, asked).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
