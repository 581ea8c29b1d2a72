"""Operators 1, 3, 7, 8 and 9 against brute-force versions on small fixtures."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from risklib.llm import bagminhash, bpe_count, bytehash, crf_language, lpf_dedup, simhash_decontam
from tests.llm import fixtures as fx

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def spec():
    return bpe_count.read_merges(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sabcdefgh<|endoftext|>19é 　\x1c")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_equal_the_library(spec, library, text):
    assert bpe_count.counter(spec, P.PATTERN)(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_of_awkward_rows(spark, library):
    docs = fx.awkward(spark)
    out = bpe_count.token_counts(fx.with_clashes(docs), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    texts = [r["text"] or "" for r in docs.collect()]
    want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in out)
    assert bpe_count.token_counts(fx.empty(spark), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def plain_posteriors(emit, trans, lengths):
    out, at = [], 0
    k = emit.shape[1]
    for n in lengths:
        e = np.exp(emit[at:at + n])
        m = np.exp(trans)
        a, b = np.zeros((n, k)), np.ones((n, k))
        v = np.full(k, 1 / k)
        for i in range(n):
            v = (v @ m) * e[i]
            a[i] = v = v / v.sum()
        for i in range(n - 2, -1, -1):
            v = m @ (e[i + 1] * b[i + 1])
            b[i] = v / v.sum()
        p = a * b
        out.append(p / p.sum(axis=1, keepdims=True))
        at += n
    return np.concatenate(out)


def test_blocked_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(1)
    for lengths in ([1], [3, 1, 70], [32, 33, 64, 200, 5]):
        emit, trans = rng.normal(size=(sum(lengths), 4)), rng.normal(size=(4, 4))
        assert np.allclose(crf_language.posteriors(emit, trans, np.array(lengths)), plain_posteriors(emit, trans, lengths))


def test_pair_posteriors_equal_enumeration():
    rng = np.random.default_rng(5)
    for n, k in ((2, 2), (6, 3), (7, 2)):
        emit, trans = rng.normal(size=(n, k)), rng.normal(size=(k, k)) * 2
        want, total = np.zeros((n - 1, k, k)), 0.0
        for path in itertools.product(range(k), repeat=n):
            p = np.exp(sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))) * np.exp(trans[:, path[0]]).sum()
            total += p
            for i in range(1, n):
                want[i - 1, path[i - 1], path[i]] += p
        lengths = np.array([n, 3])
        both = np.concatenate([emit, rng.normal(size=(3, k))])
        forward, backward = crf_language.forward_backward(both, trans, lengths)
        assert np.allclose(crf_language.pair_posteriors(both, trans, forward, backward, np.arange(1, n)), want / total)


def test_every_character_of_a_word_counts(spark):
    """Texts without spaces, also with a beginning in another language."""
    model = crf_language.fit(fx.documents(spark, 240))
    rng = random.Random(31)
    glued = [fx.prose(rng, "de", 40).replace(" ", "").replace("\n", "") for _ in range(30)]
    langs, _ = crf_language.predict(glued + ["thestonehouses" + g for g in glued], model)
    assert langs.count("de") >= 58
    start, buckets = crf_language.word_features(["abcdefghij" * 50], {})
    assert len(buckets) == 6 + 499 + 498 + 1 and start.tolist() == [0, len(buckets)]


def test_any_number_of_language_names(spark):
    docs = fx.documents(spark, 90)
    rare = spark.createDataFrame([(1000 + i, "zzz qqq xxx", f"rare{i}", "s", 1) for i in range(crf_language.MAX_LANGS + 40)], fx.SCHEMA)
    model = crf_language.fit(docs.union(rare))
    assert len(model["langs"]) <= crf_language.MAX_LANGS and {"en", "de", "fr"} <= set(model["langs"])


def test_languages_are_found_and_mixed_texts_score_lower(spark):
    docs = fx.documents(spark, 120)
    out = {r["doc_id"]: r for r in crf_language.identify(docs).collect()}
    held = [r for r in out.values() if r["held_out"]]
    assert held and all(r["lang_pred"] == ["en", "de", "fr"][r["doc_id"] % 3] for r in held)
    model = crf_language.fit(docs)
    rng = random.Random(3)
    one, two = fx.prose(rng, "en", 60), fx.prose(rng, "de", 60)
    langs, scores = crf_language.predict([one, one + " " + two], model)
    assert langs[0] == "en" and scores[0] > 0.9 > scores[1]
    words, _, _, post = crf_language.label_words([one + " " + two], model)
    labels = [model["langs"][i] for i in post.argmax(axis=1)]
    assert sum(x == y for x, y in zip(labels, ["en"] * 60 + ["de"] * 60)) > 112


def test_language_edges(spark):
    docs = fx.awkward(spark)
    out = crf_language.identify(fx.with_clashes(docs)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by[1] == by[2] == by[3] == by[7] == "und"
    assert crf_language.identify(fx.empty(spark)).count() == 0
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in crf_language.identify(blank).collect()} == {"und"}
    assert crf_language.keep_identified(docs).columns == docs.columns


def shingle_bag(t):
    w = [x for x in bytes(t, "utf-8").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ")]
    w = [y for x in w for y in x.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").split(b" ") if y]
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def weighted(a, b):
    x, y = shingle_bag(a), shingle_bag(b)
    high = sum((x | y).values())
    return sum((x & y).values()) / high if high else 0.0


def near_copies(rng, n_groups=6, size=9):
    rows, i = [], 500
    for _ in range(n_groups):
        words = fx.prose(rng, "en", 120).split()
        for _ in range(size):
            rows.append((i, " ".join(words), "en", "s", 1))
            i += 1
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 9999)}"
    return rows


def brute_classes(rows):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    real = [(d, t) for d, t in rows if d is not None and t is not None]
    for (a, x), (b, y) in itertools.combinations(real, 2):
        if x == y or weighted(x, y) >= 0.8:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d, _ in real}


def test_near_duplicate_classes_match_brute_force(spark):
    docs = fx.documents(spark, 30, extra=near_copies(random.Random(4))).union(fx.awkward(spark))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = bagminhash.classes(fx.with_clashes(docs)).collect()
    assert len(out) == len(rows)
    want = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None} == {d: want.get(d, d) for d, _ in rows if d is not None}
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    check_kept(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])
    assert bagminhash.classes(fx.empty(spark)).count() == 0 and bagminhash.keep_one(fx.empty(spark)).count() == 0


def check_kept(rows, kept):
    """One row of every class of texts is kept, with the class's smallest doc_id, and every row without doc_id or text."""
    whole = lambda r: r[0] is not None and r[1] is not None
    assert sorted(map(str, (r for r in kept if not whole(r)))) == sorted(map(str, (r for r in rows if not whole(r))))
    texts = sorted({t for d, t in rows if d is not None and t is not None})
    of = brute_classes(list(enumerate(texts)))
    names = {t: of[i] for i, t in enumerate(texts)}
    least = {}
    for d, t in filter(whole, rows):
        least[names[t]] = min(d, least.get(names[t], d))
    assert sorted((names[t], d) for d, t in filter(whole, kept)) == sorted(least.items())


def test_no_text_is_lost_where_a_doc_id_has_several(spark):
    """The review's rows: unrelated texts under one doc_id, whose copies stand under others."""
    rng = random.Random(21)
    a, u, v = (fx.prose(rng, lang, 90) for lang in ("en", "de", "fr"))
    rows = [(3, a), (5, a), (5, u), (8, v), (8, u + " noch"), (9, v + " encore"), (9, v + " encore"), (8, v), (12, fx.prose(rng, "en", 60)),
            (12, fx.prose(rng, "de", 60)), (None, a), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], fx.SCHEMA)
    kept = bagminhash.keep_one(fx.with_clashes(docs))
    assert kept.columns == fx.with_clashes(docs).columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    check_kept(rows, got)
    assert sorted(d for d, t in got if d is not None and t is not None) == [3, 5, 8, 12, 12]


def test_jobs_end_with_the_open_buckets(spark):
    """Texts without a duplicate cost no rounds of pivots."""
    docs = fx.documents(spark, 40, seed=77)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("alone", "texts without duplicates")
    try:
        assert bagminhash.classes(docs).filter("class_id <> doc_id").count() == 0
        jobs = len(tracker.getJobIdsForGroup("alone"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 20


def test_a_doc_id_with_two_texts_keeps_the_links_of_each(spark):
    rng = random.Random(14)
    a, b = fx.prose(rng, "en", 80).split(), fx.prose(rng, "de", 400).split()
    near_a, near_b = [*a[:-2], "other", "end"], [*b[:-2], "anderes", "ende"]
    rows = [(5, a), (5, b), (7, near_a), (3, near_a[1:]), (9, near_b), (11, fx.prose(rng, "fr", 80).split())]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows], fx.SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()}
    assert got == {5: 3, 7: 3, 3: 3, 9: 5, 11: 11}


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(6)
    a = {i: rng.choice([1, 1, 2, 5, 17]) for i in range(300)}
    b = {i: (w if rng.random() < 0.7 else rng.choice([1, 3, 9])) for i, w in a.items() if rng.random() < 0.9}
    true = sum(min(w, b.get(i, 0)) for i, w in a.items()) / sum(max(a.get(i, 0), b.get(i, 0)) for i in a)
    hashes = bytehash.mix(np.arange(1, 301, dtype=np.uint64))
    text = np.array([0] * len(a) + [1] * len(b))
    sh = np.concatenate([hashes[list(a)], hashes[list(b)]])
    h = bagminhash.signatures(text, sh, np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((h[0] == h[1]).mean() - true) < 0.03


def test_sketches_never_rule_out_a_link():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    for n in (3, 40, 200, 3000):
        a = [rng.choice(words) for _ in range(n)]
        for p in (0.0, 0.01, 0.1, 0.5, 1.0):
            b = [rng.choice(words) if rng.random() < p else w for w in a]
            pair = [" ".join(a), " ".join(b)]
            text, shingle, weight = bagminhash.bag(*bytehash.words_of([t.encode() for t in pair]))
            bits = bagminhash.sketches(text, shingle, 2)
            differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            total = int(weight.sum())
            assert bagminhash.jaccard(*pair) <= (total - differ) / (total + differ) + 1e-12
    none = bagminhash.sketches(np.zeros(0, np.int64), np.zeros(0, np.uint64), 2)
    assert none.shape == (2, bagminhash.SKETCH_WORDS) and not none.any()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, j) for j in range(101, 130)] + [(205, 203), (203, 201)]
    out = {r["node"]: r["root"] for r in bagminhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(1, 21)) and all(out[j] == 100 for j in range(101, 130)) and out[205] == out[203] == 201


BENCH = "item_id long, text string"


def test_decontamination_finds_planted_items_and_leaves_others(spark):
    rng = random.Random(8)
    items = [(i, fx.prose(rng, "fr", rng.randint(6, 150)).replace("e", f"e{i}")) for i in range(25)] + [(90, None), (91, ""), (92, "two words")]
    bench = spark.createDataFrame(items, BENCH)
    rows = []
    for i in range(25):
        host = fx.prose(rng, "en", 80).split()
        at = rng.randrange(80)
        words = items[i][1].split()
        if i % 3 == 1 and len(words) > 30:
            words[0] = "changed"
        if i % 3 == 2 and len(words) > 30:
            words = words[:-2]
        rows.append((1000 + i, " ".join(host[:at] + words + host[at:]).upper(), "en", "s", 1))
    docs = fx.documents(spark, 30, extra=rows).union(fx.awkward(spark))
    out = simhash_decontam.matches(fx.with_clashes(docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1000 + i, i) for i in range(25)}
    assert all(0.8 <= r["similarity"] <= 1 + 1e-9 for r in out)
    kept = simhash_decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 25
    none = spark.createDataFrame([], BENCH)
    assert simhash_decontam.matches(docs, none).count() == 0 and simhash_decontam.keep_clean(docs, none).count() == docs.count()
    assert simhash_decontam.matches(fx.empty(spark), bench).count() == 0


def test_an_item_without_an_id_counts(spark):
    rng = random.Random(17)
    text = fx.prose(rng, "fr", 50)
    bench = spark.createDataFrame([(None, text), (None, None), (4, fx.prose(rng, "de", 40))], BENCH)
    docs = spark.createDataFrame([(1, text, "fr", "s", 1), (2, fx.prose(rng, "en", 50), "en", "s", 1)], fx.SCHEMA)
    assert [(r["doc_id"], r["item_id"]) for r in simhash_decontam.matches(docs, bench).collect()] == [(1, None)]
    assert [r["doc_id"] for r in simhash_decontam.keep_clean(docs, bench).collect()] == [2]


def test_windows_near_shared_shingles_are_all_windows(monkeypatch):
    """Looking only near shared shingles changes nothing, and nothing found is missing from all places of all items."""
    rng = random.Random(23)
    items = [(i, fx.prose(rng, "fr", rng.randint(5, 130)).replace("e", f"e{i}")) for i in range(25)] + [(90, "two words"), (91, "one"), (92, "a b c d")]
    texts = ["", "one", "two words"]
    for _ in range(120):
        host, words = fx.prose(rng, "en", rng.randint(0, 150)).split(), items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randint(0, len(words) // 12)):
            words[rng.randrange(len(words))] = "changed"
        at = rng.randint(0, len(host))
        texts.append(" ".join(host[:at] + words + host[at:]))
    index = simhash_decontam.build_items(items)
    near = simhash_decontam.scan_texts(texts, index)
    two = [simhash_decontam.build_items(items[:10], index["weights"]), simhash_decontam.build_items(items[10:], index["weights"])]
    # block by block the window sizes differ, and with them which of several equal places is met
    assert {(d, i): s for d, i, _, _, s in simhash_decontam.scan_texts(texts, two)} == {(d, i): s for d, i, _, _, s in near}
    monkeypatch.setattr(simhash_decontam, "near_shared", lambda words, *rest: np.arange(len(words)))
    assert simhash_decontam.scan_texts(texts, index) == near
    best = {}
    for d, t in enumerate(texts):
        words, counts = bytehash.words_of([t.lower().encode()])
        for i in range(len(items)):
            n = min(int(index["lengths"][i]), len(words))
            for at in range(len(words) - n + 1 if n else 0):
                sh, _ = bytehash.shingles_of(words[at:at + n], np.array([n]))
                s = simhash_decontam.similarity(np.unique(sh, return_counts=True), index["bags"][i], index["weights"])
                if s >= simhash_decontam.MIN_SIMILARITY and s > best.get((d, i), 0.0):
                    best[d, i] = s
    found = {(d, i): s for d, i, _, _, s in near}
    assert set(found) <= set(best) and all(s <= best[p] + 1e-12 for p, s in found.items())
    assert len(set(best) - set(found)) <= 0.01 * len(best)


def damaged(rng, words, how, similarity=0.8):
    """A copy with so many words replaced that at least ``similarity`` of the shingles' weighted Jaccard is left."""
    n = len(words)
    budget = int((n - 4) * (1 - similarity) / (1 + similarity))
    out = list(words)
    if how == "ends":
        at = [*range(budget // 2), *range(n - (budget - budget // 2), n)]
    elif how == "scattered":
        at = rng.sample(range(n), budget // 5)
    else:
        first = rng.randrange(n - budget) if budget > 4 else n
        at = range(first, first + budget - 4)
    for i in at:
        out[i] = f"new{rng.randrange(10 ** 9)}"
    return out


def recall(n, how, copies, seed=1):
    """Share of the damaged copies of items of ``n`` words that are found inside other words."""
    rng = random.Random(seed)
    items = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))) for i in range(copies)]
    texts = [" ".join([*(f"h{rng.randrange(10 ** 6)}" for _ in range(40)), *damaged(rng, t.split(), how),
                       *(f"h{rng.randrange(10 ** 6)}" for _ in range(40))]) for _, t in items]
    found = {(d, i) for d, i, *_ in simhash_decontam.scan_texts(texts, simhash_decontam.build_items(items))}
    return len(found & {(i, i) for i in range(copies)}) / copies


@pytest.mark.parametrize("n", [15, 30, 59, 120, 180, 300, 600])
@pytest.mark.parametrize("how", ["ends", "scattered", "block"])
def test_damaged_copies_of_any_length_are_found(n, how):
    assert recall(n, how, 40) >= 0.95


def test_copies_without_the_first_word_are_found():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(13 + i % 40))) for i in range(200)]
    texts = [t.split(" ", 1)[1] + " end" for _, t in items]
    found = simhash_decontam.scan_texts(texts, simhash_decontam.build_items(items))
    assert {(d, i) for d, i, *_ in found} == {(i, i) for i in range(200)}


def test_item_blocks_give_the_same_matches(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, fx.prose(rng, "de", 30)) for i in range(7)]
    docs = spark.createDataFrame([(i, "start " + t + " end", "de", "s", 1) for i, t in items], fx.SCHEMA)
    bench = spark.createDataFrame(items, BENCH)
    monkeypatch.setattr(simhash_decontam, "ITEM_BLOCK", 2)
    assert {(r["doc_id"], r["item_id"]) for r in simhash_decontam.matches(docs, bench).collect()} == {(i, i) for i in range(7)}


def test_the_verdict_does_not_depend_on_the_items_block(spark, monkeypatch):
    rng = random.Random(4)
    preamble = " ".join(f"p{i}" for i in range(100))
    items = [(i, preamble + " " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(6))) for i in range(40)]
    bench = spark.createDataFrame(items, BENCH)
    docs = spark.createDataFrame([(1, preamble, "en", "s", 1), (2, items[7][1], "en", "s", 1)], fx.SCHEMA)
    found = []
    for size in (4096, 3, 1):
        monkeypatch.setattr(simhash_decontam, "ITEM_BLOCK", size)
        found.append(sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in simhash_decontam.matches(docs, bench).collect()))
    assert found[0] == found[1] == found[2] == [(2, 7, 1.0)]


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    windows = []
    for p in prints:
        bits = rng.choice(64, simhash_decontam.RADIUS, replace=False)
        windows.append(p ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)))
    w, e = simhash_decontam.near_prints(np.array(windows, np.uint64), prints, simhash_decontam.block_index(prints))
    assert {(i, i) for i in range(50)} <= set(zip(w.tolist(), e.tolist()))


def test_window_hashes_equal_bit_counts():
    words = np.random.default_rng(3).integers(0, 1 << 63, 400, dtype=np.uint64)
    for size in (1, 2, 5, 31, 120):
        got = simhash_decontam.window_hashes(simhash_decontam.prefix(words), size)
        bits = ((words[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
        for i in (0, 7, 400 - size):
            want = sum(1 << b for b in range(64) if bits[i:i + size, b].sum() > size // 2)
            assert int(got[i]) == want


def brute_bytes(rows, length, keep):
    order = sorted(range(len(rows)), key=lambda i: i)
    places = collections.defaultdict(list)
    for i in order:
        b = (rows[i][1] or "").encode()
        for s in range(len(b) - length + 1):
            places[b[s:s + length]].append((i, s))
    out = []
    for i, (d, t) in enumerate(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            p = places[b[s:s + length]]
            if len(p) > 1 and (keep == "none" or p[0] != (i, s)):
                hit[s:s + length] = b"\x01" * length
        spans = sum(1 for j in range(len(b)) if hit[j] and not (j and hit[j - 1]))
        out.append((d, len(b), sum(hit), spans, bytes(x for x, h in zip(b, hit) if not h)))
    return sorted(out, key=repr)


def repeats(rng):
    passage = fx.prose(rng, "de", 70)
    rows = []
    for i in range(30):
        words = fx.prose(rng, "en", rng.randint(5, 60))
        body = passage[rng.randint(0, 40):len(passage) - rng.randint(0, 40)] if i % 2 else ""
        rows.append((i + 600, words + body + fx.prose(rng, "fr", rng.randint(0, 50)), "en", "s", 1))
    rows += [(700, "ab " * 300, "en", "s", 1), (701, "ab " * 200 + "c", "en", "s", 1), (702, passage + passage, "en", "s", 1)]
    return rows


@pytest.mark.parametrize("group_max", [20_000, 3])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_byte_dedup_matches_brute_force(spark, monkeypatch, keep, group_max):
    monkeypatch.setattr(lpf_dedup, "SLICE_BYTES", 3000)
    rows = repeats(random.Random(12))
    docs = spark.createDataFrame(rows, fx.SCHEMA).repartition(5)
    out = lpf_dedup.dedup(docs, 100, 30, keep, group_max).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out), key=repr)
    assert got == brute_bytes([(r[0], r[1]) for r in rows], 100, keep)


def test_byte_dedup_edges(spark):
    docs = fx.awkward(spark).filter("doc_id is null or doc_id <> 6")
    out = lpf_dedup.digests(fx.with_clashes(docs)).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=repr)
    want = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in
            brute_bytes([(r["doc_id"], r["text"]) for r in docs.collect()], 200, "none")]
    assert got == sorted(want, key=repr)
    assert lpf_dedup.digests(fx.empty(spark)).count() == 0
