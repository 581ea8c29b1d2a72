"""Operator 8: benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Benchmark items are grouped into window sizes on a grid of ratio ``GRID``. An
item enters with the 64-bit SimHashes of windows spread over its whole length:
of half its size, of ``LONGEST`` / 2 words at most, at least three and so many
that every word is in one, so that edits anywhere leave some of them alone
(items of less than ``HALVED`` words: of its own size, first and last). Documents
are slid over word by word with windows of every size; a window's SimHash comes
from prefix sums of packed 8-bit counters, a handful of operations per word.

A place that reaches the similarity shares a shingle with its item. So the words
of a document are first looked up in a bit table and then in the sorted shingles
of the benchmark, and windows slide only over words within the longest item's
length of a shared shingle. This is exact: the windows and aligned items left out share
no shingle with any item and have similarity 0.

Fingerprints within Hamming radius ``RADIUS`` are found without comparing all:
they are cut into 4 blocks of 16 bits, and two fingerprints within the radius
agree in some block to within RADIUS // 4 bits, so an index by block value that
also lists the values one bit away finds every one of them. The candidates
within the radius are aligned to the whole item and verified: the weighted
Jaccard similarity of the 5-word shingle multisets, weight ln(1 + items /
items with the shingle), must reach ``MIN_SIMILARITY``.

Items and items per shingle are counted once over the whole benchmark. Items
are taken in blocks of about ``ITEM_BLOCK``, ``PASS_BLOCKS`` of them in one pass over the documents;
the blocks are prepared in tasks and written, and the verdict on an item does
not depend on its block. A task holds the blocks of a pass and the weights of the
shingles that several items share (16 bytes each; all others weigh the same).

Words are lower-cased and cut at white space. Cases: null or empty texts and
items without words match nothing; items shorter than 5 words are one shingle
and must occur whole; repeated items are reported each; of several matching
places the one with the highest similarity, then the earliest, is reported;
an item without an item_id counts like any other and is reported with a null;
repeated document rows are reported each; extra columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.llm import bytehash
from risklib.llm.common import stored

RADIUS, MIN_SIMILARITY, GRID, ITEM_BLOCK, PASS_BLOCKS = 7, 0.8, 1.2, 4096, 4
TABLE_BITS = 22  # the bit table that words are first looked up in (4 MB)
BLOCKS, BLOCK_BITS, SHINGLE_WORDS = 4, 16, 5
LONGEST = 120  # an item of more words enters with windows of half of this, the more the longer it is
HALVED = 9  # words from which an item can lose a shingle and still match
SLICE_WORDS, SLICE_CHARS = 60_000, 750_000
ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)


def lanes(words: np.ndarray) -> np.ndarray:
    """Bits of the word hashes as 8-bit counters of 0 or 1: 8 columns of 8 lanes; lane i of column j is bit 8 * i + j."""
    return np.stack([(words >> np.uint64(j)) & ONES for j in range(8)])


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words, from prefix sums of lanes [8, n + 1]."""
    out = np.zeros(max(0, sums.shape[1] - size), np.uint64)
    # a counter over half of the size sets its lane's high bit
    bias = ONES * np.uint64(127 - size // 2)
    for j in range(8):
        out |= (((sums[j, size:] - sums[j, :-size] + bias) & HIGH) >> np.uint64(7 - j))
    return out


def prefix(words: np.ndarray) -> np.ndarray:
    s = np.zeros((8, len(words) + 1), np.uint64)
    np.cumsum(lanes(words), axis=1, out=s[:, 1:])
    return s


def window_words(n: int) -> int:
    """The wanted size of the windows of an item of ``n`` words."""
    return n if n < HALVED else min(n, LONGEST) // 2


def window_sizes(lengths: list[int]) -> dict[int, int]:
    """Wanted size -> window size: the largest grid size that is no longer."""
    out, size = {}, None
    for n in sorted(set(window_words(x) for x in lengths if x > 0)):
        if size is None or n > size * GRID:
            size = n
        out[n] = size
    return out


def window_offsets(n: int, size: int) -> list[int]:
    """First words of the windows of an item of ``n`` words, from its start to its end."""
    if n < HALVED:
        return sorted({0, n - size})
    k = max(3, -(-n // size))
    return sorted({i * (n - size) // (k - 1) for i in range(k)})


def block_index(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block: (start of every value's list, entries); an entry is listed under every value within RADIUS // BLOCKS bits."""
    near = [0] + [1 << i for i in range(BLOCK_BITS)] if RADIUS // BLOCKS >= 1 else [0]
    assert RADIUS // BLOCKS <= 1
    out = []
    for b in range(BLOCKS):
        own = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
        values = np.concatenate([own ^ d for d in near])
        entry = np.tile(np.arange(len(prints)), len(near))
        order = np.argsort(values, kind="stable")
        out.append((np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)), entry[order]))
    return out


def near_prints(windows: np.ndarray, prints: np.ndarray, index) -> tuple[np.ndarray, np.ndarray]:
    """All (window, entry) within RADIUS, each once."""
    found_w, found_e = [], []
    for b, (start, entries) in enumerate(index):
        v = ((windows >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
        n = (start[1:] - start[:-1])[v]
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        n = n[hit]
        w = np.repeat(hit, n)
        e = entries[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[v[hit]], n)]
        ok = np.bitwise_count(windows[w] ^ prints[e]) <= RADIUS
        found_w.append(w[ok])
        found_e.append(e[ok])
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found_w) * len(prints) + np.concatenate(found_e))
    return both // len(prints), both % len(prints)


Weights = tuple[np.ndarray, np.ndarray, float]  # shingles in order, their weights, the weight of all others


def shingle_weights(n_items: int, shingles: np.ndarray, held: np.ndarray) -> Weights:
    """Weights ln(1 + items / items with the shingle), from the shingles that several items hold."""
    order = np.argsort(shingles)
    return shingles[order], np.log1p(n_items / held[order]), math.log(1 + max(1, n_items))


def weigh(values: np.ndarray, weights: Weights) -> np.ndarray:
    known, weight, default = weights
    if not len(known):
        return np.full(len(values), default)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, weight[at], default)


def prepare_items(items: list[tuple[int, str]]) -> dict:
    """The fingerprints and shingle bags of one block of items."""
    words, counts = bytehash.words_of([(t or "").lower().encode() for _, t in items])
    shingles, per = bytehash.shingles_of(words, counts)
    w_at, s_at = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(per)])
    bags = [np.unique(shingles[s_at[i]:s_at[i + 1]], return_counts=True) for i in range(len(items))]
    sizes = window_sizes(counts.tolist())
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for i in range(len(items)):
        n = int(counts[i])
        if n:
            size = sizes[window_words(n)]
            for offset in window_offsets(n, size):
                own = words[w_at[i] + offset:w_at[i] + offset + size]
                groups.setdefault(size, []).append((int(window_hashes(prefix(own), size)[0]), i, offset))
    out = [{"size": size, "prints": np.array([e[0] for e in entries], np.uint64), "item": np.array([e[1] for e in entries]),
            "offset": np.array([e[2] for e in entries])} for size, entries in sorted(groups.items())]
    return {"groups": out, "ids": [i for i, _ in items], "lengths": counts, "bags": bags}


def with_index(prepared: dict, weights: Weights) -> dict:
    groups = [g | {"index": block_index(g["prints"])} for g in prepared["groups"]]
    lengths = prepared["lengths"]
    shared = {}  # words of a shingle -> the shingles of that many words; items of less than 5 words are one shingle
    for k in sorted({min(int(n), SHINGLE_WORDS) for n in lengths if n}):
        values = np.unique(np.concatenate([v for (v, _), n in zip(prepared["bags"], lengths) if min(int(n), SHINGLE_WORDS) == k]))
        table = np.zeros(1 << TABLE_BITS, bool)
        table[values >> np.uint64(64 - TABLE_BITS)] = True
        shared[k] = (table, values)
    return prepared | {"groups": groups, "weights": weights, "shared": shared, "longest": int(max(lengths, default=0))}


def build_items(items: list[tuple[int, str]], weights: Weights | None = None) -> dict:
    """The index of one block of items; ``weights`` are those of the whole benchmark, if it has more items."""
    prepared = prepare_items(items)
    if weights is None:
        held = np.concatenate([np.zeros(0, np.uint64), *[v for v, _ in prepared["bags"]]])
        weights = shingle_weights(len(items), *np.unique(held, return_counts=True))
    return with_index(prepared, weights)


def similarity(window: tuple[np.ndarray, np.ndarray], item: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    """Weighted Jaccard similarity of two shingle multisets (values in order, counts)."""
    values, at = np.unique(np.concatenate([window[0], item[0]]), return_inverse=True)
    n = np.zeros((2, len(values)))
    n[0, at[:len(window[0])]] = window[1]
    n[1, at[len(window[0]):]] = item[1]
    w = weigh(values, weights)
    high = float(w @ n.max(axis=0))
    return float(w @ n.min(axis=0)) / high if high else 0.0


def scan_texts(texts: list[str | None], items: dict | list[dict]) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity) of the best place of every matching (text, item).

    With several blocks of items, an item's number counts on through the blocks.
    """
    blocks = [items] if isinstance(items, dict) else items
    out, i = [], 0
    texts = [t or "" for t in texts]
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= SLICE_CHARS):
            chars += len(texts[j])
            j += 1
        words, counts = bytehash.words_of([t.lower().encode() for t in texts[i:j]])
        sums: dict[int, np.ndarray] = {}
        before = 0
        for block in blocks:
            out += [(i + d, before + item, *rest) for d, item, *rest in _scan_slice(words, counts, sums, block)]
            before += len(block["ids"])
        i = j
    return out


def shingle_starts(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from every word on, as ``bytehash.shingles_of`` gives it for a shingle or a text of ``k`` words."""
    n = max(0, len(words) - k + 1)
    mixed = bytehash.mix(words)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += mixed[j:j + n] * bytehash.SHINGLE[j]
    return bytehash.mix(total)


def near_shared(words: np.ndarray, ends: np.ndarray, chain: np.ndarray, sums: dict[int, np.ndarray], items: dict) -> np.ndarray:
    """Which words lie within the longest item's length of a shingle of an item, in order."""
    edge = np.zeros(len(words) + 1, np.int64)
    for k, (table, values) in items["shared"].items():
        if k not in sums:
            sums[k] = shingle_starts(words, k)
        at = np.flatnonzero(table[sums[k] >> np.uint64(64 - TABLE_BITS)])
        if not len(at):
            continue
        at = at[at + k <= ends[chain[at]]]
        found = np.minimum(np.searchsorted(values, sums[k][at]), len(values) - 1)
        at = at[values[found] == sums[k][at]]
        np.add.at(edge, np.maximum(at - items["longest"], 0), 1)
        np.add.at(edge, np.minimum(at + items["longest"], len(words)), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _scan_slice(words: np.ndarray, counts: np.ndarray, starts: dict[int, np.ndarray], items: dict) -> list[tuple[int, int, int, int, float]]:
    ends = np.cumsum(counts)
    begins = ends - counts
    chain = np.repeat(np.arange(len(counts)), counts)
    found: set[tuple[int, int]] = set()
    places = near_shared(words, ends, chain, starts, items)
    for at in range(0, len(places), SLICE_WORDS):
        here = places[at:at + SLICE_WORDS + LONGEST]
        sums = prefix(words[here])
        for g in items["groups"]:
            hashes = window_hashes(sums, g["size"])[:SLICE_WORDS]
            w, e = near_prints(hashes, g["prints"], g["index"])
            if len(w):
                first = here[w]
                inside = (here[w + g["size"] - 1] == first + g["size"] - 1) & (first + g["size"] <= ends[chain[first]])
                start, item = (first - g["offset"][e])[inside], g["item"][e][inside]
                doc = chain[first[inside]]
                # the whole item, moved into the text where it would stick out
                n = items["lengths"][item]
                start = np.maximum(begins[doc], np.minimum(start, ends[doc] - n))
                found.update(zip(start.tolist(), item.tolist()))
    best: dict[tuple[int, int], tuple[int, int, float]] = {}
    for start, item in sorted(found):
        doc = int(chain[start])
        n = min(int(items["lengths"][item]), int(ends[doc]) - start)
        own = words[start:start + n]
        sh, _ = bytehash.shingles_of(own, np.array([n]))
        s = similarity(np.unique(sh, return_counts=True), items["bags"][item], items["weights"])
        if s >= MIN_SIMILARITY and s > best.get((doc, item), (0, 0, 0.0))[2]:
            best[doc, item] = (start - int(begins[doc]), n, s)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def item_blocks(benchmark: DataFrame):
    """Functions that give the indexes of one pass's blocks of items in a task; the driver hands on the prepared blocks of one pass at a time."""
    spark = benchmark.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        F.col("text").isNotNull()), "benchmark-items")
    n_items = items.count()
    if not n_items:
        return
    n_blocks = -(-n_items // ITEM_BLOCK)

    def distinct_shingles(batches):
        for batch in batches:
            words, counts = bytehash.words_of([t.lower().encode() for t in batch.column(0).to_pylist()])
            shingles, per = bytehash.shingles_of(words, counts)
            at = np.concatenate([[0], np.cumsum(per)])
            own = [np.unique(shingles[at[i]:at[i + 1]]) for i in range(len(per))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], names=["shingle"])

    def prepare(table):
        rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        return pa.table({"block": table["block"].slice(0, 1), "prepared": pa.array([pickle.dumps(prepare_items(rows))], pa.binary())})

    common = items.select("text").mapInArrow(distinct_shingles, "shingle long").groupBy("shingle").agg(
        F.count(F.lit(1)).alias("held")).filter("held > 1").toArrow()
    weights = spark.sparkContext.broadcast(shingle_weights(
        n_items, common["shingle"].to_numpy().view(np.uint64), common["held"].to_numpy()))
    blocks = stored(items.withColumn("block", F.floor(F.rand(11) * n_blocks).cast("int")), "benchmark-blocks")
    blocks = stored(blocks.groupBy("block").applyInArrow(prepare, "block int, prepared binary"), "benchmark-prepared")
    for b in range(0, n_blocks, PASS_BLOCKS):
        rows = blocks.filter((F.col("block") >= b) & (F.col("block") < b + PASS_BLOCKS)).orderBy("block").collect()  # the blocks of one pass
        if rows:
            shared = spark.sparkContext.broadcast([bytes(r["prepared"]) for r in rows])
            yield lambda shared=shared: [with_index(pickle.loads(p), weights.value) for p in shared.value]


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, item) with a matching place: doc_id, item_id, first_word, n_words, similarity."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    out = spark.createDataFrame([], SCHEMA)
    for index in item_blocks(benchmark):

        def scan(batches, index=index):
            items = index()
            names = [i for block in items for i in block["ids"]]
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                hits = scan_texts(texts, items)
                cols = list(zip(*hits)) if hits else [()] * 5
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[d] for d in cols[0]], pa.int64()), pa.array([names[i] for i in cols[1]], pa.int64()),
                    pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())],
                    names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        out = out.unionByName(rows.mapInArrow(scan, SCHEMA))
    return out


def contaminated(spark, texts_of: DataFrame, benchmark: DataFrame):
    """Column functions text -> has a match, one per pass over the items."""
    def hit_of(index):
        @F.pandas_udf("boolean")
        def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            items = index()
            for texts in batches:
                bad = {d for d, *_ in scan_texts([t if isinstance(t, str) else None for t in texts], items)}
                yield pd.Series([i in bad for i in range(len(texts))], dtype="bool")

        return hit

    return [hit_of(index) for index in item_blocks(benchmark)]


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a matching place, all columns as they were."""
    for hit in contaminated(docs.sparkSession, docs, benchmark):
        docs = docs.filter(~hit(F.col("text")))
    return docs
