"""Operator 7: near-duplicate classes by BagMinHash signatures, bands and exact verification.

A text is a bag of 5-word shingles. Every shingle with its multiplicity w is a
set of Poisson processes over the weight range cut into the intervals [0, 1),
[1, 2), [2, 4), [4, 8) ...: each interval that begins below w emits points
(time, component, weight level) at a rate equal to its width, and a point counts if its
level lies below w. Points come from hashes of (shingle, interval), so bags
share them. Component i of the signature is the time of its first counted
point; two bags agree in a component with probability equal to their weighted
Jaccard similarity. An interval is followed only while its time is below the
largest component so far, so a text costs about one point per shingle plus
M ln M.

Equal texts are one node. Signatures are cut into ``BANDS`` bands of ``ROWS``;
nodes that agree in a band share a bucket. Links are the pairs in a bucket with
weighted Jaccard similarity of at least 0.8, computed from the texts; classes
are the connected components of the links.

Buckets are not expanded into pairs. Shingles that one bucketed text alone
holds cannot be shared, so with u of its n shingles alone, two texts share at
most o = min(n - u, n' - u') and their similarity is at most o / (n + n' - o).
A text's sketch has a bit for every class of shingle hashes that it holds: d
bits that differ stand for at least d shingles that only one of two texts has,
so their similarity is at most (n + n' - d) / (n + n' + d). These exact bounds
settle most pairs without their texts, and so does the triangle inequality with
the distances to the bucket's first pivot. (The pairs that they settle still
meet in the bucket's join, as rows that it does not return.) In each round a bucket's pivots
(the first one the member with the least of its own) are compared with all its
members of other classes within the bound, and classes are joined. Later pivots
are taken outside the bucket's largest class; the last round takes all that are
left. After it, of any two members of different classes one has been compared
with the other or the bound rules them out, so no link is missed, and groups
that hang together cost one comparison per member and not per pair. Rounds end
as soon as no bucket holds two classes.

Cases: rows without doc_id or text form no class (class_id is their doc_id);
empty and wordless texts are only grouped with equal ones; texts of 1 to 4
words are one shingle; rows repeated with one doc_id share a class; the class
is named by its smallest doc_id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.llm import bytehash
from risklib.llm.common import stored

SHINGLE_WORDS, MIN_SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 5  # a pair of similarity 0.8 shares a bucket but for 15 in a million
SKETCH_WORDS = 16  # 1,024 bits a text
SLICE_CHARS, SLICE_TEXTS = 1_500_000, 2000
PIVOTS = (1, 16, None)  # pivots per bucket and round; None: all that are left
BROADCAST_ROWS = 1_000_000
GAMMA = 0x9E3779B97F4A7C15


def bag(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE_WORDS):
    """Distinct shingles of every text: (text, shingle hash, multiplicity)."""
    shingles, per = bytehash.shingles_of(words, counts, k)
    text = np.repeat(np.arange(len(per)), per)
    own = bytehash.mix(shingles + bytehash.mix(text.astype(np.uint64)))
    _, first, n = np.unique(own, return_index=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    return text[first[order]], shingles[first[order]], n[order]


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """First-point times [texts, m]; rows of texts without shingles stay infinite."""
    h = np.full(n_texts * m, np.inf)
    # one process per (shingle, interval that begins below the weight)
    owner, level = [np.arange(len(text))], [np.zeros(len(text), np.int64)]
    k, low = 1, 1
    while True:
        more = np.flatnonzero(weight > low)
        if not len(more):
            break
        owner.append(more)
        level.append(np.full(len(more), k))
        k, low = k + 1, low * 2
    owner, level = np.concatenate(owner), np.concatenate(level)
    doc, w = text[owner], weight[owner]
    begin = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.int64)
    width = np.maximum(begin, 1)
    seed = bytehash.mix(shingle[owner] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    at = np.zeros(len(owner))
    step = 0
    while len(owner):
        step += 1
        r = bytehash.mix(seed + np.uint64(step * GAMMA & (1 << 64) - 1))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        at = at - np.log(u) / (width * m)
        q = bytehash.mix(r ^ np.uint64(GAMMA))
        component = (q % np.uint64(m)).astype(np.int64)
        counted = begin + (((q >> np.uint64(32)).astype(np.int64) * width) >> 32) < w
        np.minimum.at(h, (doc * m + component)[counted], at[counted])
        docs = np.unique(doc) if len(doc) < n_texts else np.arange(n_texts)
        bound = np.zeros(n_texts)
        bound[docs] = h.reshape(n_texts, m)[docs].max(axis=1)
        live = np.flatnonzero(at < bound[doc])
        owner, doc, w, begin, width, seed, at = (x[live] for x in (owner, doc, w, begin, width, seed, at))
    return h.reshape(n_texts, m)


def band_hashes(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = h.view(np.uint64).reshape(len(h), bands, rows)
    out = np.zeros((len(h), bands), np.uint64)
    for r in range(rows):
        out = bytehash.mix(out + bits[:, :, r])
    return out


def sketches(text: np.ndarray, shingle: np.ndarray, n_texts: int, words: int = SKETCH_WORDS) -> np.ndarray:
    """Per text the set of (shingle hash modulo 64 * words), as bits."""
    out = np.zeros(n_texts * words, np.uint64)
    bit = shingle % np.uint64(64 * words)
    at = text * words + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n_texts, words)


def _slices(texts):
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= SLICE_CHARS and j - i < SLICE_TEXTS):
            chars += len(texts[j])
            j += 1
        yield i, j
        i = j


SIGNED = "doc_id long, t1 long, t2 long, n long, bands array<long>, sketch array<long>"


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: the text's 128-bit hash, its number of shingles, its band hashes (empty without words) and its sketch."""
    def make(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(3).to_pylist()]
            n, out, bits = [], [], []
            for i, j in _slices(texts):
                words, counts = bytehash.words_of(texts[i:j])
                text, shingle, weight = bag(words, counts)
                total = np.bincount(text, weight, j - i).astype(np.int64)
                b = band_hashes(signatures(text, shingle, weight, j - i, bands * rows), bands, rows).view(np.int64)
                n += total.tolist()
                out += [x if t else [] for x, t in zip(b.tolist(), total.tolist())]
                bits += sketches(text, shingle, j - i).view(np.int64).tolist()
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(out, lists), pa.array(bits, lists)],
                names=["doc_id", "t1", "t2", "n", "bands", "sketch"])

    return _texts(docs).mapInArrow(make, SIGNED)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"),
                       F.xxhash64(F.lit(7), "text").alias("t2"), "text").filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def jaccard(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the two shingle bags."""
    words, counts = bytehash.words_of([a.encode(), b.encode()])
    text, shingle, n = bag(words, counts)
    first = text == 0
    va, vb, na, nb = shingle[first], shingle[~first], n[first], n[~first]
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    low = int(np.minimum(na[ia], nb[ib]).sum())
    high = int(na.sum() + nb.sum()) - low
    return low / high if high else 0.0


def texts_at(docs: DataFrame, places: DataFrame, small: bool) -> DataFrame:
    """The text of every row of ``places`` (doc, t1, t2 and others): that of its hash, where a doc_id has several."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(places) if small else places, "doc").filter(
        (F.xxhash64("text") == F.col("t1")) & (F.xxhash64(F.lit(7), "text") == F.col("t2")))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """The similarity of the texts of the pairs (a, b) of nodes."""
    small = n_pairs <= BROADCAST_ROWS

    def side(c):
        p = nodes.select(F.col("rep").alias(c), "doc", "t1", "t2").join(_sized(pairs, n_pairs), c)
        return texts_at(docs, p, small).select("a", "b", F.col("text").alias(f"text_{c}")).dropDuplicates(["a", "b"])

    def check(batches):
        for batch in batches:
            sim = [jaccard(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    both = side("a").join(side("b"), ["a", "b"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long, sim double")


def _sized(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` counted rows, broadcast where they are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def alone(docs: DataFrame, reps: DataFrame, n_reps: int) -> DataFrame:
    """(rep, own): the weight of the shingles that no other of the given nodes' texts has; texts without any are left out."""
    texts = texts_at(docs, reps, n_reps <= BROADCAST_ROWS).select("rep", "text")

    def make(batches):
        for batch in batches:
            reps, texts = np.asarray(batch.column(0)), [t.encode() for t in batch.column(1).to_pylist()]
            for i, j in _slices(texts):
                words, counts = bytehash.words_of(texts[i:j])
                text, shingle, weight = bag(words, counts)
                yield pa.RecordBatch.from_arrays([pa.array(reps[i:j][text]), pa.array(shingle.view(np.int64)), pa.array(weight)],
                                                 names=["rep", "shingle", "weight"])

    held = texts.mapInArrow(make, "rep long, shingle long, weight long")
    once = held.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.min("weight").alias("weight"))
    return once.filter("rep = last").groupBy("rep").agg(F.sum("weight").alias("own"))


def merged(labels: DataFrame, n: int, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) of ``n`` nodes after the links (u, v) between nodes have joined their classes.

    Each turn, every root that meets a smaller one across a link hooks to the
    smallest, chains of hooks are shortened, and the nodes take the root they lead to.
    Within two turns every root with a link left hooks or is hooked to, so
    the number of turns grows with the logarithm of the class size.
    """
    while True:
        at = _sized(labels, n)
        met = links.join(at.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(
            at.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v").filter("ru <> rv")
        hooks = stored(met.groupBy(F.greatest("ru", "rv").alias("r")).agg(F.min(F.least("ru", "rv")).alias("to")), "near-hooks")
        k = hooks.count()
        if not k:
            return labels
        short = hooks
        for _ in range(2):  # hooks lead to smaller roots, so there is no circle
            nxt = short.select(F.col("r").alias("to"), F.col("to").alias("then"))
            short = short.join(_sized(nxt, k), "to", "left").select("r", F.coalesce("then", "to").alias("to"))
        labels = stored(labels.join(_sized(short.withColumnRenamed("r", "root"), k), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")), "near-labels")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of the edges (u, v) that is not that root itself."""
    e = stored(edges.filter("u <> v").select("u", "v"), "edges")
    labels = stored(e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct().withColumn(
        "root", F.col("node")), "near-labels")
    return merged(labels, labels.count(), e).filter("node <> root")


def text_classes(docs: DataFrame, threshold: float = MIN_SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, t1, t2 ...), and per text (t1, t2) its smallest doc_id ``doc``, the class's smallest
    doc_id ``name`` and whether the text is the one that stands for its class (``lead``)."""
    sigs = stored(signed(docs, bands, rows), "near-signatures")
    # a node is a text; its number is not a doc_id, as a doc_id may have several texts
    nodes = sigs.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                                         F.first("sketch").alias("sketch"))
    nodes = stored(nodes.withColumn("rep", F.monotonically_increasing_id()), "near-nodes")
    named = nodes.select("t1", "t2", "rep", "doc")
    entries = nodes.select("rep", "n", F.posexplode("bands").alias("band", "hash"))
    many = entries.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    members = stored(entries.join(many, ["band", "hash"]), "near-members")
    reps = stored(members.select("rep").distinct().join(nodes.select("rep", "doc", "t1", "t2"), "rep"), "near-reps")
    n_reps = reps.count()
    if not n_reps:
        return sigs, named.select("t1", "t2", "doc", F.col("doc").alias("name"), F.lit(True).alias("lead"))
    own = stored(alone(docs, reps, n_reps), "near-own")
    members = members.join(_sized(own, n_reps), "rep", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter(
        F.col("n") - F.col("own") >= F.lit(threshold) * F.col("n"))  # the others link to nothing
    members = members.join(nodes.select("rep", "bands", "sketch"), "rep")
    labels = reps.select(F.col("rep").alias("node"), F.col("rep").alias("root"))
    labels = _linked(docs, nodes, stored(members, "near-members"), labels, n_reps, threshold)
    # a class has the name of its smallest doc_id; a text outside all buckets is its own class
    known = labels.join(_sized(reps.select(F.col("rep").alias("node"), "doc", "t1", "t2"), n_reps), "node")
    least = known.groupBy("root").agg(F.min(F.struct("doc", "t1", "t2", "node")).alias("least"))
    known = labels.join(_sized(least, n_reps), "root").select("node", F.col("least.doc").alias("name"), F.col("least.node").alias("first"))
    return sigs, named.join(_sized(known, n_reps), F.col("rep") == F.col("node"), "left").select(
        "t1", "t2", "doc", F.coalesce("name", "doc").alias("name"), F.coalesce(F.col("first") == F.col("rep"), F.lit(True)).alias("lead"))


def classes(docs: DataFrame, threshold: float = MIN_SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id of every row of ``docs`` (doc_id, text)."""
    sigs, named = text_classes(docs, threshold, bands, rows)
    # a doc_id with several texts has the smallest class of them
    own = sigs.select("doc_id", "t1", "t2").join(named.select("t1", "t2", "name"), ["t1", "t2"]).groupBy("doc_id").agg(
        F.min("name").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(own, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _linked(docs: DataFrame, nodes: DataFrame, members: DataFrame, labels: DataFrame, n: int, threshold: float) -> DataFrame:
    """``labels`` (node, root) of the ``n`` bucketed texts after the rounds of pivots; a round without an open bucket ends them."""
    done = tested = far = None
    n_tested = n_far = 0
    for i, pivots in enumerate(PIVOTS):
        cls = members.join(_sized(labels, n), F.col("rep") == F.col("node")).select(
            "band", "hash", "rep", "n", "own", "bands", "sketch", F.col("root").alias("cls"))
        if i == 0:
            least = F.struct(F.col("own") / F.col("n"), F.col("rep"))
            chosen = members.groupBy("band", "hash").agg(
                F.min_by(F.struct("rep", "n", "own", "sketch", F.col("rep").alias("cls")), least).alias("p"),
                F.count(F.lit(1)).alias("k")).filter("k > 1").select("band", "hash", "p.*")
        else:
            # the largest class of every bucket that has several
            sizes = cls.groupBy("band", "hash", "cls").agg(F.count(F.lit(1)).alias("c"))
            open_ = stored(sizes.groupBy("band", "hash").agg(
                F.max_by("cls", F.struct("c", F.negative("cls"))).alias("main"), F.count(F.lit(1)).alias("k"),
                F.sum("c").alias("size"), F.max("c").alias("top")).filter("k > 1"), "near-open")
            n_open = open_.count()
            if not n_open:
                break
            left = cls.join(_sized(open_, n_open), ["band", "hash"]).filter("cls <> main").join(
                _sized(done, n_done), ["band", "hash", "rep"], "left_anti")
            if pivots is not None:  # an expected number of pivots, by hash; the last round takes the rest
                draw = F.pmod(F.xxhash64("band", "hash", "rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
                left = left.filter(draw < pivots / (F.col("size") - F.col("top")))
            chosen = left.select("band", "hash", "rep", "n", "own", "sketch", "cls")
        chosen = stored(chosen, "near-pivots")
        n_chosen = chosen.count()
        if not n_chosen:
            continue
        p = chosen.select("band", "hash", F.col("rep").alias("p_rep"), F.col("n").alias("p_n"),
                          F.col("own").alias("p_own"), F.col("sketch").alias("p_sketch"), F.col("cls").alias("p_cls"))
        where = chosen.groupBy(F.col("rep").alias("w_rep")).agg(F.collect_list(F.struct("band", "hash")).alias("at"))  # BANDS at most
        p = p.join(_sized(where, n_chosen), F.col("p_rep") == F.col("w_rep"))
        # a pair that meets in several of the pivot's buckets is made in the first of them
        # distances to the bucket's first pivot: 1 - similarity is a metric, so a link's two differ by 1 - threshold at most
        near = F.lit(True)
        if far is not None:
            cls = cls.join(_sized(far, n_far), ["band", "hash", "rep"], "left")
            p = p.join(_sized(far.select("band", "hash", F.col("rep").alias("p_rep"), F.col("sim").alias("p_sim")), n_far),
                       ["band", "hash", "p_rep"], "left")
            near = F.coalesce(F.abs(F.col("sim") - F.col("p_sim")) <= F.lit(1 - threshold + 1e-9), F.lit(True))
        earlier = F.exists("at", lambda x: (x["band"] < F.col("band")) & (F.get(F.col("bands"), x["band"]) == x["hash"]))
        shared = F.least(F.col("n") - F.col("own"), F.col("p_n") - F.col("p_own"))
        differ = sum((F.bit_count(F.get("sketch", F.lit(w)).bitwiseXOR(F.get("p_sketch", F.lit(w)))) for w in range(SKETCH_WORDS)), F.lit(0))
        total = F.col("n") + F.col("p_n")
        pairs = cls.join(p, ["band", "hash"]).filter(
            (F.col("rep") != F.col("p_rep")) & (F.col("cls") != F.col("p_cls")) & ~earlier & near
            & (shared >= F.lit(threshold) * (total - shared)) & (total - differ >= F.lit(threshold) * (total + differ))).select(
            F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(_sized(tested, n_tested), ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-pairs")
        n_pairs = pairs.count()
        last = i == len(PIVOTS) - 1
        if not last:
            key = chosen.select("band", "hash", "rep")
            done, n_done = (key, n_chosen) if done is None else (done.unionByName(key), n_done + n_chosen)
            tested, n_tested = (pairs, n_pairs) if tested is None else (tested.unionByName(pairs), n_tested + n_pairs)
        if n_pairs:
            sims = stored(verified(docs, nodes, pairs, n_pairs), "near-similarities")
            if i == 0:
                pivot = chosen.select("band", "hash", F.col("rep").alias("p_rep"))
                pair = members.select("band", "hash", "rep").join(_sized(pivot, n_chosen), ["band", "hash"])
                far = stored(pair.select("band", "hash", "rep", F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")
                                         ).join(_sized(sims, n_pairs), ["a", "b"]).select("band", "hash", "rep", "sim"), "near-first-pivot")
                n_far = far.count()
            labels = merged(labels, n, sims.filter(F.col("sim") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return labels


def keep_one(docs: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their class of texts; rows without doc_id or text stay. All columns as they were.

    A class keeps one row: the smallest doc_id with its text, or the smaller text hash where that doc_id has several
    texts in the class. So a doc_id with texts of two classes can keep a row of each. Of rows with one doc_id and
    one text, one stays.
    """
    sigs, named = text_classes(docs, threshold)
    copies = sigs.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("c"))
    found = stored(copies.join(named, ["t1", "t2"]).select(
        "doc_id", "t1", "t2", "c", (F.col("lead") & (F.col("doc_id") == F.col("doc"))).alias("stays")), "near-rows")
    of_docs = [F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__t1"), F.xxhash64(F.lit(7), "text").alias("__t2")]
    keyed = docs.select("*", *of_docs)
    gone = found.filter(~F.col("stays")).select(F.col("doc_id").alias("__doc"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    seen = found.agg(F.count_if(~F.col("stays")).alias("gone"), F.count_if(F.col("stays") & (F.col("c") > 1)).alias("twice")).first()
    on = ["__doc", "__t1", "__t2"]
    kept = keyed.join(_sized(gone, seen["gone"]), on, "left_anti")
    if seen["twice"]:
        whole = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
        kept = kept.filter(whole).dropDuplicates(on).unionByName(kept.filter(~whole))
    return kept.select(*[f"`{c}`" for c in docs.columns])
