"""Operator 1: language identification by a linear-chain conditional random field.

Every word of a text gets a language. The emission scores of a word add learned
weights of its affixes (1 to 3 characters at either end), the bigrams and
trigrams of all its characters, its shape, and its entry in a lexicon of frequent
training words; a learned matrix scores the transitions between the languages of
neighbouring words, from the pairwise posteriors of forward-backward. Forward-backward gives the posterior of every word; a document's
language is the one with the largest posterior mass over its words, its score
the share of that mass, so a code-switched text scores below a plain one.

Training uses a bounded sample: about ``PER_LANG`` documents of each of the
``MAX_LANGS`` most frequent languages (ties by name), chosen by the hash of the
key, and ``WINDOWS`` windows of ``WINDOW`` words of each, cut in the tasks (a word gives its first
``TRAIN_CHARS`` characters to the sample; predictions use whole words). Half of the training chains join pieces of two languages, from which the
transitions are learned.

Forward-backward runs on all chains of a batch at once: chains are cut into
blocks, a pass over the blocks gives each block's transfer matrix, the block
matrices are chained per document, and a second pass gives the posteriors. The
result is that of the plain recursion, for texts of any length.

Cases: null texts and texts without a letter give ``und`` and score 0; words
without letters take part in no decision; a null lang is never learned from;
without labelled rows every text gives ``und``; ties go to the first language
in sorted order; repeated rows agree; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklib.llm.common import key_text, unit_draw

PER_LANG, WINDOWS, WINDOW, MAX_LANGS, TRAIN_CHARS = 400, 2, 48, 200, 64
BUCKETS, LEX_MIN = 1 << 16, 3
EPOCHS, BATCH, RATE = 4, 32, 0.5
BLOCK = 32
SLICE_CHARS = 1_500_000
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(start of every word's features [words + 1], feature buckets): every word has its buckets in a row."""
    low = [w.lower().strip(STRIP) for w in words]
    n = len(low)
    size = np.fromiter(map(len, low), np.int64, n)
    text = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    left = size[owner] - (np.arange(len(text)) - begin[owner])  # characters from here to the word's end

    def bucket(kind, *chars):
        h = np.full(len(chars[0]), kind, np.uint64)
        for c in chars:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1

    whose, found = [], []

    def add(who, values):
        whose.append(who)
        found.append(values)

    for k in range(3):
        long = np.flatnonzero(size > k)
        add(long, bucket(11 + k, *[text[begin[long] + j] for j in range(k + 1)]))
        add(long, bucket(21 + k, *[text[begin[long] + size[long] - 1 - j] for j in range(k + 1)]))
    for kind, k in ((31, 2), (41, 3)):
        at = np.flatnonzero(left >= k)
        add(owner[at], bucket(kind, *[text[at + j] for j in range(k)]))
    lex = np.fromiter((lexicon.get(w, 0) for w in low), np.int64, n)
    known, some = np.flatnonzero(lex), np.flatnonzero(size)
    add(known, bucket(51, lex[known].astype(np.uint64)))
    add(some, bucket(61, np.minimum(size[some], 20).astype(np.uint64)))
    whose, found = np.concatenate(whose), np.concatenate(found)
    order = np.argsort(whose, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]), found[order]


def emissions(start: np.ndarray, buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of every word's features [words, languages]."""
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    out = np.empty((len(start) - 1, weights.shape[1]), np.float32)
    for c in range(weights.shape[1]):
        out[:, c] = np.bincount(owner, weights[buckets, c], len(start) - 1)
    return out


def of_words(start: np.ndarray, buckets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the words ``ids``, as ``word_features`` gives them."""
    n = np.diff(start)[ids]
    ends = np.cumsum(n)
    return np.concatenate([[0], ends]), buckets[np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(start[ids], n)]


def has_letter(words: list[str]) -> np.ndarray:
    return np.fromiter((w.isalpha() or any(c.isalpha() for c in w) for w in words), bool, len(words))


def posteriors(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Posterior of every word of the concatenated chains; every chain starts from a uniform label."""
    if not len(emit):
        return emit.copy()
    forward, backward = forward_backward(emit, trans, lengths)
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def pair_posteriors(emit: np.ndarray, trans: np.ndarray, forward: np.ndarray, backward: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Posterior [places, label before, label] of the words ``at`` and the words before them in their chains."""
    psi = np.exp(emit[at] - emit[at].max(axis=1, keepdims=True)).astype(np.float64)
    pair = forward[at - 1][:, :, None] * np.exp(trans - trans.max())[None] * (psi * backward[at])[:, None, :]
    return pair / pair.sum(axis=(1, 2), keepdims=True)


def forward_backward(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors (a word's own scores included) and backward vectors (without them), each up to a factor per word."""
    n, k = emit.shape
    move = np.exp(trans - trans.max()).astype(np.float64)
    psi = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    blocks = -(-lengths // BLOCK)
    n_blocks = int(blocks.sum())
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    chain = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(n) - starts[chain]
    row, col = first_block[chain] + at // BLOCK, at % BLOCK
    pad = np.zeros((n_blocks, BLOCK, k))
    pad[row, col] = psi
    real = np.zeros((n_blocks, BLOCK), bool)
    real[row, col] = True
    # transfer matrix of every block
    whole = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    for t in range(BLOCK):
        live = real[:, t]
        step = (whole.reshape(-1, k) @ move).reshape(-1, k, k) * pad[:, t, None, :]
        step /= np.maximum(step.max(axis=(1, 2), keepdims=True), 1e-300)
        whole = step if live.all() else np.where(live[:, None, None], step, whole)
    # states entering every block from the left and from the right, block by block along all chains at once
    order = np.argsort(-blocks, kind="stable")
    into, back = np.full((n_blocks, k), 1.0 / k), np.ones((n_blocks, k))
    depth = blocks[order]
    for j in range(1, int(blocks.max())):
        cur = first_block[order[:np.searchsorted(-depth, -j, "left")]] + j
        v = np.einsum("ij,ijk->ik", into[cur - 1], whole[cur - 1])
        into[cur] = v / v.sum(axis=1, keepdims=True)
    last = first_block + blocks - 1
    for j in range(1, int(blocks.max())):
        cur = last[order[:np.searchsorted(-depth, -j, "left")]] - j
        v = np.einsum("ijk,ik->ij", whole[cur + 1], back[cur + 1])
        back[cur] = v / v.max(axis=1, keepdims=True)
    alpha, beta, a = np.empty((n_blocks, BLOCK, k)), np.empty((n_blocks, BLOCK, k)), into
    for t in range(BLOCK):
        s = (a @ move) * pad[:, t]
        s /= np.maximum(s.sum(axis=1, keepdims=True), 1e-300)
        a = alpha[:, t] = np.where(real[:, t, None], s, a)
    b = back
    for t in range(BLOCK - 1, -1, -1):
        live = real[:, t, None]
        beta[:, t] = b
        s = (b * pad[:, t]) @ move.T
        s /= np.maximum(s.max(axis=1, keepdims=True), 1e-300)
        b = np.where(live, s, b)
    return alpha[row, col], beta[row, col]


def windows_of(text: str) -> list[list[str]]:
    """At most ``WINDOWS`` windows of ``WINDOW`` words with letters; their places come from the text's checksum."""
    words = [w[:TRAIN_CHARS] for w in text.split() if any(c.isalpha() for c in w)]
    if not words:
        return []
    draw = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    places = draw.integers(0, max(1, len(words) - WINDOW + 1), WINDOWS).tolist()
    return [words[i:i + WINDOW] for i in places]


def train(sample: list[tuple[list[list[str]], str]], langs: list[str], seed: int = 7) -> dict:
    """Weights from (windows, lang) rows: stochastic gradient ascent with per-weight step sizes."""
    rng = np.random.default_rng(seed)
    pieces: dict[int, list[list[str]]] = {i: [] for i in range(len(langs))}
    number = {lang: i for i, lang in enumerate(langs)}
    for windows, lang in sample:
        pieces[number[lang]] += windows
    seen: dict[str, int] = {}
    for ws in pieces.values():
        for w in (w for p in ws for w in p):
            low = w.lower().strip(STRIP)
            seen[low] = seen.get(low, 0) + 1
    lexicon = {w: i + 1 for i, w in enumerate(sorted(w for w, c in seen.items() if c >= LEX_MIN and w))}
    chains = []
    have = [i for i in pieces if pieces[i]]
    for i in have:
        for p in pieces[i]:
            if len(have) > 1 and rng.random() < 0.5:
                j = have[int(rng.integers(0, len(have) - 1))]
                j = have[-1] if j == i else j
                q = pieces[j][int(rng.integers(0, len(pieces[j])))]
                cut, to = int(rng.integers(1, len(p) + 1)), int(rng.integers(1, len(q) + 1))
                chains.append((p[:cut] + q[:to], [i] * cut + [j] * to))
            else:
                chains.append((p, [i] * len(p)))
    vocab = {w: i for i, w in enumerate(sorted({w for c, _ in chains for w in c}))}
    start, buckets = word_features(list(vocab), lexicon)
    k = len(langs)
    weights, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    sq_w, sq_t = np.full((BUCKETS, k), 1e-3), np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // BATCH)):
            ids = [np.array([vocab[w] for w in chains[c][0]]) for c in part]
            gold = np.concatenate([chains[c][1] for c in part])
            lengths = np.array([len(x) for x in ids])
            first, flat = of_words(start, buckets, np.concatenate(ids))
            emit = emissions(first, flat, weights)
            forward, backward = forward_backward(emit, trans, lengths)
            post = forward * backward
            grad = -post / post.sum(axis=1, keepdims=True)
            grad[np.arange(len(gold)), gold] += 1
            used, where = np.unique(flat, return_inverse=True)
            n_features = np.diff(first)
            g = np.stack([np.bincount(where, np.repeat(grad[:, c], n_features), len(used)) for c in range(k)], axis=1)
            sq_w[used] += g * g
            weights[used] += RATE * g / np.sqrt(sq_w[used])
            inner = np.ones(len(gold), bool)
            inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
            at = np.flatnonzero(inner)
            gt = -pair_posteriors(emit, trans, forward, backward, at).sum(axis=0)
            np.add.at(gt, (gold[at - 1], gold[at]), 1)
            sq_t += gt * gt
            trans += RATE * gt / np.sqrt(sq_t)
    weights[0] = 0
    return {"langs": langs, "weights": weights.astype(np.float32), "trans": trans, "lexicon": lexicon}


def label_words(texts: list[str], model: dict):
    """Words, chain lengths, letter flags and posteriors of a few texts."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    codes, uniq = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    uniq = list(uniq)
    emit = emissions(*word_features(uniq, model["lexicon"]), model["weights"])
    letters = has_letter(uniq)
    emit[~letters] = 0
    some = lengths > 0
    post = posteriors(emit[codes], model["trans"], lengths[some])
    return flat, lengths, letters[codes] if flat else np.zeros(0, bool), post


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and score of every text."""
    langs, scores = [], []
    texts = [t or "" for t in texts]
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= SLICE_CHARS):
            chars += len(texts[j])
            j += 1
        _, lengths, letters, post = label_words(texts[i:j], model)
        chain = np.repeat(np.arange(len(lengths)), lengths)
        mass = np.stack([np.bincount(chain, post[:, c] * letters, len(lengths)) if len(chain) else np.zeros(len(lengths))
                         for c in range(len(model["langs"]))], axis=1)
        total = mass.sum(axis=1)
        top = mass.argmax(axis=1)
        for d in range(len(lengths)):
            und = total[d] <= 0
            langs.append("und" if und else model["langs"][top[d]])
            scores.append(0.0 if und else float(min(1.0, mass[d, top[d]] / total[d])))
        i = j
    return langs, scores


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> dict:
    """A model from rows (doc_id, text, lang); the windows of about ``per_lang`` rows of each language reach the driver."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return {"langs": []}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))])
    picked = rows.filter(unit_draw(F.lit("crf"), key_text(F.col("doc_id"))) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))

    def cut(batches):
        for b in batches:
            yield pa.record_batch({"windows": pa.array([windows_of(t) for t in b.column(0).to_pylist()], pa.list_(pa.list_(pa.string()))),
                                   "lang": b.column(1)})

    found = picked.select("text", "lang").mapInArrow(cut, "windows array<array<string>>, lang string").collect()
    sample = sorted((r["windows"], r["lang"]) for r in found)
    return train(sample, sorted({lang for _, lang in sample})) if sample else {"langs": []}


def language_of(spark, model: dict):
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages weights

    @F.pandas_udf("lang_pred string, score double")
    def udf(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not m["langs"]:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
        langs, scores = predict([t if isinstance(t, str) else None for t in texts], m)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return udf


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; learns from the rows that are not held out."""
    model = fit(docs.filter(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), language_of(docs.sparkSession, model)(F.col("text")).alias("p")
                       ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with one main language, all columns as they were."""
    model = fit(docs.filter(~held_out()))
    p = language_of(docs.sparkSession, model)(F.col("text"))
    return docs.withColumn("__p", p).filter((F.col("__p.lang_pred") != "und") & (F.col("__p.score") >= min_score)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
