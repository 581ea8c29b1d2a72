"""Operator 9: removal of repeated byte strings by longest-previous-factor arrays.

A byte is removed when a string of ``length`` bytes that covers it starts
anywhere else, in the same document or another (``keep="none"``), or starts
earlier (``keep="first"``: order by doc_id, text hash and place).

1. Every window of ``length`` bytes has an anchor: the ``GRAM``-byte string in
   it with the smallest hash (the leftmost of equals). Equal windows have equal
   anchors, and neighbouring windows mostly share one, so a document of n bytes
   gives about n / 76 runs of windows, each a row of an anchor hash and a hash
   of the run's bytes. Rows meet by anchor hash; no window is shuffled.
2. Runs with equal bytes repeat as a whole. Where an anchor has different runs
   (the edges of repeated passages), the bytes of one run of each kind are
   fetched.
3. In each group of runs of an anchor, window starts are put in suffix order,
   compared over ``length`` bytes and equal ones by place. The previous smaller
   place in suffix order with a common prefix of ``length`` is then the entry
   before, the next one the entry after; the longest previous factor reaches
   ``length`` exactly if they agree, and likewise the longest next factor.
   Windows whose hash occurs once in the group are left out beforehand, as no
   other window equals them.
4. A group of more than ``GROUP_MAX`` kinds of runs is not gathered: its windows
   are counted by 128-bit hash instead, with partial sums on the map side.

Cases: null and empty texts have no bytes and nothing removed; texts shorter
than ``length`` keep all; rows repeated with the same doc_id and text repeat
each other; long texts are processed in slices (a run cut by a slice is settled
by step 3); ties go by place; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.llm import bytehash
from risklib.llm.common import stored

LENGTH, GRAM = 200, 50
SLICE_BYTES = 1 << 20
GROUP_MAX = 20_000
OUT_ROWS = 50_000
NO_ID = -(1 << 63)


def window_runs(buf: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Runs of windows of the concatenated texts: (text, start in text, windows, anchor hash, bytes hash)."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n, w = len(buf), length - gram + 1
    if n < length:
        return none
    ends = np.cumsum(sizes)
    sums = bytehash.prefix_sums(buf)
    grams = n - gram + 1
    h = bytehash.mix((sums[gram:] - sums[:-gram]) * bytehash.powers(n, True)[:grams])
    low = np.uint64(8)  # hash above, place in its block of w below
    rows = -(-grams // w)
    packed = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[:grams] = (h >> low) << low
    packed = packed.reshape(rows, w) | np.arange(w, dtype=np.uint64)
    left = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(packed, axis=1).ravel()
    windows = n - length + 1
    a, b = left[:windows], right[w - 1:w - 1 + windows]
    at = np.arange(windows)
    use_left = (a >> low) <= (b >> low)
    block = np.where(use_left, at, at + w - 1) // w * w
    anchor = block + (np.where(use_left, a, b) & np.uint64(0xFF)).astype(np.int64)
    inside = np.ones(windows, bool)
    for size, end in zip(sizes.tolist(), ends.tolist()):
        inside[max(end - size, end - length + 1):end] = False
    change = np.ones(windows + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(change)
    start, stop = edges[:-1], edges[1:]
    start, stop = start[inside[start]], stop[inside[start]]
    if not len(start):
        return none
    text = np.searchsorted(ends, start, "right")
    return (text, start - (ends - sizes)[text], stop - start, h[anchor[start]] >> low,
            bytehash.span_hash(sums, start, stop + length - 1))


def slices(texts: list[bytes], length: int):
    """Lists of (text number, offset, bytes) of about SLICE_BYTES; long texts are cut with length - 1 bytes shared."""
    part, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SLICE_BYTES):
            piece = t[at:at + SLICE_BYTES + length - 1]
            if len(piece) < length:
                continue
            part.append((i, at, piece))
            size += len(piece)
            if size >= SLICE_BYTES:
                yield part
                part, size = [], 0
    if part:
        yield part


def repeated_starts(group_of: np.ndarray, contexts: list[bytes], counts: np.ndarray, length: int):
    """For window starts of the contexts (the first counts[i] places of context i): has an equal one before, after.

    Contexts are ordered; only contexts of one group share window contents.
    """
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(sizes) - sizes
    total = int(counts.sum())
    ctx = np.repeat(np.arange(len(contexts)), counts)
    place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + begin[ctx]
    before, after = np.zeros(total, bool), np.zeros(total, bool)
    sums = bytehash.prefix_sums(buf)
    h = bytehash.span_hash(sums, place, place + length)
    _, where, seen = np.unique(h, return_inverse=True, return_counts=True)
    cand = np.flatnonzero(seen[where] > 1)
    if len(cand):
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, length)[place[cand]])
        suffixes = rows.view(f"S{length}").ravel()
        order = np.argsort(suffixes, kind="stable")  # suffix order over ``length`` bytes, equal ones by place
        same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)  # common prefix of neighbours reaches ``length``
        before[cand[order[1:][same]]] = True
        after[cand[order[:-1][same]]] = True
    return ctx, place - begin[ctx], before, after


def _runs_of(flag: np.ndarray, ctx: np.ndarray, at: np.ndarray):
    """Maximal runs of flagged neighbouring places: (context, first, last)."""
    f = np.flatnonzero(flag)
    if not len(f):
        return f, f, f
    cut = np.flatnonzero((np.diff(f) != 1) | (ctx[f[1:]] != ctx[f[:-1]]))
    first, last = f[np.concatenate([[0], cut + 1])], f[np.concatenate([cut, [len(f) - 1]])]
    return ctx[first], at[first], at[last]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
                       F.xxhash64(text).alias("th"), text.alias("text"))


RUNS = "d long, th long, s long, m long, g long, digest long, known boolean, multi boolean"
MARKS = "g long, d long, th long, s long, m long, copy boolean, single boolean"
CONTEXTS = "g long, d long, th long, s long, m long, single boolean, bytes binary"
STARTS = "d long, th long, lo long, hi long"


def runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def make(batches):
        for batch in batches:
            d, th = (np.asarray(batch.column(i)) for i in range(2))
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            for part in slices(texts, length):
                ids, offs = np.array([p[0] for p in part]), np.array([p[1] for p in part])
                buf = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
                text, s, m, g, digest = window_runs(buf, np.array([len(p[2]) for p in part]), length, gram)
                d_, th_, s_, g_, dg = d[ids[text]], th[ids[text]], s + offs[text], g.view(np.int64), digest.view(np.int64)
                # what repeats within the slice is settled here; one row of it goes on
                order = np.lexsort((s_, th_, d_, dg, g_))
                same = np.append((g_[order][1:] == g_[order][:-1]) & (dg[order][1:] == dg[order][:-1]), False)
                known, multi = np.zeros(len(s_), bool), np.zeros(len(s_), bool)
                known[order[1:]] = same[:-1]
                multi[order] = same & ~known[order]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d_, th_, s_, m, g_, dg, known, multi)],
                                                 names=["d", "th", "s", "m", "g", "digest", "known", "multi"])

    return rows.select("d", "th", "text").mapInArrow(make, RUNS)


def marks(found: DataFrame, keep: str) -> DataFrame:
    """Of runs sorted by (known, g, digest, place): ``copy`` rows repeat as a whole; the others are one row for each kind
    of run of an anchor with several kinds, ``single`` if the kind occurs once. State: two rows, however large a group is."""
    names = ["g", "digest", "d", "th", "s", "m", "multi", "known"]

    def make(batches):
        tail = np.zeros((7, 0), np.int64)   # the last row, not yet judged
        prev = None                         # (g, digest) of the row before it
        head = None                         # first row of the anchor's first kind, and whether it occurs once; not yet emitted

        def out(rows, copy, single):
            return pa.RecordBatch.from_arrays([pa.array(rows[i]) for i in (0, 2, 3, 4, 5)] + [
                pa.array(np.full(rows.shape[1], copy)), pa.array(single)], names=["g", "d", "th", "s", "m", "copy", "single"])

        def judge(x, last):
            """Judge all rows but the last one, or all."""
            nonlocal prev, head
            n = x.shape[1] - (0 if last else 1)
            if n <= 0:
                return
            g, dg = x[0], x[1]
            before_g = np.concatenate([[prev is not None and prev[0] == g[0]], g[1:] == g[:-1]])
            before = np.concatenate([[prev is not None and prev == (g[0], dg[0])], (g[1:] == g[:-1]) & (dg[1:] == dg[:-1])])
            after = np.append(before[1:], False) | (x[6] > 0)
            copies = (before | after)[:n] if keep == "none" else before[:n]
            if copies.any():
                yield out(x[:, :n][:, copies], True, np.zeros(int(copies.sum()), bool))
            kind = np.flatnonzero(~before[:n])         # first rows of their kind
            later = kind[before_g[kind]]               # second and later kinds of their anchor
            if len(later):
                yield out(x[:, later], False, ~after[later])
                firsts = kind[~before_g[kind]]
                # the first kind of an anchor is emitted when a second one follows it
                pos = np.searchsorted(firsts, later, "right") - 1
                if head is not None and (pos < 0).any():
                    yield out(head[0], False, np.array([head[1]]))
                    head = None
                mine = np.unique(firsts[pos[pos >= 0]])
                if len(mine):
                    yield out(x[:, mine], False, ~after[mine])
            firsts = kind[~before_g[kind]]
            if len(firsts):
                i = firsts[-1]
                emitted = len(later) and later[-1] > i
                head = None if emitted else (x[:, i:i + 1].copy(), bool(~after[i]))
            prev = (int(g[n - 1]), int(dg[n - 1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)])
            known = batch.column(7).to_numpy(zero_copy_only=False)
            if known.any():
                yield out(new[:, known], True, np.zeros(int(known.sum()), bool))
                new = new[:, ~known]
            x = np.concatenate([tail, new], axis=1)
            if x.shape[1]:
                yield from judge(x, False)
                tail = x[:, -1:].copy()
        if tail.shape[1]:
            yield from judge(tail, True)

    return found.select(*names).mapInArrow(make, MARKS)


def contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs."""
    per_doc = wanted.groupBy(F.col("d").alias("wd"), F.col("th").alias("wth")).agg(
        F.collect_list(F.struct("g", "s", "m", "single")).alias("runs"))
    joined = rows.join(per_doc, (F.col("d") == F.col("wd")) & (F.col("th") == F.col("wth"))).select("d", "th", "text", "runs")

    def make(batches):
        for batch in batches:
            d, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = [[] for _ in range(7)]
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                data = text.encode()
                for r in own:
                    for col, v in zip(got, (r["g"], d[i], th[i], r["s"], r["m"], r["single"], data[r["s"]:r["s"] + r["m"] + length - 1])):
                        col.append(v)
                if len(got[0]) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pydict(dict(zip(_CTX, got)), schema=_ctx_schema())
                    got = [[] for _ in range(7)]
            yield pa.RecordBatch.from_pydict(dict(zip(_CTX, got)), schema=_ctx_schema())

    return joined.mapInArrow(make, CONTEXTS)


_CTX = ["g", "d", "th", "s", "m", "single", "bytes"]


def _ctx_schema():
    return pa.schema([(c, pa.int64()) for c in _CTX[:5]] + [("single", pa.bool_()), ("bytes", pa.binary())])


def _starts_batch(d, th, lo, hi):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (d, th, lo, hi)], names=["d", "th", "lo", "hi"])


def factor_starts(ctx: DataFrame, length: int, keep: str) -> DataFrame:
    """Window starts with a longest previous (or next) factor of ``length``, as ranges (d, th, lo, hi)."""
    def settle(batch):
        data, m = batch.column(6).to_pylist(), np.asarray(batch.column(4))
        d, th, s = (np.asarray(batch.column(i)) for i in (1, 2, 3))
        single = batch.column(5).to_numpy(zero_copy_only=False)
        c, at, before, after = repeated_starts(np.asarray(batch.column(0)), data, m, length)
        flag = before | (after & single[c]) if keep == "none" else before
        if keep == "none":
            flag &= single[c]  # the other kinds are removed whole already
        c, lo, hi = _runs_of(flag, c, at)
        return _starts_batch(d[c], th[c], s[c] + lo, s[c] + hi)

    def make(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < SLICE_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            whole = table[0] if len(table) == 1 else pa.Table.from_batches(table).to_batches()[0]
            g = np.asarray(whole.column(0))
            last = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if last:
                yield settle(whole.slice(0, last))
            held, size = [whole.slice(last)], whole.slice(last).nbytes
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    by_group = ctx.repartition(F.col("g")).sortWithinPartitions("g", "d", "th", "s").select(*_CTX)
    return by_group.mapInArrow(make, STARTS)


def counted_starts(ctx: DataFrame, length: int, keep: str) -> DataFrame:
    """The same for groups too large to gather: windows counted by 128-bit hash."""
    def make(batches):
        for batch in batches:
            d, th, s, m = (np.asarray(batch.column(i)) for i in (1, 2, 3, 4))
            single = batch.column(5).to_numpy(zero_copy_only=False)
            data = batch.column(6).to_pylist()
            for i in range(0, len(data), 2000):
                part = data[i:i + 2000]
                buf = np.frombuffer(b"".join(part), np.uint8)
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                n = m[i:i + 2000]
                ctx_of = np.repeat(np.arange(len(part)), n)
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                place = at + (np.cumsum(sizes) - sizes)[ctx_of]
                half = length // 2
                sums = bytehash.prefix_sums(buf)
                h = bytehash.span_hash(sums, place, place + length).view(np.int64)
                h2 = bytehash.span_hash(sums, place + half, place + length).view(np.int64)
                j = ctx_of + i
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, h2, d[j], th[j], s[j] + at, single[j])],
                                                 names=["h", "h2", "d", "th", "s", "single"])

    wins = ctx.select(*_CTX).mapInArrow(make, "h long, h2 long, d long, th long, s long, single boolean")
    many = wins.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "th", "s")).alias("first")).filter("n > 1")
    hit = wins.join(many, ["h", "h2"])
    hit = hit.filter("single") if keep == "none" else hit.filter(F.struct("d", "th", "s") != F.col("first"))
    return hit.select("d", "th", F.col("s").alias("lo"), F.col("s").alias("hi"))


def removed_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none",
                   group_max: int = GROUP_MAX) -> DataFrame:
    """Ranges of window starts to remove: d (doc_id), th (hash of the text), lo, hi."""
    if keep not in ("none", "first") or not 0 < gram < length or length - gram + 1 > 256:
        raise ValueError("keep is 'none' or 'first'; gram < length < gram + 256")
    rows = _keyed(docs)
    order = ["known", "g", "digest", "d", "th", "s"]
    deal = F.when(F.col("known"), F.xxhash64("d", "s")).otherwise(F.col("g"))  # settled rows go anywhere
    found = runs(rows, length, gram).repartition(deal).sortWithinPartitions(*order)
    marked = stored(marks(found, keep), "lpf-marks")
    wanted = marked.filter(~F.col("copy"))
    large = wanted.groupBy(F.col("g").alias("lg")).agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > group_max)
    ctx = contexts(rows, wanted, length)
    whole = marked.filter("copy").select("d", "th", F.col("s").alias("lo"), (F.col("s") + F.col("m") - 1).alias("hi"))
    if large.isEmpty():
        return whole.unionByName(factor_starts(ctx, length, keep))
    ctx = stored(ctx, "lpf-contexts")
    small = ctx.join(large, F.col("g") == F.col("lg"), "left_anti")
    big = ctx.join(large, F.col("g") == F.col("lg"), "left_semi")
    return whole.unionByName(factor_starts(small, length, keep)).unionByName(counted_starts(big, length, keep))


def kept_bytes(data: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """The bytes left, the number removed and the number of maximal removed runs."""
    spans: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), sum(b - a for a, b in spans), len(spans)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none", group_max: int = GROUP_MAX) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of ``docs`` (doc_id, text)."""
    return _finished(docs, removed_starts(docs, length, gram, keep, group_max), length, False)


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    return _finished(docs, removed_starts(docs, length, gram), length, True)


def _finished(docs: DataFrame, starts: DataFrame, length: int, digest: bool) -> DataFrame:
    per_doc = starts.groupBy(F.col("d").alias("wd"), F.col("th").alias("wth")).agg(
        F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = _keyed(docs).join(per_doc, (F.col("d") == F.col("wd")) & (F.col("th") == F.col("wth")), "left").select(
        "doc_id", "text", "ranges")
    kept = ("kept_sha256", "string") if digest else ("kept", "binary")

    def make(batches):
        for batch in batches:
            n, removed, spans, out = [], [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                left, r, k = kept_bytes(data, [(x["lo"], x["hi"]) for x in ranges or ()], length)
                n.append(len(data))
                removed.append(r)
                spans.append(k)
                out.append(hashlib.sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(out, pa.string() if digest else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", kept[0]])

    return joined.mapInArrow(make, f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept[0]} {kept[1]}")
