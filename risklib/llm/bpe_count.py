"""Operator 3: token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol per UTF-8 byte, held in a doubly linked list.
A heap holds the rank and place of every adjacent pair that has a merge; the
lowest rank (leftmost on ties) is popped, merged, and its two new neighbour
pairs are pushed. Stale heap entries are recognised when popped. The count is
initial symbols minus merges; no token identifier is produced.

Texts are cut at single spaces between non-space characters first. There the
pre-token pattern always starts a new token, so counts of the pieces add up,
and repeated pieces are counted once per worker (a bounded memo). Texts with
other white space next to a space go through the pattern whole.

Cases: null and empty texts have 0 tokens; very long texts and pieces take
n log n steps; repeated rows and ties need nothing special; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_PIECES, MEMO_CHARS = 400_000, 48
TOKEN_LIMIT = 1024


def read_merges(path: str) -> dict:
    """Merge ranks of a byte-level BPE file: {pair key: (rank, new symbol)}, first symbols by byte, added strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the usual printable stand-ins for the 256 bytes
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    ids = spec["model"]["vocab"]
    merges = {}
    for rank, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        merges[ids[a] << 20 | ids[b]] = (rank, ids[a + b])
    return {"merges": merges, "bytes": [ids[char[b]] for b in range(256)],
            "added": [t["content"] for t in spec["added_tokens"]]}


def merged_count(data: bytes, merges: dict, first: list[int]) -> int:
    """Symbols left after all merges of one pre-token."""
    sym = [first[b] for b in data]
    n = len(sym)
    if n < 2:
        return n
    heap = []
    for i in range(n - 1):
        m = merges.get(sym[i] << 20 | sym[i + 1])
        if m is not None:
            heap.append((m[0], i, m[1]))
    if not heap:
        return n
    heapq.heapify(heap)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        rank, i, new = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] < 0 or j >= n:
            continue
        m = merges.get(sym[i] << 20 | sym[j])
        if m is None or m[0] != rank:
            continue
        sym[i], sym[j] = new, -1
        k = nxt[i] = nxt[j]
        left -= 1
        if k < n:
            prv[k] = i
            m = merges.get(new << 20 | sym[k])
            if m is not None:
                heapq.heappush(heap, (m[0], i, m[1]))
        p = prv[i]
        if p >= 0:
            m = merges.get(sym[p] << 20 | new)
            if m is not None:
                heapq.heappush(heap, (m[0], p, m[1]))
    return left


class _Memo(dict):
    """Counts by piece, at most MEMO_PIECES of them; missing ones are computed."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, piece):
        n = self.compute(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = n
        return n


def counter(spec: dict, pattern: str):
    """A function from text to number of tokens."""
    import regex

    find, merges, first = regex.compile(pattern).findall, spec["merges"], spec["bytes"]
    added = regex.compile("|".join(regex.escape(a) for a in spec["added"])) if spec["added"] else None
    token = _Memo(lambda t: merged_count(t.encode("utf-8"), merges, first))

    def spaced(piece):
        """Tokens of a space and the piece; None if white space at its ends may join the space."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return sum(map(token.__getitem__, find(" " + piece)))

    memo = _Memo(spaced)

    def whole(text):
        pieces = text.split(" ")
        if len(pieces) > 1 and pieces[0] and not pieces[0][-1].isspace():
            try:
                return sum(map(token.__getitem__, find(pieces[0]))) + sum(map(memo.__getitem__, pieces[1:]))
            except TypeError:  # a piece of None
                pass
        return sum(map(token.__getitem__, find(text)))

    def count(text):
        if not text:
            return 0
        if added is None:
            return whole(text)
        parts = added.split(text)
        return len(parts) - 1 + sum(whole(p) for p in parts if p)

    return count


def token_counts(docs: DataFrame, vocab_path: str, pattern: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(vocab_path))  # the vocabulary file bounds its size

    @F.pandas_udf("long")
    def n_tokens(batches: pd.Series) -> pd.Series:
        spec = shared.value
        if "count" not in spec:  # one memo per worker, kept from task to task
            spec["count"] = counter(spec, pattern)
        count = spec["count"]
        return pd.Series([count(t) for t in batches], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens")
                       ).select("*", (F.col("n_tokens") > limit).alias("over_limit"))
