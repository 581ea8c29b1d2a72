"""Operator 12: token ids in directly addressable codes.

A file holds the ids of consecutive documents. An id is split into chunks of 8
bits, lowest first. Level 0 has one chunk of every id and a bitmap that says
which ids go on; level 1 has the next chunk of those, and so on. A rank
directory counts the set bits before every block of 512, so the place of id i
in the next level is rank(i): any id is read from at most one byte and one
bitmap block per level, without decoding what stands before it. The ids of a
range stand together in every level, so a document is one slice of each.

File layout (little-endian): ``DAC1``, u32 documents, u64 ids, u32 levels; i64
document keys, u8 null flags, u64 ends (ids up to and with each document); then
per level u64 chunks, the chunks, and but for the last level the bitmap in u64
words and the u64 rank directory.

Jobs: texts are tokenised where they are read (each distinct part once per
worker, see ``text_encoder``) and written as narrow rows; those are
range-partitioned by document and packed into files of about ``FILE_IDS``
ids. A document is never split, so a file holds at most that many ids and one
document more. The files are rows of a Parquet table (part, seq, start in the
part, payload), so any store that Spark reaches can hold them and tasks that
run again leave no halves. A part's first id comes from the totals of the parts before.

Cases: a null or empty text has the end id alone; null doc_ids come first;
rows with one doc_id are ordered by the checksum of their ids; a very long
text makes a long file; an empty table gives an empty result; extra columns are
ignored. doc_ids are whole numbers; ids take up to 32 bits.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklib.llm.common import stored
from risklib.session import scratch_path

MAGIC = b"DAC1"
CHUNK_BITS, BLOCK_BITS = 8, 512
FILE_IDS = 1 << 18
END_ID = 1
MEMO_PARTS, MEMO_CHARS = 300_000, 48
BROADCAST_ROWS = 1_000_000


def pack_levels(ids: np.ndarray) -> bytes:
    """The levels of ids (unsigned 32-bit)."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        on = more != 0
        if not on.any():
            levels.append(struct.pack("<Q", len(rest)) + chunks)
            return struct.pack("<I", len(levels)) + b"".join(levels)
        words = -(-len(rest) // 64)
        bits = np.packbits(on, bitorder="little")
        bitmap = np.zeros(words * 8, np.uint8)
        bitmap[:len(bits)] = bits
        per_block = np.add.reduceat(on.astype(np.uint64), np.arange(0, len(on), BLOCK_BITS))
        rank = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + chunks + bitmap.tobytes() + rank.tobytes())
        rest = more[on]


def pack_file(keys: list, parts: list[np.ndarray]) -> bytes:
    """A file of the given documents, in their order."""
    null = np.array([k is None for k in keys], np.uint8)
    names = np.array([0 if k is None else k for k in keys], "<i8")
    ends = np.cumsum([len(p) for p in parts]).astype("<u8")
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return b"".join([MAGIC, struct.pack("<IQ", len(keys), len(ids)), names.tobytes(), null.tobytes(), ends.tobytes(), pack_levels(ids)])


class DacFile:
    """Random access to the ids of a packed file; nothing is decoded beforehand."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        n_docs, self.n_ids = struct.unpack_from("<IQ", data, 4)
        at = 16
        self.keys = np.frombuffer(data, "<i8", n_docs, at)
        self.null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.ends = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        n_levels, = struct.unpack_from("<I", data, at)
        at += 4
        self.levels = []
        for k in range(n_levels):
            n, = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bitmap = rank = None
            if k < n_levels - 1:
                n_bytes, n_ranks = -(-n // 64) * 8, -(-n // BLOCK_BITS) + 1
                bitmap = np.frombuffer(data, np.uint8, n_bytes, at)
                rank = np.frombuffer(data, "<u8", n_ranks, at + n_bytes)
                at += n_bytes + 8 * n_ranks
            self.levels.append((chunks, bitmap, rank))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i: the directory's count and the rest of one block."""
        _, bitmap, rank = self.levels[level]
        block = i // BLOCK_BITS
        head = np.unpackbits(bitmap[block * (BLOCK_BITS // 8):(i + 7) // 8], bitorder="little")[:i - block * BLOCK_BITS]
        return int(rank[block]) + int(head.sum())

    def id_at(self, i: int) -> int:
        """One id."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(k, i)
        return value

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids of places a to b - 1: one slice of each level."""
        out = np.zeros(b - a, np.uint32)
        where = None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if bitmap is None or a == b:
                break
            on = np.unpackbits(bitmap[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a].astype(bool)
            where = np.flatnonzero(on) if where is None else where[on]
            if not len(where):
                break
            a = self._rank(k, a)
            b = a + int(on.sum())
        return out

    def document(self, k: int) -> tuple[int | None, int, np.ndarray]:
        """Key, first place and ids of the k-th document."""
        a, b = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        return (None if self.null[k] else int(self.keys[k])), a, self.ids(a, b)


class _Memo(dict):
    """Values by key, computed where missing; at most ``limit`` recent ones twice over: when full, they become the older half, and
    what is used of that comes back."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > MEMO_CHARS:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def spaces_separate(spec: dict) -> bool:
    """Whether the vocabulary file drops white space before any merge, so that pieces between spaces encode on their own."""
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal])
    steps_before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split, levels = steps_before[0], steps_before[1:]
    pattern = split.get("pattern", {}).get("Regex", "")
    return (all(s.get("type") in ("NFC", "Lowercase", "Replace") for s in steps)
            and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
            and len(levels) == 1 and levels[0].get("type") == "ByteLevel" and not levels[0].get("add_prefix_space")
            and not levels[0].get("use_regex") and spec["model"].get("type") == "BPE" and "\\s" in pattern and pattern.endswith("[^\\s\\p{L}\\p{N}]+")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"]
                        for t in spec.get("added_tokens", [])))


# Characters whose class, case and composed form no Unicode version changes: Latin letters, digits, common signs.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SIGNS = "!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab-\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2013\u2014\u2018-\u201e\u2026\u20ac"
PLAIN = re.compile(f"[{_LETTERS}{_DIGITS}{_SIGNS} \\t\\n\\x0b\\x0c\\r]*")
#: The parts that the vocabulary file's pattern cuts a plain text into (fixed value: its alternatives, in their order).
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[{_SIGNS}]+")
PARTS_WITHOUT_QUOTES = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|[{_SIGNS}]+")
ODD = "\x00"  # marks a piece that goes to the library as it is; no plain part has it


def text_encoder(spec_text: str):
    """A function from texts to the library's ids as little-endian u32 bytes.

    Where the vocabulary file drops white space before merging, a token never
    spans a space or line end, and plain text falls into the parts of its pattern. Each distinct
    part goes once per worker through the library's merges. In texts with other characters, or with a special
    token's beginning, the pieces between spaces that have them go through the whole library.
    Files that keep white space get whole texts.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec_text)
    library.no_truncation()
    library.no_padding()

    def alone(text):
        return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if not spaces_separate(json.loads(spec_text)):
        return lambda texts: [alone(t) for t in texts]
    merge = library.model.tokenize
    # the byte-level stand-ins of the 256 bytes: printable ones stand for themselves
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain_bytes))
    stand_in = {b: chr(b) for b in plain_bytes} | {b: chr(256 + i) for i, b in enumerate(others)}

    def ids_of(part):
        if part[0] == ODD:
            return alone(part[1:])
        if not part.isascii():
            part = "".join([stand_in[b] for b in part.encode()])
        got = merge(part)
        return struct.pack(f"<{len(got)}I", *[t.id for t in got])

    parts = _Memo(ids_of, MEMO_PARTS)

    def plain(text):
        return "<|" not in text and PLAIN.fullmatch(text) is not None

    def cut(text):
        low = text.lower()
        return (PARTS if "'" in low else PARTS_WITHOUT_QUOTES).findall(low)

    def encode(text):
        if plain(text):
            return b"".join(map(parts.__getitem__, cut(text)))
        out = []
        for piece in text.replace("\n", " ").split(" "):
            if plain(piece):
                out += cut(piece)
            else:
                out.append(ODD + piece)
        return b"".join(map(parts.__getitem__, out))

    return lambda texts: [encode(t) for t in texts]


def squeeze(ids: np.ndarray, width: int) -> bytes:
    """Ids for the way between tasks: their byte planes, compressed."""
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint32)


def tokenised(docs: DataFrame, vocab_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, sum (checksum), tie, n, width and ids (squeezed: u16 where the vocabulary fits, else u32) of every row, end id included."""
    with open(vocab_path, encoding="utf-8") as f:
        text = f.read()
    shared = docs.sparkSession.sparkContext.broadcast({"text": text})  # the vocabulary file bounds its size
    from tokenizers import Tokenizer
    size = max([end_id, *Tokenizer.from_str(text).get_vocab(with_added_tokens=True).values()]) + 1
    width = 2 if size <= 1 << 16 else 4
    end = struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("sum", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = shared.value
        if "encode" not in state:  # one memo per worker, kept from task to task
            state["encode"] = text_encoder(state["text"])
        encode = state["encode"]
        for b in batches:
            ids = [x + end for x in encode([t or "" for t in b.column("text").to_pylist()])]
            yield pa.record_batch([
                b.column("doc_id"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), b.column("tie"),
                pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()),
                pa.array([squeeze(np.frombuffer(x, "<u4"), width) for x in ids], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tie")
                       ).mapInArrow(run, "doc_id long, sum long, tie long, n long, width int, ids binary")


def write_files(docs: DataFrame, path: str, vocab_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Tokenise ``docs`` and write the files under ``path``, in ascending doc_id order over all parts."""
    rows = stored(tokenised(docs, vocab_path, end_id), "dac-ids")  # the range bounds are sampled from this, not from the texts
    order = ["doc_id", "sum", "tie"]
    schema = pa.schema([("seq", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                        ("payload", pa.binary()), ("part", pa.int32())])

    def run(batches):
        seq = start = held = 0
        keys, parts, part = [], [], None

        def full():
            nonlocal seq, start, held, keys, parts
            out = pa.record_batch([pa.array([v], t.type) for v, t in zip(
                (seq, start, len(keys), held, pack_file(keys, parts), part), schema)], schema=schema)
            seq, start, held, keys, parts = seq + 1, start + held, 0, [], []
            return out

        for b in batches:
            for key, n, width, ids, at in zip(*[b.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "at")]):
                part = at
                more = expand(ids, n, width)
                if keys and held + len(more) > file_ids:
                    yield full()
                keys.append(key)
                parts.append(more)
                held += len(more)
        if keys:
            yield full()

    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "n", "width", "ids", F.spark_partition_id().alias("at")).mapInArrow(
        run, "seq int, start long, n_docs int, n_ids long, payload binary, part int").write.option("compression", "zstd").parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files in order: part, seq, first (ids before the file, over all parts), n_docs, n_ids, payload."""
    table = spark.read.parquet(path)
    totals = stored(table.groupBy("part").agg(F.sum("n_ids").alias("c")), "dac-parts")  # one row per partition written
    before = totals.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    small = totals.count() <= BROADCAST_ROWS
    return table.join(F.broadcast(before) if small else before, "part").select(
        "part", "seq", (F.col("before") + F.col("start")).alias("first"), "n_docs", "n_ids", "payload")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids themselves) of every document in the files under ``path``."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def run(batches):
        for b in batches:
            for payload, first in zip(b.column("payload"), b.column("first")):
                f, base = DacFile(payload.as_buffer().to_pybytes()), first.as_py()
                out = []
                for k in range(len(f.keys)):
                    key, a, ids = f.document(k)
                    out.append((key, base + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                                *([ids.astype(np.int64)] if with_ids else [])))
                yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return files(spark, path).select("payload", "first").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def ids_at(spark: SparkSession, path: str, places: DataFrame, column: str = "place") -> DataFrame:
    """place, id for every whole-corpus place in ``places``; each file is opened once, for its own places only.

    Places outside the corpus and null places have a null id. Files and places
    meet by the file that a place falls in: both are dealt by ranges of
    ``file_ids`` places, a file standing in every range it touches.
    """
    span = FILE_IDS
    index = files(spark, path).select("part", "seq", "first", "n_ids")
    cells = index.select("part", "seq", "first", "n_ids", F.explode(F.sequence(
        F.expr(f"first div {span}"), F.expr(f"(first + greatest(n_ids, 1) - 1) div {span}"))).alias("cell"))
    asked = places.select(F.col(column).cast("long").alias("place")).distinct()
    at = asked.withColumn("cell", F.expr(f"place div {span}")).join(cells, "cell").filter(
        (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n_ids")))
    wanted = at.groupBy("part", "seq", F.expr(f"(place - first) div {span}").alias("slice")).agg(
        F.collect_list("place").alias("places"), F.first("first").alias("first"))  # at most FILE_IDS places a slice
    schema = pa.schema([("place", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for b in batches:
            for payload, places, first in zip(b.column("payload"), b.column("places"), b.column("first")):
                f, base, ps = DacFile(payload.as_buffer().to_pybytes()), first.as_py(), places.as_py()
                yield pa.record_batch([pa.array(ps, pa.int64()), pa.array([f.id_at(p - base) for p in ps], pa.int64())], schema=schema)

    found = wanted.join(spark.read.parquet(path).select("part", "seq", "payload"), ["part", "seq"]).select(
        "payload", "places", "first").mapInArrow(run, "place long, id long")
    return asked.join(found, "place", "left")


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "dac-files")
    write_files(docs, path, vocab_path)
    return read_documents(spark, path)
