"""Operators 11 to 13 against brute-force versions, exact round trips and dense linear algebra."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from risklib.llm import dac_tokens, merkle_manifest, whitening
from risklib.session import scratch_path
from tests.llm import fixtures as fx

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, add=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + add, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fanout=2):
    """Root and, per node, the (left, right) siblings level by level."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, owns = [], []
        for i in range(0, len(level), fanout):
            run = level[i:i + fanout]
            for k in range(len(run)):
                for o in owners[i + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            owns.append([o for group in owners[i:i + fanout] for o in group])
        level, owners = up, owns
    return level[0], paths


def plain_manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        members = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees.append((members, *plain_tree([plain_leaf(r) for r in members])))
    root, above = plain_tree([t[1] for t in trees])
    out = collections.Counter()
    for (members, subroot, paths), up in zip(trees, above):
        for r, path in zip(members, paths):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = plain_leaf(r, 1 if hit else 0)
            for left, right in path + up:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in path + up))
            out[(r["doc_id"], plain_leaf(r), subroot, root, proof, folded, folded == root)] += 1
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 301])
def test_manifest_equals_the_plain_tree(spark, n):
    docs = fx.documents(spark, n) if n else fx.documents(spark, 1).filter("doc_id < 0").union(fx.awkward(spark))
    if n == 40:
        docs = docs.union(fx.awkward(spark)).union(fx.awkward(spark).filter("doc_id = 4"))
    got = collections.Counter(tuple(r[c] for c in MANIFEST) for r in merkle_manifest.verified_manifest(fx.with_clashes(docs)).collect())
    assert got == plain_manifest(docs.collect())


def test_manifest_of_many_groups_and_an_empty_table(spark):
    docs = fx.documents(spark, 70).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 23).cast("string")))
    got = collections.Counter(tuple(r[c] for c in MANIFEST) for r in merkle_manifest.verified_manifest(docs).collect())
    assert got == plain_manifest(docs.collect())
    none = merkle_manifest.verified_manifest(fx.empty(spark))
    assert none.columns == MANIFEST and none.count() == 0


@pytest.mark.parametrize("fanout", [2, 3, 5, 20])
def test_any_fanout(spark, fanout):
    docs = fx.documents(spark, 61).withColumn("lang", F.lit("x"))
    out = merkle_manifest.manifest(docs, fanout=fanout).select("*", merkle_manifest.folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    root, paths = plain_tree([plain_leaf(r) for r in sorted(docs.collect(), key=lambda r: r["doc_id"])], fanout)
    assert {r["root"] for r in out} == {root} == {r["f"] for r in out}
    for r, path in zip(sorted(out, key=lambda r: r["doc_id"]), paths):
        assert [(e["left"], e["right"]) for e in r["path"]] == path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=1200), max_size=6))
def test_codes_round_trip_and_random_access(docs):
    keys = [None if i == 2 else i * 3 - 4 for i in range(len(docs))]
    f = dac_tokens.DacFile(dac_tokens.pack_file(keys, [np.array(d, np.uint32) for d in docs]))
    flat = [i for d in docs for i in d]
    at = 0
    for k, d in enumerate(docs):
        key, start, ids = f.document(k)
        assert (key, start, ids.tolist()) == (keys[k], at, d)
        at += len(d)
    rng = random.Random(len(flat))
    for i in rng.sample(range(len(flat)), min(len(flat), 60)):
        assert f.id_at(i) == flat[i]
    with pytest.raises(IndexError):
        f.id_at(len(flat))


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sTdLl<|endoftext|>19éÉ́ 　\x1c\x85ΣΟς")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_piece_ids_equal_the_library(word_library, text):
    with open(WORDS, encoding="utf-8") as f:
        encode = _encoder(f.read())
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids


_ENCODERS = {}


def _encoder(spec):
    if "e" not in _ENCODERS:
        _ENCODERS["e"] = dac_tokens.text_encoder(spec)
    return _ENCODERS["e"]


def test_pieces_only_where_white_space_is_dropped():
    with open(WORDS, encoding="utf-8") as f:
        assert dac_tokens.spaces_separate(json.load(f))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert not dac_tokens.spaces_separate(json.load(f))


def plain_files(docs, library, end=1):
    rows = []
    for r in docs:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4")
        rows.append((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(ids.tobytes()), ids))
    at, out, flat = 0, collections.Counter(), []
    for known, key, crc, ids in sorted(rows, key=lambda r: r[:3]):
        out[(key if known else None, at, len(ids), crc)] += 1
        flat += ids.tolist()
        at += len(ids)
    return out, flat


@pytest.mark.parametrize("file_ids", [1 << 18, 500])
def test_token_files_equal_the_library(spark, word_library, file_ids):
    docs = fx.documents(spark, 60).union(fx.awkward(spark)).repartition(5)
    path = scratch_path(spark, "dac-test")
    dac_tokens.write_files(fx.with_clashes(docs), path, WORDS, file_ids=file_ids)
    want, flat = plain_files(docs.collect(), word_library)
    got = dac_tokens.read_documents(spark, path, with_ids=True).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert all(flat[r["start"]:r["start"] + r["n_tokens"]] == r["ids"] for r in got)
    places = [0, 5, len(flat) - 1, len(flat) // 2, len(flat) // 2, -1, len(flat), None]
    asked = spark.createDataFrame([(p,) for p in places], "place long")
    found = {r["place"]: r["id"] for r in dac_tokens.ids_at(spark, path, asked).collect()}
    assert found == {p: flat[p] if p is not None and 0 <= p < len(flat) else None for p in places}


def test_token_files_of_an_empty_table_and_other_vocabularies(spark):
    from tokenizers import Tokenizer
    assert dac_tokens.round_trip(fx.empty(spark), WORDS).count() == 0
    docs = fx.documents(spark, 12)
    other = P.path("byte_bpe_50k.json")
    want, _ = plain_files(docs.collect(), Tokenizer.from_file(other))
    got = dac_tokens.round_trip(docs, other).collect()
    assert collections.Counter(tuple(r) for r in got) == want


def dense(rows):
    """Whole vectors, their places, n, sums and covariance of the distinct ones."""
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in ok])).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    c = u - u.sum(axis=0) / len(u)
    return ok, x, len(u), u.sum(axis=0), c.T @ c / len(u)


def check_whitening(out, rows, atol=1e-8):
    ok, x, n, s, v = dense(rows)
    k = min(16, x.shape[1])
    low, vectors = np.linalg.eigh(v)
    low, vectors = low[::-1], vectors[:, ::-1]
    assert len(out) == len(ok) * k
    assert sorted((i if i is not None else -9) for i, _ in ok for _ in range(k)) == sorted((r["vec_id"] if r["vec_id"] is not None else -9) for r in out)
    assert {r["n"] for r in out} == {n} and all(r["identity_error"] <= 1e-4 for r in out)
    z = (x - s / n) @ vectors[:, :k] / np.sqrt(low[:k])
    deviation = ((n * x - s) ** 2).sum(axis=1)
    got = {(r["vec_id"], r["component"]): r for r in out}
    mine = np.array([[got[i, c + 1]["whitened"] for c in range(k)] for i, _ in ok])
    sign = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * sign - z).max() < atol
    assert all(got[i, 1]["deviation"] == d for (i, _), d in zip(ok, deviation.tolist()))
    assert np.allclose([got[ok[0][0], c + 1]["explained"] for c in range(k)], low[:k] / np.trace(v), rtol=1e-9)


VECTORS = "vec_id long, embedding array<float>"


def test_whitening_equals_dense_algebra(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24)) * 2 + 5
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(m)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a vector that repeats
    bad = [(5000, None), (5001, [1.0] * 23 + [None]), (5002, [float("nan")] + [1.0] * 23), (5003, [float("inf")] * 24),
           (5004, [1.0, 2.0]), (5005, []), (5006, [3e38] * 24)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(6)
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("x", "n", "i", "row", "dim", "s", "component", "label")])
    check_whitening(whitening.whiten(extra).collect(), rows)


def test_whitening_of_few_vectors_and_empty_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (None, [0.5, 1.0])], VECTORS)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], VECTORS)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in flat)


def matrix_of(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("values", [
    list(range(1, 41)), [5.0] * 20 + [1.0] * 20, [3.0 + 1e-7 * i for i in range(30)], [1e6, 1e6, 1.0, 1.0, 1e-3, 0.0],
    [2.0 + 1e-12 * i for i in range(16)] + [1.0], [4.0], [0.0, 0.0]])
def test_refined_eigenvectors_to_double_precision(values):
    v = matrix_of(values)
    low, x = whitening.eigen(v)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 5e-15
    assert np.abs(v @ x - x * low).max() / size < 5e-15 * max(1, len(v) ** 0.5)
    assert np.allclose(low, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * size * len(v))


def test_clusters_are_runs_of_small_gaps():
    found = whitening.clusters(np.array([1.0, 5.0, 1.05, 9.0, 5.02, 1.1]), 0.06)
    assert [sorted(c.tolist()) for c in found] == [[0, 2, 5], [1, 4]]


def test_wide_vectors_have_exact_or_null_deviations(spark):
    rows = [(i, [float(10 ** 8 * (i % 5)), float(i)]) for i in range(40)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    ok, x, n, s, _ = dense(rows)
    want = [int(((n * row - s.astype(object)) ** 2).sum()) for row in x.astype(object)]
    got = {r["vec_id"]: r["deviation"] for r in out}
    assert all(got[i] == (w if w < 1 << 63 else None) for (i, _), w in zip(ok, want))


def by_sql(docs, name):
    """The query's SQL over the rows of ``docs``."""
    import duckdb

    from risklib.llm.queries import oracle_sql
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.sql(oracle_sql()[name]).to_arrow_table().to_pylist()


@pytest.mark.parametrize("n", [3, 90])
def test_manifest_equals_its_sql(spark, n):
    docs = fx.documents(spark, n).union(fx.awkward(spark))
    got = [tuple(r[c] for c in MANIFEST) for r in merkle_manifest.verified_manifest(docs).collect()]
    assert collections.Counter(got) == collections.Counter(tuple(r[c] for c in MANIFEST) for r in by_sql(docs, "op11_merkle_manifest"))


def test_line_dedup_equals_its_sql(spark):
    from risklib.llm.line_dedup import apply_bitmaps, keep_bitmaps
    line = "This line of more than forty characters stands in many documents. "
    docs = fx.documents(spark, 20).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(f"\n\t{line.upper()}\r\nend")).otherwise(
        F.lit(f"\n{line}"))).alias("text"), "lang", "source", "n_chars")
    docs = docs.union(spark.createDataFrame([(100, None, "en", "s", 1), (101, "", "en", "s", 1), (102, f"{line}\n{line}", "en", "s", 1)], fx.SCHEMA))
    out = apply_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
    cols = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got = sorted(tuple(r[c] for c in cols) for r in out.collect())
    assert got == sorted(tuple(r[c] for c in cols) for r in by_sql(docs, "op10_line_dedup")) and any(r[2] for r in got)
