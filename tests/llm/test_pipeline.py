"""The pipeline and the registered queries against brute-force versions on a small folder of tables."""

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from risklib.llm import queries, raking
from tests.llm import fixtures as fx
from tests.llm.test_native import brute_shard
from tests.llm.test_python import brute_classes, near_copies
from risklib.llm import shard_tree


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, fx.prose(rng, "fr", 30 + i).replace("e", f"e{i}")) for i in range(6)]
    rows = near_copies(rng, 3, 6)
    rows += [(900 + i, fx.prose(rng, "en", 40) + "\n" + t + "\n" + fx.prose(rng, "en", 40), "en", "src1", 1) for i, t in items]
    rows += [(950, "12 34 55 !!", "en", "src1", 1), (951, "", "en", "src1", 1)]
    docs = fx.documents(spark, 90, extra=rows)
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 7 > 0) for i in range(90)], "doc_id long, q boolean").selectExpr(
        "doc_id", "cast(q as int) as quality", "0 as toxic").write.parquet(f"{path}/labels.parquet")
    return path, [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()], items


def brute_sampled(rows):
    """The rows kept by proportional fitting of the tempered margins and the same draws."""
    def topic(t):
        n = len([w for w in re.split("[\x20\x09-\x0d]+", t) if w])
        kind = ("empty" if n == 0 else "table" if t.count("|") * 4 >= n else "shout" if t.count("!") * 2 >= n else
                "marked" if sum(c in "#*$%&<>" for c in t) >= n else "note" if n < 150 else "article" if n < 700 else "longform")
        return kind, n

    cell_of, cells = {}, {}
    for d, t, lang, source in rows:
        kind, n = topic(t)
        cell_of[d] = (source, lang, kind)
        cells[cell_of[d]] = cells.get(cell_of[d], 0) + n
    total, fit = sum(cells.values()), dict(cells)
    for _ in range(raking.SWEEPS):
        for m in range(3):
            share, now = {}, {}
            for c, n in cells.items():
                share[c[m]] = share.get(c[m], 0) + n
                now[c[m]] = now.get(c[m], 0) + fit[c]
            power = {k: v ** raking.TEMPER for k, v in share.items()}
            for c in fit:
                fit[c] *= power[c[m]] / sum(power.values()) * total / now[c[m]]
    ratio = {c: fit[c] / cells[c] for c in cells}
    top = max(ratio.values())
    draw = lambda d: (int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
    return [r for r in rows if draw(r[0]) < ratio[cell_of[r[0]]] / top]


def test_pipeline_matches_brute_force(spark, folder):
    path, rows, items = folder
    left = [r for r in rows if any(c.isalpha() for c in r[1])]
    cls = brute_classes([(d, t) for d, t, *_ in left])
    left = [r for r in left if cls[r[0]] == r[0]]
    left = [r for r in left if not any(t in r[1] for _, t in items)]
    kept = brute_sampled(left)
    assert 0 < len(kept) < len(left) < len(rows)
    out = corpus_pipeline.run(spark, path).collect()
    tree = shard_tree.even_tree()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in out) == sorted(
        (d, len(t.encode()) + 16, zlib.crc32(t.encode()), brute_shard(str(d), tree)) for d, t, *_ in kept)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op13_whitening"}))
def test_registered_query_covers_every_document(spark, folder, name):
    path, rows, _ = folder
    out = queries.queries()[name](spark, path)
    ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
    if name.startswith("op8_"):
        assert ids == [900 + i for i in range(6)]
    else:
        assert ids == sorted(r[0] for r in rows)


def test_registered_whitening_covers_every_vector(spark):
    from tests.conftest import SF0001
    ids = [r["vec_id"] for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    out = queries.queries()["op13_whitening"](spark, SF0001).groupBy("vec_id").count().collect()
    assert sorted(r["vec_id"] for r in out) == sorted(ids) and {r["count"] for r in out} == {16}


def test_names_are_those_of_the_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
