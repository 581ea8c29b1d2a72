"""Operators 2, 4, 5, 6 and 10 against brute-force versions on small fixtures."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from risklib.llm import licences, line_dedup, quality_rules, raking, shard_tree
from tests.llm import fixtures as fx

WS = " \t\n\x0b\x0c\r"


def brute_stats(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    c = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(WS)]
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit))


REPEATS = ["a b c a b c", "a a a a a", "a b c d a b c", "x", "a b", "", "a b a b a b q a b", "l1\nl1\n\n \nl1", "<a> | b & $5 #1 <a> | b"]


def test_statistics_match_brute_force(spark):
    docs = fx.documents(spark, 9, extra=[(100 + i, t, "en", "s", 1) for i, t in enumerate(REPEATS)]).union(fx.awkward(spark))
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = collections.Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]))
                              for r in quality_rules.statistics(fx.with_clashes(docs)).collect())
    assert set(got) == {(d, brute_stats(t)) for d, t in texts}
    assert sum(got.values()) == docs.count()


def test_decision_list_learns_and_emits_ordered_conditions(spark):
    good = fx.documents(spark, 120)
    bad = spark.createDataFrame([(1000 + i, " ".join(f"W{i}{j}Q!!" for j in range(70)), "en", "s", 1) for i in range(80)], fx.SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(1000 + i, 0) for i in range(60)] + [(5, None)],
                                   "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_rules.judge(good.union(bad), labels).collect()}
    assert all(not out[1000 + i]["kept"] for i in range(80))
    assert sum(out[i]["kept"] for i in range(120)) >= 118
    assert all(not r["kept"] for r in out.values() if r["base_failed"])


def test_quality_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.judge(fx.documents(spark, 6), none).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in out) and len(out) == 6
    assert quality_rules.judge(fx.empty(spark), none).count() == 0


def brute_shard(key, tree):
    def draw(path, w):
        u = (int(hashlib.md5(f"{path}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return -math.log(u) / w

    def pick(path, kids):
        return min(range(len(kids)), key=lambda i: (draw(f"{path}/{kids[i][0]}", kids[i][1]), i))

    regions = {}
    for x in tree:
        if x.weight > 0:
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    rs = list(regions)
    r = rs[pick("", [(n, sum(x.weight for v in regions[n].values() for x in v)) for n in rs])]
    ks = list(regions[r])
    k = ks[pick(r, [(n, sum(x.weight for x in regions[r][n])) for n in ks])]
    leaves = regions[r][k]
    return leaves[pick(f"{r}/{k}", [(str(x.shard), x.weight) for x in leaves])].shard


def test_shards_match_brute_force(spark):
    docs = fx.documents(spark, 80).union(fx.awkward(spark))
    tree = shard_tree.even_tree()
    out = shard_tree.shard_documents(fx.with_clashes(docs)).collect()
    assert len(out) == docs.count()
    slots = collections.defaultdict(list)
    for r in out:
        key = "<null>" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == brute_shard(key, tree)
        assert r["grown_shard"] == brute_shard(key, shard_tree.grown(tree))
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in docs.collect())
    assert sorted((r["text_crc32"], r["size"]) for r in out) == want
    assert shard_tree.shard_documents(fx.empty(spark)).count() == 0


def test_changed_weight_moves_only_into_or_out_of_its_subtree(spark):
    tree = shard_tree.even_tree(12, 3, 2)
    heavy = [shard_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    region = {x.shard: x.region for x in tree}
    ids = [(str(i), brute_shard(str(i), tree), brute_shard(str(i), heavy)) for i in range(4000)]
    moved = [(a, b) for _, a, b in ids if a != b]
    assert moved
    # the weight grew: every move ends in the region of shard 5, and within that region only shard 5 gains
    assert all(region[b] == region[5] for _, b in moved)
    assert all(b == 5 for a, b in moved if region[a] == region[5] and tree[a].rack == tree[5].rack)
    share = sum(b == 5 for _, _, b in ids) / len(ids)
    assert abs(share - 3 / 14) < 0.03


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WS))
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(d)
    bad = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad or bad[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_matches_brute_force(spark):
    shared = "This very common line has more than forty code points é."
    rows = [(i, f"{shared}\nown {i}\n  {shared.upper() if i % 2 else shared}\t\nend", "en", "s", 1) for i in range(200, 212)]
    rows += [(300 + i, "short\n" + "\n".join(f"line number {j} is long enough to count as a key" for j in range(i * 70)), "en", "s", 1) for i in range(7)]
    rows += [(400, shared + "\n" + shared, "en", "s", 1), (400, shared + "\n" + shared, "en", "s", 1), (None, shared, "en", "s", 1)]
    docs = fx.documents(spark, 5, extra=rows).union(fx.awkward(spark))
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(fx.with_clashes(docs))).collect()
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out), key=repr)
    assert got == sorted(brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    assert line_dedup.apply_bitmaps(fx.empty(spark), line_dedup.keep_bitmaps(fx.empty(spark))).count() == 0


def test_raking_meets_the_targets(spark):
    docs = fx.documents(spark, 240)
    rows, cells = raking.sampling(docs, sweeps=24)
    fit = raking.rake(rows.groupBy(*raking.MARGINS).agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n"),
                      {m: spark.createDataFrame([(x[0], 1.0) for x in rows.select(m).distinct().collect()], f"{m} string, target double")
                       for m in ("source", "lang")}, 24).toPandas()
    total = fit.n.sum()
    for m in ("source", "lang"):
        g = fit.groupby(m).fitted.sum()
        assert all(abs(v - total / len(g)) < 1e-6 * total for v in g)
    p = {tuple(r[:3]): r["p"] for r in cells.select(*raking.MARGINS, "p").collect()}
    assert max(p.values()) == pytest.approx(1.0) and min(p.values()) > 0
    assert raking.mix_documents(docs).count() == 240


def test_one_rare_row_barely_changes_the_kept_share(spark):
    docs = fx.documents(spark, 240)
    rare = docs.union(spark.createDataFrame([(9000, "just twelve words that no other row of this table has at all", None, "src0", 1)],
                                            fx.SCHEMA))
    share, residual = [], []
    for d in (docs, rare):
        out = raking.mix_documents(d).toPandas()
        share.append(out.p.sum() / len(out))
        residual.append(raking.sampling(d)[1].first()["residual"])
    assert out[out.doc_id == 9000].p.item() == 1
    assert abs(share[0] - share[1]) < 0.01
    assert residual[0] < 1e-9 and residual[1] < 0.002


def test_targets_of_sparse_cells_are_met(spark):
    cells = [("a", "x", 1000), ("a", "y", 1), ("b", "y", 1000), ("b", "z", 1), ("c", "z", 1000), ("c", "x", 1)]
    cells = spark.createDataFrame(cells, "source string, lang string, n long")
    want = {"source": {"a": 0.34, "b": 0.33, "c": 0.33}, "lang": {"x": 0.32, "y": 0.34, "z": 0.34}}
    fit = raking.rake(cells, {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in want.items()}).toPandas()
    for m, t in want.items():
        got = fit.groupby(m).fitted.sum() / fit.fitted.sum()
        assert all(abs(got[k] - v) < 1e-6 for k, v in t.items())


def test_raking_edges(spark):
    docs = fx.awkward(spark)
    out = raking.mix_documents(fx.with_clashes(docs)).collect()
    assert len(out) == docs.count()
    assert all(not r["kept"] and r["p"] == 0 for r in out if r["n_tokens"] == 0)
    kept = raking.keep_sampled(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)
    assert raking.mix_documents(fx.empty(spark)).count() == 0 and raking.keep_sampled(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("text, want, status", [
    ("Released under the MIT License.", ["MIT"], "known"),
    ("Some text.\nLicensed under the Apache License, Version 2.0.\nMore text", ["Apache-2.0"], "known"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with"
     " the License.\nYou may obtain a copy of the License at", ["Apache-2.0"], "known"),
    ("Words | words.\nThis work is licensed under the GNU General Public License,\nversion 3.\nwords", ["GPL-3.0-only"], "known"),
    ("All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted"
     " provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,"
     " this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright"
     " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with"
     " the distribution.", ["BSD-2-Clause"], "known"),
    ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], "known"),
    ("This file is licensed under the Foo Terms.", [], "unknown"),
    ("Nothing here about it.", [], "none"), ("", [], "none"), (None, [], "none"),
])
def test_licence_rules(spark, text, want, status):
    r = licences.scan(spark.createDataFrame([(1, text, "en", "s", 1)], fx.SCHEMA)).first()
    assert list(r["licenses"]) == want and r["status"] == status


#: Sentences whose original wording has marks or signs that normalising removes; the others are as they are listed.
WORDINGS = {
    "SpdxApache": ["SPDX-License-Identifier: Apache-2.0"], "SpdxMit": ["// SPDX-License-Identifier: MIT"],
    "SpdxGpl3": ["SPDX-License-Identifier: GPL-3.0-only"], "SpdxGpl3Later": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "Mpl2Ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Gpl3Grant": ["This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public"
                  " License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later"
                  " version."],
    "Gpl2Grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
                  " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later"
                  " version."],
    "GplWarranty": ["This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied"
                    " warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
}


def test_every_known_sentence_is_found_in_its_wording(spark):
    cases = [(k, t) for k, ts in WORDINGS.items() for t in ts]
    cases += [(k, s.capitalize() + ".") for s, k in licences.SENTENCES.items()]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, (_, t) in enumerate(cases)], fx.SCHEMA)
    got = {r["doc_id"]: list(r["sentence_ids"]) for r in licences.scan(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [[k] for k, _ in cases]
    assert set(licences.SENTENCES.values()) >= set(WORDINGS)


@pytest.mark.parametrize("text, want, status", [
    ("SPDX-License-Identifier: MIT", ["MIT"], "known"),
    ("SPDX-License-Identifier: GPL-3.0-or-later\ncode", ["GPL-3.0-or-later"], "known"),
    ("SPDX-License-Identifier: Foo-1.0", [], "unknown"),
    ("This file is licensed\n# under the Foo Terms.", [], "unknown"),
    ("This work is licensed\nunder the GNU General Public License, version 3.", ["GPL-3.0-only"], "known"),
])
def test_marks_inside_and_broken_hints(spark, text, want, status):
    r = licences.scan(spark.createDataFrame([(1, text, "en", "s", 1)], fx.SCHEMA)).first()
    assert list(r["licenses"]) == want and r["status"] == status


def test_licence_edges(spark):
    docs = fx.awkward(spark)
    assert licences.scan(fx.with_clashes(docs)).count() == docs.count()
    assert licences.scan(fx.empty(spark)).count() == 0
