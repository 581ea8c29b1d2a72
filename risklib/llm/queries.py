"""The registered queries of the thirteen operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklib.llm.common import bounded_batches, documents

def op1_crf_language(spark, sf_dir):
    from risklib.llm.crf_language import identify
    bounded_batches(spark)
    return identify(documents(spark, sf_dir))


def op2_quality_rules(spark, sf_dir):
    from risklib.llm.quality_rules import judge
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_bpe_counts(spark, sf_dir):
    import public_tokenizers

    from risklib.llm.bpe_count import token_counts
    bounded_batches(spark)
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_shard_tree(spark, sf_dir):
    from risklib.llm.shard_tree import shard_documents
    return shard_documents(documents(spark, sf_dir))


def op5_raking(spark, sf_dir):
    from risklib.llm.raking import mix_documents
    return mix_documents(documents(spark, sf_dir))


def op6_licence_rules(spark, sf_dir):
    from risklib.llm.licences import scan
    return scan(documents(spark, sf_dir)).withColumn("sentence_ids", F.concat_ws(",", "sentence_ids")).withColumn(
        "licenses", F.concat_ws(",", "licenses"))


def op7_bagminhash(spark, sf_dir):
    from risklib.llm.bagminhash import classes
    bounded_batches(spark)
    return classes(documents(spark, sf_dir))


def op8_simhash_decontamination(spark, sf_dir):
    from risklib.llm.simhash_decontam import matches
    bounded_batches(spark)
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn(
        "similarity", F.round("similarity", 6))


def op9_lpf_dedup(spark, sf_dir):
    from risklib.llm.lpf_dedup import digests
    bounded_batches(spark)
    return digests(documents(spark, sf_dir))


def op10_line_dedup(spark, sf_dir):
    from risklib.llm.line_dedup import apply_bitmaps, keep_bitmaps
    docs = documents(spark, sf_dir)
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op11_merkle_manifest(spark, sf_dir):
    from risklib.llm.merkle_manifest import verified_manifest
    return verified_manifest(documents(spark, sf_dir))


def op12_dac_tokens(spark, sf_dir):
    import public_tokenizers

    from risklib.llm.dac_tokens import round_trip
    bounded_batches(spark)
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_whitening(spark, sf_dir):
    from risklib.llm.whitening import whiten
    bounded_batches(spark)
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries():
    return {f.__name__: f for f in (op1_crf_language, op2_quality_rules, op3_bpe_counts, op4_shard_tree, op5_raking,
                                    op6_licence_rules, op7_bagminhash, op8_simhash_decontamination, op9_lpf_dedup, op10_line_dedup,
                                    op11_merkle_manifest, op12_dac_tokens, op13_whitening)}


_LINES_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, coalesce(s.last <> k.doc_id, false) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _leaf_sql(n_chars):
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _climb(name, start, nodes):
    """A recursive table that takes (row, g, level, i, n, h, proof) to the root of its group."""
    return f"""{name} AS ({start} UNION ALL
  SELECT f.row, f.g, f.level + 1, f.i // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.i % 2 = 0 THEN f.h || coalesce(t.h, '') ELSE t.h || f.h END), f.proof || coalesce(t.h, '')
  FROM {name} f LEFT JOIN {nodes} t ON t.g = f.g AND t.level = f.level AND t.i = xor(f.i, 1) WHERE f.n > 1)"""


def _levels(name, start):
    return f"""{name} AS ({start} UNION ALL
  SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, level, n, i // 2)"""


_MANIFEST_SQL = f"""WITH RECURSIVE
leaf AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + 1)')} AS other,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf),
{_levels('tree', "SELECT g, 0 AS level, i, n, leaf AS h FROM placed")},
subroot AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
{_levels('top', "SELECT '' AS g, 0 AS level, i, n, h FROM subroot")},
{_climb('low', "SELECT row, g, 0 AS level, i, n, CASE WHEN crc % 7 = 0 THEN coalesce(other, leaf) ELSE leaf END AS h, '' AS proof FROM placed", 'tree')},
{_climb('high', "SELECT low.row, '' AS g, 0 AS level, subroot.i, subroot.n, low.h, low.proof FROM low JOIN subroot ON low.g = subroot.g WHERE low.n = 1", 'top')}
SELECT doc_id, leaf, subroot.h AS subroot, top.h AS root, sha256(high.proof) AS proof_sha256, high.h AS folded_root, high.h = top.h AS verified
FROM placed JOIN high ON placed.row = high.row AND high.n = 1 JOIN subroot ON placed.g = subroot.g JOIN top ON top.n = 1"""


def oracle_sql():
    """Operators 10 and 11 need only splitting, counting and sha256; the others need hashes, learned weights or files that SQL lacks,
    or take too long there on whole tables."""
    return {"op10_line_dedup": _LINES_SQL, "op11_merkle_manifest": _MANIFEST_SQL}
