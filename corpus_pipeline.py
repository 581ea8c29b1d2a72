"""The corpus pipeline: STAGES over ``documents``, each one of the operators of risklib.llm."""

from __future__ import annotations

from risklib.llm.bagminhash import keep_one
from risklib.llm.common import bounded_batches, documents, stored
from risklib.llm.crf_language import keep_identified
from risklib.llm.raking import keep_sampled
from risklib.llm.shard_tree import shard_documents
from risklib.llm.simhash_decontam import keep_clean


def identify_language(spark, docs, sf_dir):
    """Operator 1: documents without a letter, or without one main language, go."""
    bounded_batches(spark)
    return keep_identified(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """Operator 7: the smallest doc_id of every near-duplicate class stays."""
    bounded_batches(spark)
    return keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Operator 8: documents that hold a benchmark item go."""
    bounded_batches(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    """Operator 5: documents are sampled with probabilities raked to source, language and topic targets."""
    return keep_sampled(docs)


def assign_shards(spark, docs, sf_dir):
    """Operator 4: every document that is left gets its shard and slot."""
    return shard_documents(docs)


#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix_sources), ("sharding", assign_shards)]
#: Learned and hashed stages have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages in order, each on the written rows of the one before."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
