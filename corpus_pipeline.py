"""A corpus pipeline: each stage works on all documents that the one before it kept, written and read again between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklens.llm import decontamination, jaccard, mixing, sharding, toxicity
from tracklens.llm.base import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 the one with the smallest doc_id stays."""
    return jaccard.deduplicated(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to twice, so that sources near the tempered weights.

    A stage returns the columns of documents, so the place of each draw in the mixture (``mixing.mix``) isn't kept, and the
    next stage keeps equal texts together: within a shard it is up to the reader to shuffle.
    """
    return mixing.mixed_documents(docs, repeats=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every drawn document."""
    return sharding.contract(sharding.assign_shards(docs, 16))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages learn, iterate and cut in ways that SQL can't express. The tests compare each on its own input: toxicity with a
#: plain search of the learned lexicon, near copies with all pairs, decontamination with op5's SQL and every alignment,
#: mixing with budgets in closed form, sharding with a plain minimax.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
