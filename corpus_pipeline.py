"""Training-corpus pipeline: each stage works on all that its predecessor kept.

Defined cases, as the operators state them: a null or empty text is scored,
links with nothing, holds no benchmark item and is placed with 8 bytes; a null
id stays through all stages and is placed by its text; of rows that repeat id
and text one stays after the n-gram join; of documents that tie, the one with
the least id stays; equal shard loads go to the lowest shard; empty tables
give empty tables, and without labels or benchmark items nothing is dropped
for them. Further columns pass through whatever their names, but for those
that the last stage adds (size, text_crc32, law, shard, slot, grown_shard,
vslot), which take the place of equally named ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontam, mixing, ngram_join, sharding, toxicity
from plinth.session import materialize


SHUFFLE_SEED = 23


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents, then drop what scores as toxic."""
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate draws, in shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, plus shard and position in it; in a slot the order stays shuffled, copies of a document apart."""
    return sharding.shard(docs, keep=tuple(docs.columns), seed=SHUFFLE_SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_group),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Model scores and hash-seeded draws are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
