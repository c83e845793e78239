"""Queries of this subpackage by name, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import bpe, decontam, linededup, mixing, ngram_join, oracles, ordinal, pii, quality_rules, search, sharding, toxicity, urlfilter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


#: The key of the registered query; a real corpus takes its own from a secret store.
DEMO_KEY = b"plinth surrogate demonstration key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_text(table(spark, sf_dir, "documents"), DEMO_KEY)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.train(urlfilter.seed_labels(pages)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Name of the public vocabulary file that the registered query encodes with.
VOCABULARY = "byte_bpe_50k.json"


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_line_dedup": op2_line_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_toxicity": op4_toxicity,
        "op5_url_filter": op5_url_filter,
        "op6_mixing": op6_mixing,
        "op7_quality_rules": op7_quality_rules,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_decontamination": op9_decontamination,
        "op10_sharding": op10_sharding,
        "op11_whitening": op11_whitening,
        "op12_lexical_search": op12_lexical_search,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
