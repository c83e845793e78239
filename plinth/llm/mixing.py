"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture. Its mean repetition rate is
``share * budget / size``; every document draws its own copy count by
inverting a Poisson distribution at a uniform number hashed from its id and
a seed, so the draw needs no coordination, repeats exactly after a lost
executor, and meets the rate in expectation for every source. Documents are
exploded by their counts and shuffled globally by a hashed key.

Defined cases: null and empty texts weigh their 8-byte overhead; a null
source is a source of its own; repeated rows draw alike; sources without a
target weight (or with weight 0) leave the mixture; a very long text weighs
its bytes and is copied whole; an empty table gives no rows. Extra columns pass through; input columns named like the added ones
are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.sizes import bounded
from plinth.session import materialize

#: Rates above this are drawn as a sum of independent Poisson numbers of at most this mean, which keeps exp(-rate) far from underflow.
CHUNK = 32.0
ADDED = ("rate", "n_copies", "copy_no", "shuffle_key")


def _uniform(key: list[Column], seed: int) -> Column:
    """A number in [0, 1) from 53 hashed bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / F.lit(float(1 << 53))


def _inverse_poisson(u: Column, rate: Column) -> Column:
    """The least k whose cumulative probability exceeds ``u``; the term count covers every u below 1 - 2**-53."""
    terms = F.ceil(rate + 12.0 * F.sqrt(rate) + 24.0).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))
    step = lambda acc, i: F.struct((acc.p * rate / i).alias("p"), (acc.cdf + acc.p * rate / i).alias("cdf"), (acc.k + (acc.cdf <= u).cast("int")).alias("k"))
    return F.when(rate <= 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc.k))


def poisson_count(key: list[Column], rate: Column, seed: int) -> Column:
    """A hash-seeded Poisson number with mean ``rate`` of any size."""
    parts = F.greatest(F.lit(1), F.ceil(rate / CHUNK).cast("int"))
    draw = lambda i: _inverse_poisson(_uniform([*key, i], seed), rate / parts)
    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, x: a + x)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, temperature: float = 0.5) -> DataFrame:
    """(source, bytes, target, rate) of each source.

    Without explicit ``weights`` a source's target is its size to the power
    ``temperature``, normalised. The budget is ``epochs`` times the corpus.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8).cast("double").alias("bytes"))
    if weights is None:
        raw = F.pow(F.col("bytes"), F.lit(float(temperature)))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    sizes = materialize(sizes.withColumn("raw", raw), "mix-sizes")
    total = sizes.agg(F.sum("bytes").alias("bytes"), F.sum("raw").alias("raw")).first()
    if not total.bytes or not total.raw or not math.isfinite(total.raw):
        return sizes.select("source", "bytes", F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"))
    target = F.col("raw") / F.lit(total.raw)
    return sizes.select("source", "bytes", target.alias("target"), (target * F.lit(total.bytes * epochs) / F.col("bytes")).alias("rate"))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 20) -> DataFrame:
    """Every row of ``docs`` as often as its draw says, with its rate, count and copy number."""
    docs = docs.drop(*ADDED)
    side = bounded(rates.select("source", "rate"))
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("from"), *(c.alias(f"key{k}") for k, c in enumerate(identity)))
    joined = rows.join(side, rows["from"].eqNullSafe(side["source"]))
    counted = joined.withColumn("n_copies", poisson_count([F.col("key0"), F.col("key1")], F.col("rate"), seed)).filter("n_copies > 0")
    return counted.select("row.*", "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))


def shuffled(copies: DataFrame, seed: int = 21) -> DataFrame:
    """Global shuffle: a hashed key deals copies to partitions at random and orders each partition."""
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy_no"), F.col("text")))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, temperature: float = 0.5, seed: int = 20) -> DataFrame:
    return shuffled(replicate(docs, source_rates(docs, weights, epochs, temperature), seed), seed + 1)
