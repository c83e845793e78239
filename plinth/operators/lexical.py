"""Top-k of a lexical score over all documents by an inverted index, without meeting all pairs.

The score of a question and a document is 0.7 times the Jaccard of their word
sets plus 0.3 times the share of the question's words in the title, scaled by
``weight`` and added to the document's own ``static`` part. With o of the
question's n words in body or title it is at most

    static + weight * (0.7 * o / max(n, |body|) + 0.3 * min(o, |title|) / n),

so a document that can reach the k-th best score needs a least number of the
question's words, and must hold one of the rarest n - o + 1 of them (prefix
filter). A first pass over a few strong documents for each rare word gives
every question a k-th best score to start from; any such score is exact as a
floor, so the second pass loses nothing. Documents without any common word
matter only by ``static``; the k best of these are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.session import materialize
from plinth.sizes import bounded

#: Rarest words of a question, and documents of a word, that the first pass looks at.
SEED_WORDS = 12
SEED_DOCUMENTS = 24
#: Scores within this distance count as equal to a bound.
SLACK = 1e-7


def score(q: Column, c: Column, t: Column) -> Column:
    """0.7 Jaccard of the word sets q and c, and 0.3 of the share of q in t; one order of operations, so that plain SQL gives the same bits."""
    both = F.size(F.array_intersect(q, c)).cast("double")
    either = F.size(F.array_union(q, c)).cast("double")
    titled = F.size(F.array_intersect(q, t)).cast("double")
    n = F.greatest(F.size(q), F.lit(1)).cast("double")
    return F.when(F.size(q) == 0, 0.0).otherwise((F.lit(0.7) * both) / F.greatest(either, F.lit(1.0)) + (F.lit(0.3) * titled) / n)


def _most(o: Column) -> Column:
    """The greatest lexical score with ``o`` common words, from n, n_body and n_title."""
    return F.lit(0.7) * o / F.greatest("n", "n_body") + F.lit(0.3) * F.least(o, F.col("n_title")) / F.col("n")


def _least_words(floor: Column, weight: float) -> Column:
    """Common words that a document needs at least to reach ``floor``; 1 at least."""
    wanted = (floor - F.lit(SLACK) - F.col("static")) / F.lit(weight) - F.lit(0.3) * F.least("n", "n_title") / F.col("n")
    words = F.ceil(F.least(F.greatest(wanted, F.lit(0.0)) * F.greatest("n", "n_body") / F.lit(0.7), F.lit(1e9))).cast("int")
    return F.when(wanted > 0, F.greatest(F.lit(1), words)).otherwise(1)


def candidates(docs: DataFrame, questions: DataFrame, k: int, weight: float = 1.0) -> DataFrame:
    """(qid, sem) with all columns of ``docs`` but the word sets, for every pair that can be among a question's ``k`` best by static + weight * sem, and some more.

    ``docs``: node, words, title (arrays of distinct words), static (double) and
    others; ``questions``: qid, words. Equal scores are decided by the node.
    """
    spark = docs.sparkSession
    docs = materialize(docs, "lexical-documents", spread=True)
    questions = materialize(questions, "lexical-questions")
    asked = bounded(questions.withColumnRenamed("words", "_q"))
    terms = questions.select("qid", F.size("words").alias("n"), F.explode("words").alias("word"))
    wanted = bounded(materialize(terms.select("word").distinct(), "lexical-words"))
    sizes = [F.size("words").alias("n_body"), F.size("title").alias("n_title"), "static"]
    postings = materialize(docs.select("node", *sizes, F.explode(F.array_union("words", "title")).alias("word")).join(wanted, "word", "left_semi"), "lexical-postings", spread=True)
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("qid").orderBy("df", "word")
    terms = materialize(terms.join(df, "word").withColumn("pos", F.row_number().over(rarest)).select("qid", "n", "word", "pos"), "lexical-terms")

    strong = Window.partitionBy("word").orderBy(F.desc("static"), F.xxhash64("node"), "node")
    sought = bounded(materialize(terms.filter(F.col("pos") <= SEED_WORDS).select("word").distinct(), "lexical-seed-words"))
    seeds = postings.join(sought, "word", "left_semi").withColumn("r", F.row_number().over(strong)).filter(F.col("r") <= SEED_DOCUMENTS).select("word", "node")
    pairs = terms.filter(F.col("pos") <= SEED_WORDS).join(seeds, "word").select("qid", "node")
    alone = [r.node for r in docs.select("node", "static").orderBy(F.desc(F.round("static", 9)), "node").limit(k).collect()]
    alone = questions.select("qid", F.explode(F.array(*map(F.lit, alone)).cast(f"array<{docs.schema['node'].dataType.simpleString()}>")).alias("node"))
    first = materialize(_scored(pairs.unionByName(alone).distinct(), docs, asked), "lexical-first")
    total = F.col("static") + F.lit(weight) * F.col("sem")
    kth = Window.partitionBy("qid").orderBy(F.desc(total), "node")
    floors = first.withColumn("r", F.row_number().over(kth)).filter(F.col("r") == k).select("qid", total.alias("floor"))

    open_terms = bounded(materialize(terms.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "lexical-prefixes"))
    least = _least_words(F.col("floor"), weight)
    met = postings.join(open_terms, "word").filter(F.col("pos") <= F.col("n") - least + 1)
    grouped = met.groupBy("qid", "node", "n", "n_body", "n_title", "static", "floor").agg(F.count("*").alias("m"))
    prefix = F.col("n") - least + 1
    able = grouped.filter(F.col("static") + F.lit(weight) * _most(F.least(F.col("m") + F.col("n") - prefix, F.col("n"))) >= F.col("floor") - F.lit(SLACK))
    second = _scored(able.select("qid", "node"), docs, asked)
    return first.unionByName(second).dropDuplicates(["qid", "node"])


def _scored(pairs: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    met = pairs.join(docs, "node").join(asked, "qid")
    return met.withColumn("sem", score(F.col("_q"), F.col("words"), F.col("title"))).drop("_q", "words", "title")
