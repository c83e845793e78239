"""Empty tables, nulls, repeated rows, clashing columns and very long texts, for operators that the other files do not try on them."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.llm import decontam, linededup, mixing, ngram_join, ordinal, pii, quality_rules, sharding, toxicity, urlfilter
from tests.llm.fixtures import frame
from tests.llm.test_native_operators import brute_leaks, brute_lines, brute_statistics

CLASHES = "row id key hash kept __id __h __source __rate __row h n text_crc32 size w lines marks packed paired start digest runs ls marked known kinds vslot rate n_copies label features value doc source_".split()


def clashing(docs):
    """The documents with columns named like everything that the operators make."""
    for name in CLASHES:
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 90))), "s") for i in range(60)] + [(70, None, None), (71, "", "s"), (None, "a b c d e f", "s"), (None, None, "s"), (3, "again one text", "s"), (3, "again one text", "s")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[0][1]), (None, rows[1][1]), (2, None), (3, "")], "item_id long, text string")
    return docs, labels, bench


def _calls(labels, bench):
    rows = lambda df: sorted(map(str, df.collect()))
    return {
        "pii": lambda d: rows(pii.surrogate_text(d, b"k")),
        "lines": lambda d: rows(linededup.dedup_lines(d)),
        "join": lambda d: rows(ngram_join.ngram_join(d)),
        "keep_one": lambda d: rows(ngram_join.keep_one(d).select("doc_id", "text")),
        "toxicity": lambda d: rows(toxicity.judged(d, labels)),
        "keep_clean": lambda d: rows(toxicity.keep_clean(d, labels).select("doc_id", "text")),
        "ordinal": lambda d: rows(ordinal.judged(d, labels)),
        "rules": lambda d: rows(quality_rules.judge(d, labels)[0]),
        "leaks": lambda d: rows(decontam.leaks(d, bench)),
        "clean": lambda d: rows(decontam.clean(d, bench).select("doc_id", "text")),
        "mixing": lambda d: rows(mixing.mix(d, epochs=2.0).select("doc_id", "text", "copy_no")),
        "sharding": lambda d: rows(sharding.shard(d)),
    }


NAMES = ("pii", "lines", "join", "keep_one", "toxicity", "keep_clean", "ordinal", "rules", "leaks", "clean", "mixing", "sharding")


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_empty_tables_change_nothing(spark, tables, name):
    docs, labels, bench = tables
    call = _calls(labels, bench)[name]
    assert call(clashing(docs)) == call(docs) != []
    assert call(docs.limit(0)) == call(clashing(docs).limit(0)) == []


def test_filters_keep_all_columns(spark, tables):
    docs, labels, bench = tables
    wide = clashing(docs)
    for kept in (toxicity.keep_clean(wide, labels), ngram_join.keep_one(wide), decontam.clean(wide, bench)):
        assert kept.dtypes == wide.dtypes


def test_empty_labels_and_benchmarks(spark, tables):
    docs, labels, bench = tables
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == docs.count() == decontam.clean(docs, bench.limit(0)).count()
    assert quality_rules.judge(docs, labels.limit(0))[1] == [] and ordinal.judged(docs, labels.limit(0)).filter("not kept").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(pages, urlfilter.train(urlfilter.seed_labels(pages))).count() == 0


def test_one_very_long_text(spark):
    """A text of 200,000 words, next to a short one: each operator reads it to its end."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    item = " ".join(f"b{k}" for k in range(40))
    lines = "\n".join(" ".join(words[k : k + 40]) for k in range(0, len(words), 40))
    tail = "\n" + item + "\nmail jo.li@x.org now\nx1\nx2\nx3\ny\nx1\nx2\nx3"
    rows = [(1, lines + tail, "s"), (2, "short text", "s")]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in pii.surrogate_text(docs, b"k").collect()}
    assert out[1].n_entities == 1 and "jo.li@x.org" not in out[1].text and out[1].text.endswith("x3")
    cleaned = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert [(i, *cleaned[i]) for i in (1, 2)] == brute_lines([(i, t) for i, t, _ in rows]) and cleaned[1][1] == 3
    stats = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(docs).collect()}
    assert stats == {i: brute_statistics(t) for i, t, _ in rows}
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = decontam.leaks(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in found] == [(1, 9, 1.0)] and found[0].start == 200_000
    assert brute_leaks([(2, "short text")], [(9, item)]) == {}


def test_very_long_texts_and_urls(spark):
    """One text of 3 MB in one word, one of 200,000 lines, and a URL of 300 KB."""
    word, lines = "x" * 3_000_000, "\n".join(f"line {k}" for k in range(200_000))
    rows = [(1, word, "s"), (2, lines, "s"), (3, "a b", "s")]
    copies = mixing.mix(frame(spark, rows), epochs=3.0).collect()
    assert all(r.text == {1: word, 2: lines, 3: "a b"}[r.doc_id] for r in copies)
    placed = {r.doc_id: r.size for r in sharding.shard(frame(spark, rows)).collect()}
    assert placed == {1: len(word) + 8, 2: len(lines) + 8, 3: 11}
    url = "http://Long.example.org/" + "p/" * 150_000
    pages = spark.createDataFrame([(1, url, "h"), (2, "http://" + "h" * 300_000, "h")], "page_id long, url string, html string")
    model = urlfilter.Model(-5.0, [], spark.createDataFrame([], "suffix string, rate double, n double"), 0.0)
    got = {r.page_id: (r.host, len(r.path), r.verdict) for r in urlfilter.judge(pages, model).collect()}
    assert got[1] == ("long.example.org", 300_001, "allow") and len(got[2][0]) == 300_000
