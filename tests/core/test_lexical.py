"""The inverted index for lexical reranking against scores of all pairs."""

import random

import pytest

from plinth.operators import lexical, retrieval


def brute(docs, asked, k, authority):
    out = []
    for qid, q in asked:
        q = {w for w in q.split() if len(w) > 2}
        scored = []
        for node, body, title, tier, year in docs:
            c, t = ({w for w in (x or "").split() if len(w) > 2} for x in (body, title))
            sem = (0.7 * len(q & c) / max(len(q | c), 1) + 0.3 * len(q & t) / max(len(q), 1)) if q else 0.0
            recency = min(1.0, (year - 1950) / 80) if year and year >= 1950 else 0.0
            total = 1 / max(8 if tier is None else tier, 1) + 0.1 * sem + 0.05 * recency if authority else sem
            scored.append((-round(total, 9), node))
        out += [(qid, node, r) for r, (_, node) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("authority", [False, True])
def test_best_of_all_documents(spark, monkeypatch, authority):
    monkeypatch.setattr(lexical, "SEED_WORDS", 2)
    monkeypatch.setattr(lexical, "SEED_DOCUMENTS", 2)
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(40)]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)], k=n))
    docs = [(k, pick(rng.randrange(0, 25)), rng.choice([None, "", pick(2), "common"]), rng.choice([None, 1, 2, 8]), rng.choice([None, 1900, 1960, 2020])) for k in range(300)]
    docs += [(900, None, None, None, None), (901, "common", "common", 1, 2020)]
    asked = [(k, pick(rng.randrange(1, 12))) for k in range(25)] + [(50, ""), (51, "nowhere found"), (52, "common"), (53, "common word0 word1 word2")]
    d = spark.createDataFrame(docs, "node int, body string, title string, tier int, yr int")
    q = spark.createDataFrame(asked, "qid int, question string")
    for k in (1, 7):
        got = retrieval.lexical_best(d, q, k, authority)
        assert sorted((r.qid, r.node, r["rank"]) for r in got.collect()) == brute(docs, asked, k, authority)
    assert "Cartesian" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert retrieval.lexical_best(d.limit(0), q, 3, authority).count() == 0 == retrieval.lexical_best(d, q.limit(0), 3, authority).count()
    assert sorted((r.qid, r.node) for r in retrieval.lexical_best(d.limit(2), q, 3, authority).collect())[:2] == [(0, 0), (0, 1)]


def test_few_pairs_are_scored(spark):
    """A frequent word does not pair every document with every question that holds it."""
    docs = spark.range(3000).selectExpr("cast(id as int) node", "concat('common item', id, ' item', id + 1, ' item', id + 2) body", "'' title", "3 tier", "2000 yr")
    asked = spark.range(30).selectExpr("cast(id as int) qid", "concat('common item', id * 50, ' item', id * 50 + 1, ' item', id * 50 + 2) question")
    words = lambda c: retrieval.fx.lexical_tokens(retrieval.F.col(c)).alias("words")
    found = lexical.candidates(docs.select("node", words("body"), retrieval.F.split("title", "-").alias("title"), retrieval.F.lit(0.0).alias("static")), asked.select("qid", words("question")), 1)
    assert found.count() < 30 * 120
    assert {(r.qid, r.node) for r in retrieval.lexical_best(docs, asked, 1).collect()} == {(k, k * 50) for k in range(30)}
