"""Lexical search over treaps against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from plinth.llm import search
from tests.llm.fixtures import corpus, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        asked = Counter(terms(text))
        scores = []
        for i, c in counted:
            m = 75 + (25 * c.total() * n) // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item_id, r, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "d", 3) for i, t in rows], "item_id long, text string, doc_id string, rank int")


def got(docs, items, **more):
    found = search.search(docs, items, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


def test_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 300)
    monkeypatch.setattr(search, "CELLS", 64)
    rows = corpus() + [(400, "Ärger ÄRGER straße naïve-NAÏVE 42_42 x\x00y\x7fz", "s"), (401, "w1 w2", "s")]
    items = [(k, rows[k * 7][1]) for k in range(20)] + [(30, "w1 w1 W1 w2, nowhere"), (31, "nowhere else"), (32, None), (33, "  "), (34, "ärger Ärger straße y z 42"), (30, "w3"), (0, rows[0][1]), (None, "w5 w6")]
    docs = [(i, t) for i, t, _ in rows]
    want = brute(docs, items)
    assert got(frame(spark, rows).repartition(5), items_of(spark, items)) == want
    assert got(frame(spark, rows).coalesce(1), items_of(spark, items)) == want
    monkeypatch.setattr(search, "ITEM_BYTES", 500)  # several blocks
    monkeypatch.setattr(search, "PARTS", 2)
    assert got(frame(spark, rows), items_of(spark, items)) == want


def test_ties_and_copies(spark):
    rows = [(k, "same words here" if k % 3 else "other thing", "s") for k in range(300, 0, -1)] + [(5, "same words here", "s"), (None, "same words here", "s")]
    items = [(1, "same words"), (2, "other"), (3, "same other")]
    assert got(frame(spark, rows).repartition(4), items_of(spark, items)) == brute([(i, t) for i, t, _ in rows], items)
    assert [r[2] for r in sorted(got(frame(spark, rows), items_of(spark, items[:1])), key=lambda r: r[1])][:6] == [1, 2, 4, 5, 5, 7]


def test_empty_tables_and_long_texts(spark):
    assert got(frame(spark, []), items_of(spark, [(1, "a")])) == []
    assert got(frame(spark, [(1, "a b", "s")]), items_of(spark, [])) == []
    assert got(frame(spark, [(1, None, "s"), (2, "...", "s")]), items_of(spark, [(1, "a")])) == []
    long = " ".join(f"t{k % 5000}" for k in range(400_000)) + " " + "z" * 1_500_000
    rows = [(1, long, "s"), (2, "t1 t2", "s"), (3, "t1", "s")]
    items = [(1, "t1 t2 t4999"), (2, "z" * 1_500_000)]
    assert got(frame(spark, rows), items_of(spark, items)) == brute([(i, t) for i, t, _ in rows], items)


def random_shard(rng, docs, vocabulary):
    postings = sorted({(t, p) for p in range(docs) for t in rng.sample(range(vocabulary), rng.randrange(1, vocabulary))})
    places = np.array([p for _, p in postings], np.int32)
    names = np.array([t for t, _ in postings], np.int32)
    tfs = np.array([rng.choice((1, 1, 1, 2, 5)) for _ in postings], np.int32)
    lengths = np.array([rng.choice((5, 5, 50, 400)) for _ in range(docs)], np.int64)
    distinct, counts = np.unique(names, return_counts=True)
    return search.Shard(lengths, distinct.astype(np.int32), counts.astype(np.int32), places, tfs, docs, int(lengths.sum()), vocabulary + 1), names


def test_treaps_are_search_trees_and_heaps(spark):
    shard, names = random_shard(random.Random(2), 80, 7)

    def walk(node, low, high, top):
        if node < 0:
            return []
        assert low < shard.place[node] < high and shard.impact[node] <= top
        return walk(shard.left[node], low, shard.place[node], shard.impact[node]) + [node] + walk(shard.right[node], shard.place[node], high, shard.impact[node])

    for t in range(7):
        assert walk(shard.root[t], -1, 80, math.inf) == np.flatnonzero(names == t).tolist()


def test_split_gives_the_tops_of_both_ranges():
    rng = random.Random(3)
    shard, names = random_shard(rng, 60, 5)
    tops = lambda t, low, high: max((k for k in np.flatnonzero(names == t) if low < shard.place[k] < high), key=lambda k: (shard.impact[k], (int(shard.place[k]) * 2_654_435_761 >> 7) & 0xFFFFF), default=-1)
    for _ in range(200):
        low, high = sorted(rng.sample(range(-1, 61), 2))
        if high - low < 2:
            continue
        at = rng.randrange(low + 1, high)
        nodes = np.array([[tops(t, low, high) for t in range(5)]])
        before, after, here = shard.split(nodes, *(np.array([x]) for x in (low, at, high)))
        assert before[0].tolist() == [tops(t, low, at) for t in range(5)] and after[0].tolist() == [tops(t, at, high) for t in range(5)]
        assert here[0].tolist() == [next((int(k) for k in np.flatnonzero(names == t) if shard.place[k] == at), -1) for t in range(5)]


def test_pruning_scores_few_documents_and_loses_none():
    rng = random.Random(4)
    shard, names = random_shard(rng, 3000, 12)
    asked, weights = np.arange(12), np.array([1, 1, 1, 2, 2, 3, 40, 50, 60, 1, 1, 1])
    places, scores, tried = shard.best(asked, weights, 5)
    total = np.zeros(3000, np.int64)
    np.add.at(total, shard.place, shard.impact * weights[names])
    order = np.lexsort((np.arange(3000), -total))[:5]
    assert places.tolist() == order.tolist() and scores.tolist() == total[order].tolist() and tried < 1000
