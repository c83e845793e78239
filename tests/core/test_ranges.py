"""Percentiles without whole groups, and interval joins by bins, against brute force."""

import random

from plinth.operators import metrics, segment


def test_nearest_ranks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BINS", 8)
    monkeypatch.setattr(metrics, "RANKED", 5)
    rng = random.Random(1)
    groups = {
        "even": [float(k) for k in range(101)], "one": [3.5], "same": [2.0] * 50, "pair": [1.0, 9.0], "far": [rng.random() for _ in range(200)] + [1e12, -1e9],
        "ties": [float(rng.randrange(4)) for _ in range(333)], "tiny": [1.0 + k * 1e-15 for k in range(40)], "none": [None, None], "some": [None, 4.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "dataset string, latency double")
    shares = (0.0, 0.5, 0.95, 1.0)
    got = {(r.dataset, r.share): r.picked for r in metrics.nearest_ranks(table, "dataset", "latency", shares).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        want |= {(g, s): vs[round(s * (len(vs) - 1))] for s in shares if vs}
    assert got == want
    assert metrics.nearest_ranks(table.limit(0), "dataset", "latency", shares).count() == 0


def test_roles_meet_the_paragraphs_of_their_bin(spark):
    rng = random.Random(2)
    paragraphs, hits = [], []
    for doc in range(6):
        at = 0
        for number in range(40):
            end = at + rng.choice((0, 5, 300, 9000))
            paragraphs.append((doc, str(number), at, end))
            at = end
        hits += [(doc, f"r{rng.randrange(3)}", rng.randrange(-5, at + 50)) for _ in range(60)] + [(doc, "edge", p[2]) for p in paragraphs if p[0] == doc]
    hits.append((9, "r0", 5))
    found = segment.attach_roles(spark.createDataFrame(paragraphs, "id int, number string, char_start int, char_end int"), spark.createDataFrame(hits, "id int, role string, at int"))
    want = set()
    for doc, role, at in hits:
        inside = [(s, n) for d, n, s, e in paragraphs if d == doc and s <= at <= e]
        if inside:
            want.add((doc, role, min(inside)[1]))
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "bin" in plan and "Cartesian" not in plan
