import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import hashing, ngram_join
from plinth.llm.components import components
from tests.llm.fixtures import corpus, frame


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    both = Counter((a, b) for found in lists.values() for a in found for b in found if a < b)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in both.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_matches_brute_force(spark):
    rows = corpus()
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = brute([(i, t) for i, t, _ in rows if i is not None])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == truth[r.doc_id]


def test_open_group_pairs(spark):
    """Two groups whose leaders do not link while some members do."""
    a = [f"a{k}" for k in range(104)]
    rows = [(k, " ".join(a[:100] if not k else a[:100][: 50 + k] + [f"z{k}"] + a[:100][51 + k :]), "s") for k in range(8)]
    b = [f"b{k}" for k in range(9)] + a[9:100]
    c = [f"b{k}" for k in range(17)] + a[17:100]
    rows += [(20, " ".join(b), "s"), (21, " ".join(c), "s"), (30, " ".join([f"b{k}" for k in range(24)] + a[24:100]), "s")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute([(i, t) for i, t, _ in rows]).items()}


def test_many_small_seeds(spark):
    for seed in (2, 3):
        rows = [r for r in corpus(seed) if r[0] is not None and r[0] < 200]
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
        assert got == {i: c for i, (_, c) in brute([(i, t) for i, t, _ in rows]).items()}


def test_empty_and_keep_one(spark):
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    assert ngram_join.ngram_join(frame(spark, [(1, None, "s"), (2, "", "s")])).count() == 2
    rows = corpus()
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    truth = brute([(i, t) for i, t, _ in rows if i is not None])
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(i for i, (_, c) in truth.items() if i == c)
    assert kept.filter("doc_id is null").count() == 1


def test_components_of_a_path(spark):
    links = spark.range(0, 70).selectExpr("id + 1 as a", "id as b").unionByName(spark.range(100, 103).selectExpr("id as a", "100 as b"))
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(71)) and all(got[i] == 100 for i in range(100, 103))


def test_components_of_random_links(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, 0) for k in range(500, 700)] + [(k, k + 7) for k in range(1000, 1200)] + [(9, 9)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    links = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {x: find(x) for x in list(root)}
    assert components(links.limit(0)).count() == 0 == components(links.filter("a = b")).count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb \n.é", max_size=60)), max_size=12))
def test_hashing_follows_words(texts):
    found = defaultdict(set)
    for _, _, h, rows in hashing.words(pa.array(texts, pa.string())):
        values, at = hashing.distinct(*hashing.grams(h, rows, 5))
        for v, r in zip(values.tolist(), at.tolist(), strict=True):
            found[r].add(v)
    truth = [shingles(t) for t in texts]
    for i, s in enumerate(truth):
        assert len(found[i]) == len(s)
        for j, other in enumerate(truth):
            assert len(found[i] & found[j]) == len(s & other)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    values, owners = rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.repeat(np.arange(50), 10)
    for coarse in (0, 3):
        back = {}
        for bucket, blob in ngram_join._packed(values, owners, 7, coarse):
            who, found = ngram_join._unpacked(blob)
            for w, x in zip(who.tolist(), found.tolist(), strict=True):
                back.setdefault(w, []).append(x)
                assert bucket == ((x >> 20) % 7) % (coarse or 7)
        for owner in range(50):
            assert sorted(back[owner]) == sorted(values[owners == owner].tolist())
    assert list(ngram_join._packed(values[:0], owners[:0], 7, 0)) == []


def test_many_buckets_are_dealt_twice(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", 200)
    monkeypatch.setattr(ngram_join, "FAN", 4)
    rows = [r for r in corpus(5) if r[0] is not None and r[0] < 200]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute([(i, t) for i, t, _ in rows]).items()}


def test_an_id_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a, "s"), (5, b, "s"), (6, a + " x", "s"), (7, b + " x", "s"), (8, "other words here", "s")]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert len(got) == 5 and {r.doc_id: r.component_id for r in got}[8] == 8
    linked = {r.doc_id for r in got if r.component_id == 5}
    assert linked in ({5, 6}, {5, 7})
    kept = sorted((r.doc_id, r.text) for r in ngram_join.keep_one(frame(spark, rows)).collect())
    gone = (linked - {5}).pop()
    assert kept == sorted((i, t) for i, t, _ in rows if i != gone)  # the other text of id 5 is compared with nothing and stays


def test_repeated_rows_leave_the_same_one(spark):
    """Of rows that share id and text one stays, whatever their order; their other columns decide which."""
    rows = [(5, "one two three", "s2"), (5, "one two three", "s1"), (5, "one two three", "s3"), (6, "ONE  two three", "s"), (None, "one two three", "s"), (None, "one two three", "s"), (7, None, "a"), (7, None, "b")]
    one, two = (sorted(((r.doc_id, r.source) for r in ngram_join.keep_one(frame(spark, x)).collect()), key=str) for x in (rows, rows[::-1]))
    assert one == two and [i for i, _ in one] == [5, 7, None, None]


def test_a_heavy_shingle_in_every_row(spark, monkeypatch):
    """Shingles of more classes than HEAVY skip the buckets; the result is the same."""
    import random

    rng = random.Random(9)
    shared = [f"h{k}" for k in range(12)]
    rows = [(i, " ".join(shared + [f"r{rng.randrange(60)}" for _ in range(rng.randrange(0, 25))]), "s") for i in range(150)]
    rows += [(200 + i, " ".join(shared + [f"c{k}" for k in range(40)] + [f"e{i % 9}"]), "s") for i in range(60)]
    truth = brute([(i, t) for i, t, _ in rows])
    monkeypatch.setattr(ngram_join, "HEAVY", 40)
    monkeypatch.setattr(ngram_join, "HEAVY_SAMPLE", 2)
    docs = frame(spark, rows)
    token, count = ngram_join.heavy_shingles(ngram_join._rows(docs), len(rows))
    assert len(token) >= 8 and (np.diff(token.astype(object)) > 0).all() and count.max() > 150
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == truth and len({c for _, c in truth.values()}) > 50
    monkeypatch.setattr(ngram_join, "HEAVY", 10**6)
    assert not len(ngram_join.heavy_shingles(ngram_join._rows(docs), len(rows))[0])


def test_a_large_group_of_near_copies(spark):
    """One base text with a few words changed in each of many copies, next to a passage that many others share."""
    import random

    rng = random.Random(6)
    base, passage = [f"p{k}" for k in range(100)], [f"q{k}" for k in range(60)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(100)] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy), "hot"))
    for i in range(400, 700):
        rows.append((i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 40))] + passage), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == brute([(i, t) for i, t, _ in rows])


def test_members_that_lie_within_their_leader(spark):
    """Doc 1 is a part of doc 0, its leader, and links with doc 2, which does not reach doc 0."""
    x, passage = [f"x{k}" for k in range(88)], [f"p{k}" for k in range(21)]
    y = x[:3] + ["one"] + x[4:40] + ["two"] + x[41:]
    rows = [(0, " ".join(x + passage), "s"), (1, " ".join(x), "s"), (2, " ".join(y), "s")]
    rows += [(k, " ".join([f"o{k}_{j}" for j in range(60)] + passage), "s") for k in range(10, 20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == brute([(i, t) for i, t, _ in rows])
    assert got[2] == (84, 0)


def test_link_table_gives_every_link(spark):
    """Members of one group of near copies link with each other, not only with their leader."""
    for rows in (corpus(), corpus(2)):
        rows = list({i: (i, t, s) for i, t, s in rows if i is not None}.values())
        sets = {i: shingles(t) for i, t, _ in rows}
        least = {}
        for i in sorted(sets):
            least.setdefault(frozenset(sets[i]), i)
        nodes = sorted(i for s, i in least.items() if s)
        truth = {(a, b): c for a in nodes for b in nodes if a < b and (c := len(sets[a] & sets[b])) * 7 >= 3 * (len(sets[a]) + len(sets[b]))}
        members, found = ngram_join.link_table(frame(spark, rows))
        assert {(r.a, r.b): r.overlap for r in found.collect()} == truth
        ends = Counter(x for pair in truth for x in pair)
        assert {r.doc_id: (r.class_id, r.n_links) for r in members.collect()} == {i: (least[frozenset(s)], ends[least[frozenset(s)]]) for i, s in sets.items() if s}
        assert max(ends.values()) > 30
