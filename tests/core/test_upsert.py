"""Keyed tables: what a reader sees before, during and after an upsert."""

import pytest

from plinth.sources import upsert

KINDS = "id long, name string, weight double"


def table(spark, tmp_path, **more):
    return upsert.KeyedTable(spark, str(tmp_path / "t"), "id", KINDS, **{"buckets": 8, **more})


def rows(spark, values):
    return spark.createDataFrame(values, KINDS)


def held(t, version=None):
    return sorted(map(tuple, t.read(version).collect()), key=str)


def test_replace_merge_and_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t) == [] and t.versions() == []
    assert t.upsert(rows(spark, [(k, f"n{k}", float(k)) for k in range(40)])) == 0
    assert t.upsert(rows(spark, [(3, "new", None), (3, "newer", 1.0), (99, "more", 2.0), (None, "x", 0.0)]), order="weight") == 1
    now = {i: (n, w) for i, n, w in held(t)}
    assert len(now) == 41 and now[3] == ("newer", 1.0) and now[99] == ("more", 2.0) and now[4] == ("n4", 4.0)
    assert t.upsert(rows(spark, [(4, None, 7.0), (5, "five", None), (100, None, None)]), merge=True) == 2
    now = {i: (n, w) for i, n, w in held(t)}
    assert now[4] == ("n4", 7.0) and now[5] == ("five", 5.0) and now[100] == (None, None)
    assert len(held(t, 0)) == 40 and {i: n for i, n, _ in held(t, 1)}[5] == "n5"
    assert t.upsert(rows(spark, [])) == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.upsert(rows(spark, [(k, "a", 0.0) for k in range(400)]))
    before = t.manifest()
    t.upsert(rows(spark, [(7, "b", 0.0), (8, "b", 0.0)]))
    changed = {b for b, w in t.manifest().items() if before.get(b) != w}
    assert 1 <= len(changed) <= 2 and len({i for i, _, _ in held(t)}) == 400
    assert {n for i, n, _ in held(t) if i in (7, 8)} == {"b"}


def test_a_writer_that_dies_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, [(k, "old", 0.0) for k in range(20)]))
    was = held(t)

    def killed(self, version, entries):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(upsert.KeyedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(rows(spark, [(k, "lost", 1.0) for k in range(20)]))
    again = table(spark, tmp_path)  # another process
    assert held(again) == was and again.versions() == [0]
    assert again.upsert(rows(spark, [(1, "new", 1.0)])) == 1 and len(held(again)) == 20
    assert len(again.vacuum(keep=1)) == 1 and len(held(again)) == 20  # the folder of the dead writer; the first one still holds buckets


def test_the_second_of_two_writers_fails_and_tries_again(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.upsert(rows(spark, [(1, "a", 0.0)]))
    commit, raced = upsert.KeyedTable._commit, []

    def race(self, version, entries):
        if not raced:
            raced.append(1)
            other.upsert(rows(spark, [(2, "theirs", 0.0)]))
        commit(self, version, entries)

    monkeypatch.setattr(upsert.KeyedTable, "_commit", race)
    with pytest.raises(upsert.Conflict):
        t.upsert(rows(spark, [(1, "mine", 0.0)]))
    assert held(t) == [(1, "a", 0.0), (2, "theirs", 0.0)]
    raced.clear()
    assert t.upsert_retrying(rows(spark, [(1, "mine", 0.0)])) == 3
    assert held(t) == [(1, "mine", 0.0), (2, "theirs", 0.0)]
