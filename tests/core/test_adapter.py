"""The adapter data source, configuration files and the fetcher."""

import json

import pytest

from plinth.sources import adapter, sinks
from plinth.sources.files import TokenBucket, jsonl


def test_adapter_source(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    adapter.register(spark)
    refs = [{"external_id": "a.txt", "title": "A"}, {"external_id": "b", "url": f"file://{tmp_path}/a.txt"}, {"external_id": "gone"}]
    got = {r.external_id: (bytes(r.content) if r.content else None, r.problem) for r in spark.read.format("plinth_adapter").option("refs", json.dumps(refs)).option("root", str(tmp_path)).load().collect()}
    assert got == {"a.txt": (b"hello", None), "b": (b"hello", None), "gone": (None, "FileNotFoundError")}
    assert spark.read.format("plinth_adapter").load().count() == 0


def test_filters_choose_what_is_opened(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    adapter.register(spark)
    refs = [{"external_id": f"j_{year}_{court}", "court": court.upper(), **({"year": year} if year % 2 else {})} for year in range(1990, 2000) for court in ("sc", "del")] + [{"external_id": "undated"}]
    for r in refs:
        (tmp_path / r["external_id"]).write_text(r["external_id"])
    load = lambda: adapter.references(spark, refs, str(tmp_path))
    try:
        for where, n in (("year = 1993", 2), ("year in (1991, 1994) and court = 'del'", 2), ("year >= 1995 and year < 1998 and court = 'sc'", 3), ("external_id = 'undated'", 1), ("year > 1998", 2), ("year <= 1990", 2)):
            found = load().filter(where)
            assert found.rdd.getNumPartitions() == n == found.count(), where  # a partition for each reference that is opened
            assert {bytes(r.content).decode() for r in found.collect()} == {r.external_id for r in found.collect()}
        odd = load().filter("year % 2 = 1 and court = 'sc'")  # the first part is left to Spark
        assert odd.count() == 5 and odd.rdd.getNumPartitions() == 10
        assert load().filter("year = 1800").count() == 0 and load().filter("year is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert load().filter("year = 1993").count() == 2  # the same rows where nothing is pushed


def test_references_arrive_as_a_stream(spark, tmp_path):
    adapter.register(spark)
    arrivals, out, ck = tmp_path / "arrivals", str(tmp_path / "out"), str(tmp_path / "ck")
    arrivals.mkdir()
    (tmp_path / "a").write_text("A")

    def drain():
        stream = spark.readStream.format("plinth_adapter").option("arrivals", str(arrivals)).option("root", str(tmp_path)).load()
        stream.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.external_id, r.problem) for r in spark.read.parquet(out).collect())

    (arrivals / "0001.jsonl").write_text(json.dumps({"external_id": "a", "year": 2001}) + "\n\n" + json.dumps({"external_id": "gone"}))
    first = drain()
    assert first == [("a", None), ("gone", "FileNotFoundError")]
    assert drain() == first  # nothing new
    (arrivals / "0002.jsonl").write_text(json.dumps({"external_id": "b", "url": f"file://{tmp_path}/a"}))
    assert drain() == [("a", None), ("b", None), ("gone", "FileNotFoundError")]


def test_configuration(spark, tmp_path):
    (tmp_path / "old_new.yml").write_text("source_act: Old Act, 1900\ntarget_act: New Act, 2000\nmappings:\n  - {old: '1', new: '2', mapping_type: one_to_one}\n  - {old: 3A, new: 4, mapping_type: odd}\n")
    assert [(r.source_section, r.target_section, r.mapping_type) for r in adapter.crosswalk_file(spark, str(tmp_path / "old_new.yml")).orderBy("source_section").collect()] == [("1", "2", "one_to_one"), ("3A", "4", "partial")]
    (tmp_path / "t.yml").write_text("_default:\n  min: {x: 0.5}\nd:\n  min: {x: null}\n")
    assert adapter.threshold_file(str(tmp_path / "t.yml"))["d"]["min"] == {"x": None}
    (tmp_path / "s.yml").write_text("services:\n  - {id: a, title: T, kind: worker, listens: [x, y], publishes: [z]}\n")
    assert adapter.service_file(spark, str(tmp_path / "s.yml")).first().listens == ["x", "y"]
    (tmp_path / "items.jsonl").write_text('{"id": "1", "question": "q"}\n\n{"id": "2", "question": "r"}\n')
    assert jsonl(spark, str(tmp_path / "items.jsonl"), "id string, question string").filter("id is not null").count() == 2


def test_fetcher(tmp_path):
    calls = []

    def get(url):
        calls.append(url)
        if url.endswith("robots.txt"):
            return b"User-agent: *\nDisallow: /private", {}
        return url.encode(), {}

    waits = []
    fetch = adapter.Fetcher(str(tmp_path), get, TokenBucket(1.0, 1, lambda: 0.0), sleep=waits.append)
    assert fetch.fetch("http://h/a") == b"http://h/a" == fetch.fetch("http://h/a") and len(calls) == 2
    fetch.fetch("http://h/b")
    assert waits == [0.0, 1.0]
    assert fetch.fetch("http://h/a", ttl_s=-1) == b"http://h/a" and len(calls) == 4
    with pytest.raises(PermissionError):
        fetch.fetch("http://h/private/x")
    open_ = adapter.Fetcher(str(tmp_path / "n"), lambda u: (_ for _ in ()).throw(OSError()) if u.endswith("robots.txt") else (b"x", {}))
    assert open_.fetch("http://other/") == b"x"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "t")
    old.write.parquet(path)
    sinks.replace_by_key(spark.read.parquet(path), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id", path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.write_audit(spark.sql("select timestamp'2024-01-02 03:04:05' as created_at, 'x' as what, cast(null as string) as none"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).first().what == "x"
    assert json.loads(sinks.report_json(spark.sql("select 'd' as dataset, 1.5 as x")).first().report) == {"x": 1.5}
