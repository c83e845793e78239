"""Stream forms against their batch forms over the same events."""

import contextlib
import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from plinth.schema import EVENT_SCHEMA
from plinth.streaming import bus


def _rows(spark, n=200):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=37 * i), i % 3, None if i % 50 == 0 else f"t{i % 2}", float(i), '{"k": %d}' % i if i % 7 else "broken") for i in range(n)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def test_stage_drains_and_sets_failures_aside(spark, tmp_path):
    _rows(spark).repartition(4).write.parquet(str(tmp_path / "in"))

    def handler(rows):
        if rows.filter("event_id = 13").count():
            raise ValueError("poison")
        return rows.select("event_id")

    paths = [str(tmp_path / n) for n in ("out", "dead", "ck")]
    bus.run_stage(bus.events(spark, str(tmp_path / "in"), max_files=1), handler, *paths)
    good = {r.event_id for r in spark.read.parquet(paths[0]).collect()}
    dead = spark.read.parquet(paths[1]).collect()
    assert good | {r.event_id for r in dead} == set(range(200)) and 13 not in good and {r.problem for r in dead} == {"ValueError"}


def _replay(paths):
    """Forget that the last epoch was committed, as a crash just before it would."""
    commits = os.path.join(paths[2], "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        with contextlib.suppress(FileNotFoundError):
            os.remove(os.path.join(commits, name))
    return last


def test_a_replayed_epoch_is_there_once(spark, tmp_path):
    _rows(spark).repartition(4).write.parquet(str(tmp_path / "in"))
    calls = []

    def handler(rows):
        calls.append(1)
        if rows.filter("event_id = 13").count():
            raise ValueError("poison")
        return rows.select("event_id")

    paths = [str(tmp_path / n) for n in ("out", "dead", "ck")]
    ids = lambda p: sorted(r.event_id for r in spark.read.parquet(p).collect())
    run = lambda: bus.run_stage(bus.events(spark, str(tmp_path / "in")), handler, *paths)
    run()
    assert ids(paths[0]) == [i for i in range(200) if i != 13] and ids(paths[1]) == [13]
    epoch, seen = _replay(paths), len(calls)
    run()  # published before the crash: left alone
    assert len(calls) == seen and ids(paths[0]) == [i for i in range(200) if i != 13] and ids(paths[1]) == [13]
    _replay(paths)
    query = bus.query_id(spark, paths[2])
    shutil.rmtree(f"{paths[0]}/query={query}/epoch={epoch}")  # crashed between the dead letters and the output
    os.makedirs(f"{paths[0]}/_pending/{query}-{epoch}")
    spark.range(5).selectExpr("id + 900 as event_id").write.mode("append").parquet(f"{paths[0]}/_pending/{query}-{epoch}")  # and half written
    run()
    assert ids(paths[0]) == [i for i in range(200) if i != 13] and ids(paths[1]) == [13]


def test_machines_are_not_blamed_on_events(spark, tmp_path):
    _rows(spark).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("out", "dead", "ck")]
    broken = [OSError("No space left on device")]

    def handler(rows):
        if broken:
            raise broken.pop()
        return rows.select("event_id")

    run = lambda: bus.run_stage(bus.events(spark, str(tmp_path / "in")), handler, *paths)
    with pytest.raises(Exception, match="No space left"):
        run()
    assert not os.path.exists(f"{paths[0]}/query={bus.query_id(spark, paths[2])}")
    run()
    assert spark.read.parquet(paths[0]).count() == 200
    assert bus.to_blame(ValueError("x")) and not bus.to_blame(RuntimeError("Job aborted: ExecutorLostFailure (executor 1 exited)"))


def _drain(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60) or q.stop()
    return spark.table(name).collect()


def test_windows_match_the_batch_form(spark, tmp_path):
    rows = _rows(spark)
    rows.write.parquet(str(tmp_path / "in"))
    got = _drain(spark, bus.tumbling(bus.events(spark, str(tmp_path / "in"))), "tumbling", "complete")
    assert sorted(map(str, got)) == sorted(map(str, bus.tumbling(rows).collect()))
    assert sum(r.n for r in bus.sliding(rows).collect()) == 2 * 200
    assert sum(r.n for r in bus.sessions(rows).collect()) == 200


def test_trace_ring(spark, tmp_path):
    rows = _rows(spark)
    rows.write.parquet(str(tmp_path / "in"))
    got = _drain(spark, bus.trace_history(bus.events(spark, str(tmp_path / "in")), keep=16), "ring", "update")
    assert {r.user_id: (r.n_kept, r.last_event) for r in got} == {k: (16, max(i for i in range(200) if i % 3 == k)) for k in range(3)}
    assert bus.last_events(rows, 16).groupBy("user_id").count().filter("count <> 16").count() == 0


def test_typed_and_dead(spark):
    typed = bus.typed(_rows(spark))
    good, dead = bus.split_dead(typed, F.col("problem").isNotNull())
    assert good.count() + dead.count() == 200
    assert {r.problem for r in dead.select("problem").distinct().collect()} == {"no_type", "bad_props"}


def test_duplicates_leave_once(spark, tmp_path):
    rows = _rows(spark)
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    got = _drain(spark, bus.once(bus.events(spark, str(tmp_path / "in"))), "once", "append")
    assert len(got) == rows.count()
