"""Token buckets by host on a stream: refill by event time, and expiry."""

import datetime as dt

import pytest

from plinth.streaming import timers

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, timers.STORE)
    yield
    spark.conf.unset(name)


def brute(batches, rate, burst):
    """Tokens counted directly."""
    out, tokens, last = {}, {}, {}
    for batch in batches:
        for host, request, at in sorted(batch, key=lambda r: (r[0], r[2], r[1])):
            have = min(burst, tokens.get(host, burst) + (at - last.get(host, at)) * rate)
            out[request] = 0 if have >= 1 else round((1 - have) / rate * 1000)
            tokens[host], last[host] = have - 1, at
    return out


def test_buckets_refill_and_are_forgotten(spark, store, tmp_path):
    batches = [
        [("a", k, 0.0) for k in range(5)] + [("b", 10, 0.0)],
        [("a", 20, 2.0), ("a", 21, 2.5), ("b", 22, 2.0)],
        [("a", 30, 60.0), ("a", 31, 60.0), ("a", 32, 60.0), ("a", 33, 60.0)],
        [("c", 40, 5000.0)],
        [("c", 50, 6000.0)],
    ]
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    sizes = []

    def keep(rows, epoch):
        rows.write.mode("append").parquet(out)

    for batch in batches:
        spark.createDataFrame([(h, r, START + dt.timedelta(seconds=s)) for h, r, s in batch], "host string, request_id long, asked timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("host string, request_id long, asked timestamp").parquet(source)
        query = timers.admitted(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ck).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.request_id: (r.wait_ms, r.admitted - r.asked) for r in spark.read.parquet(out).collect()}
    want = brute(batches, timers.RATE, timers.BURST)
    assert {k: w for k, (w, _) in got.items()} == want
    assert all(gap == dt.timedelta(milliseconds=w) for w, gap in got.values())
    assert max(want.values()) == 2000 and sizes[-1] < sizes[2]  # hosts a and b are forgotten
