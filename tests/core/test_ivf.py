"""The inverted-file index against a full search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import ivf, vector

KINDS = "id long, vec array<double>, matter_id string"


def points(spark, n=1500, d=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(30, d)) * 2
    x = middle[rng.integers(0, 30, n)] + rng.normal(size=(n, d))
    x[n // 3 : 2 * n // 3] = x[5]  # a third of all rows are one vector
    rows = [(k, v.tolist(), None if k % 4 else f"m{k % 3}") for k, v in enumerate(x)] + [(n, [0.0] * d, None), (n + 1, None, None)]
    return spark.createDataFrame(rows, KINDS)


@pytest.mark.parametrize("scope", [None, "m1"])
def test_exact_search_equals_full_search(spark, monkeypatch, scope):
    monkeypatch.setattr(ivf, "PART_POINTS", 200)
    table = points(spark)
    asked = table.filter("id % 37 = 0 and vec is not null").select(F.col("id").alias("qid"), "vec", F.lit(scope).cast("string").alias("scope"))
    want = sorted(map(tuple, vector.topk(asked, table.filter("vec is not null"), 7).collect()))
    index = ivf.build(table)
    key = lambda rows: sorted((r.qid, r.id, round(r.sim, 6), r["rank"]) for r in rows)
    assert key(ivf.search(index, asked, 7, probes=1, exact=True).collect()) == [(q, i, round(s, 6), k) for q, i, s, k in want]
    found = ivf.search(index, asked, 7)
    measured = ivf.recall(found, vector.topk(asked, table.filter("vec is not null"), 7)).agg(F.avg("recall")).first()[0]
    assert measured >= 0.9
    stored = index.points(spark)
    assert stored.count() == 1501 and stored.select("id").distinct().count() == 1501
    hot = stored.groupBy("list").count().orderBy(F.desc("count")).first()
    assert hot["count"] >= 500 and stored.filter(F.col("list") == hot["list"]).select(F.input_file_name()).distinct().count() > 1


def test_probes_follow_the_data():
    """Points without clusters need many lists for the same recall, clusters few; both measured on all rows."""
    rng = np.random.default_rng(3)
    loose = rng.normal(size=(1500, 32))
    tight = (rng.normal(size=(40, 32)) * 5)[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 32)) * 0.3
    for x, most in ((loose, 24), (tight, 6)):
        centres = ivf.centroids(x, 24)
        probes = ivf.probes_for(x, centres, 10)
        assert 1 <= probes <= most
        x = ivf._unit(x)
        near, sims = (x @ centres.T).argmax(1), x @ x.T
        read = np.argsort(-(x @ centres.T), axis=1)[:, :probes]
        met = [np.isin(near[np.argsort(-sims[i])[1:11]], read[i]).mean() for i in range(0, 1500, 7)]
        assert np.mean(met) >= 0.9


def test_only_probed_lists_are_read(spark):
    table = points(spark, 600)
    asked = table.filter("id = 7").select(F.col("id").alias("qid"), "vec", F.lit(None).cast("string").alias("scope"))
    found = ivf.search(ivf.build(table), asked, 3, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert found.first().id == 7


def test_empty_tables(spark):
    table = points(spark, 60)
    none = table.filter("id < 0")
    asked = table.filter("id < 2").select(F.col("id").alias("qid"), "vec", F.lit(None).cast("string").alias("scope"))
    assert ivf.search(ivf.build(none), asked, 3).count() == 0 == ivf.search(ivf.build(table), asked.limit(0), 3).count()


def test_a_task_leaves_its_best_alone(spark):
    """However many lists a query wants, a task hands on ``k`` rows of it at most; folders are looked up once."""
    table = points(spark, 900)
    index = ivf.build(table, lists=40)
    assert index.points(spark) is index.points(spark)
    asked = table.filter("id < 3").select(F.col("id").alias("qid"), "vec", F.lit(None).cast("string").alias("scope")).toPandas()
    q = ivf._unit(np.array(asked["vec"].tolist(), float))
    found = ivf._read(spark, index, asked, q, np.ones((3, len(index.centres)), bool), 4, "qid long, id long, sim double")
    most = found.select("qid", F.spark_partition_id().alias("task")).groupBy("qid", "task").count().agg(F.max("count")).first()[0]
    assert most == 4
