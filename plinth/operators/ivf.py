"""Inverted-file vector index: every point lies in the list of its nearest centroid; a search reads few lists.

Centroids are fitted on a bounded sample of points, every point is assigned,
and the lists are a stored table, one folder each, so a search reads only the
folders it probes. A list that holds many points (copies of one vector) lies
in several files, written by several tasks. Each list keeps the least cosine
of its points to the centroid: by the triangle inequality of angles no point
of a list can be nearer to a query than its angle to the centroid less that
radius. An approximate search reads the best lists,
as many as the sample shows to be needed for ``RECALL``; an exact one
takes the k-th similarity found there as a floor and reads on in those lists
alone that can still hold a better point. What is read is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth import schema
from plinth.operators.vector import POINT_ROWS, Best, _blocks
from plinth.session import materialize, scratch_path

#: Points that centroids are fitted on at most, by the least hashes of their ids.
SAMPLE_ROWS = 20_000
#: Lists at most, and points of a list on average below that.
LISTS, LIST_POINTS = 4096, 64
ROUNDS = 8
#: Share of true neighbours that an approximate search should find, and sampled points that tell how many lists that takes.
RECALL, ASKED = 0.95, 256
#: Points of a list from which on it is written by several tasks.
PART_POINTS = 100_000
#: Similarities are compared at this many places.
PLACES = 6


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means, started from a spread of the rows."""
    x = np.unique(_unit(x), axis=0)
    if len(x) <= lists:
        return x
    found = x[np.random.default_rng(17).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        near = np.concatenate([(x[s : s + 4096] @ found.T).argmax(1) for s in range(0, len(x), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 0
        found = np.where(full[:, None], _unit(sums), found)
    return found


def probes_for(x: np.ndarray, centres: np.ndarray, k: int) -> int:
    """Lists to read so that RECALL of the ``k`` nearest other rows of ASKED rows of ``x`` are found."""
    x = _unit(x)
    if len(x) < 2 or not len(centres):
        return 1
    near = np.concatenate([(x[s : s + 4096] @ centres.T).argmax(1) for s in range(0, len(x), 4096)])
    asked = np.random.default_rng(19).permutation(len(x))[:ASKED]
    place = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")  # of each list among a row's
    needed = []
    for row, i in zip(place, asked, strict=True):
        sims = x @ x[i]
        sims[i] = -np.inf
        needed.append(row[near[np.argsort(-sims, kind="stable")[: min(k, len(x) - 1)]]])
    return int(np.quantile(np.concatenate(needed), RECALL, method="higher")) + 1


@dataclass
class VectorIndex:
    """A stored index: ``path`` holds the lists (id, vec, matter_id, list); ``reach`` is the least cosine in each list, ``probes`` the lists that an approximate search reads."""

    path: str
    centres: np.ndarray
    reach: np.ndarray
    kinds: str
    probes: int
    table: DataFrame | None = None

    def points(self, spark) -> DataFrame:
        """The lists; their folders are looked up once."""
        if self.table is None:
            self.table = spark.read.schema(self.kinds).parquet(self.path)
        return self.table


def build(points: DataFrame, lists: int | None = None) -> VectorIndex:
    """Index ``points`` (id, vec, matter_id), all vectors of one length; null vectors are left out."""
    spark = points.sparkSession
    usable = points.filter("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"), "matter_id")
    n = usable.count()
    lists = lists or max(1, min(LISTS, n // LIST_POINTS))

    def fitted(batches):
        rows = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if rows:
            found = centroids(x := np.vstack(rows), lists)
            yield pa.RecordBatch.from_pydict({"c": pa.array(found.tolist(), pa.list_(pa.float64())), "probes": pa.array(np.full(len(found), probes_for(x, found, schema.RECALL_K), np.int32))})

    sample = usable.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("vec")
    made = sample.coalesce(1).mapInArrow(fitted, "c array<double>, probes int").collect()  # LISTS rows at most
    centres, probes = np.array([r.c for r in made]), made[0].probes if made else 1

    def assigned(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sims = _unit(_matrix(b.column(1))) @ centres.T
            near = sims.argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(sims[np.arange(len(near)), near])], names=["id", "vec", "matter_id", "list", "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usable.schema)
    held = materialize(usable.mapInArrow(assigned, f"{kinds}, list int, near double") if n else usable.selectExpr("*", "0 as list", "1D as near"), "ivf-assigned", spread=True)
    sizes = {r["list"]: (r.n, r.reach) for r in held.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("reach")).collect()}
    parts = {k: -(-size // PART_POINTS) for k, (size, _) in sizes.items() if size > PART_POINTS}
    salt = F.lit(0)
    if parts:
        share = F.try_element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("list"))
        salt = F.pmod(F.xxhash64("id"), F.coalesce(share, F.lit(1)).cast("long"))
    path = scratch_path(spark, "ivf-lists")
    # numbers by hash spread a list's parts over tasks even where few partitions are left
    held.drop("near").repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "list", salt).sortWithinPartitions("list").write.partitionBy("list").parquet(path)
    reach = np.array([sizes[k][1] if k in sizes else 1.0 for k in range(len(centres))])
    return VectorIndex(path, centres, np.clip(reach, -1, 1), f"{kinds}, list int", probes)


def search(index: VectorIndex, queries: DataFrame, k: int = schema.RECALL_K, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(qid, id, sim, rank) of the ``k`` nearest admissible points of each query (qid, vec, scope) in the lists read, ``probes`` of them or as many as the index found to be needed."""
    spark = queries.sparkSession
    kind = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.points(spark).schema['id'].dataType.simpleString()}, sim double"
    found = None
    for block in _blocks(queries.select("qid", "vec", "scope").filter("vec is not null")):
        asked = block.toPandas()  # QUERY_ROWS about
        if not len(asked) or not len(index.centres):
            continue
        q = _unit(np.array(asked["vec"].tolist(), float))
        sims = np.clip(q @ index.centres.T, -1, 1)
        first = np.argsort(-sims, axis=1, kind="stable")[:, : probes or index.probes]
        wanted = np.zeros(sims.shape, bool)
        np.put_along_axis(wanted, first, True, axis=1)
        hits = _read(spark, index, asked, q, wanted, k, kind)
        if exact:
            hits = materialize(hits, "ivf-first")
            floors = {r.qid: r.floor for r in _ranked(hits, k).groupBy("qid").agg(F.min("sim").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k).collect()}
            floor = np.array([floors.get(i, -2.0) for i in asked["qid"]])
            bound = np.cos(np.maximum(0.0, np.arccos(sims) - np.arccos(index.reach)[None, :]))
            more = ~wanted & (bound + 2 * 10.0**-PLACES >= floor[:, None])
            if more.any():
                hits = hits.unionByName(_read(spark, index, asked, q, more, k, kind))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"{kind}, rank int")
    return _ranked(found, k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))).filter(F.col("rank") <= k)


def _read(spark, index: VectorIndex, asked: pd.DataFrame, q: np.ndarray, wanted: np.ndarray, k: int, kind: str) -> DataFrame:
    """The ``k`` best points of each task for the queries that want its lists; only wanted folders are read."""
    lists = np.flatnonzero(wanted.any(0))
    qids, scopes = asked["qid"].to_numpy(), asked["scope"].to_numpy()
    groups = [(None, pd.isna(scopes)), *((s, scopes == s) for s in set(scopes[~pd.isna(scopes)]))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(qids), k)
        for f in frames:
            for number, whole in f.groupby("list"):
                for s in range(0, len(whole), POINT_ROWS):
                    part = whole.iloc[s : s + POINT_ROWS]
                    vecs, matter, ids = _unit(np.array(part["vec"].tolist(), float)), part["matter_id"].to_numpy(object), part["id"].to_numpy(object)
                    for scope, its in groups:
                        mine = np.flatnonzero(wanted[:, int(number)] & its)
                        seen = pd.isna(matter) | (False if scope is None else matter == scope)
                        if len(mine) and seen.any():
                            best.show(mine, np.round(q[mine] @ vecs[seen].T, PLACES), ids[seen])
        if len(best.who):
            yield best.frame(qids)

    return index.points(spark).filter(F.col("list").isin(*map(int, lists))).select("id", "vec", "matter_id", "list").mapInPandas(run, kind)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, n, met, recall): the share of each query's true hits (qid, id) that ``found`` has."""
    met = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    counted = met.groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("met"))
    return counted.withColumn("recall", F.col("met") / F.col("n"))
