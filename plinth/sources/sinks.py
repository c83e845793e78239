"""Sinks: audit lines, reports, copy-if-absent and replace-by-key writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import drop_path


def audit_line(*names: str) -> Column:
    """One JSON object per row; null fields are left out."""
    return F.to_json(F.struct(*names))


def write_audit(rows: DataFrame, path: str) -> None:
    """Append to one folder per day."""
    rows.withColumn("date", F.to_date("created_at")).write.mode("append").partitionBy("date").json(path)


def absent(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target does not have yet."""
    return rows.join(existing.select(key), key, "left_anti")


def replace_by_key(old: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """Write ``old`` with the rows of ``new`` in place of those with equal keys, then swap the folder.

    The whole table is written; :class:`plinth.sources.upsert.KeyedTable`
    rewrites only the buckets that change and never hides the table. Here the
    former folder is kept as ``.previous`` until the new one stands; a run
    that finds only that one puts it back first.
    """
    spark = old.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = path.rstrip("/")
    here, side, previous = place(base), place(base + ".next"), place(base + ".previous")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(here) and fs.exists(previous):
        fs.rename(previous, here)
    merged = old.join(new.select(key), key, "left_anti").unionByName(new)
    merged.write.mode("overwrite").parquet(base + ".next")
    drop_path(spark, base + ".previous")
    if fs.exists(here):
        fs.rename(here, previous)
    fs.rename(side, here)
    drop_path(spark, base + ".previous")


def report_json(summary: DataFrame) -> DataFrame:
    return summary.select("dataset", F.to_json(F.struct(*[c for c in summary.columns if c != "dataset"])).alias("report"))


def episode_text(name: Column, body: Column, most: int = 2000) -> Column:
    return F.substring(F.concat_ws(" — ", name, body), 1, most)


class Mirror:
    """Episodes copied to an outside knowledge graph, and its search hits.

    ``connect`` gives an object with ``add(episodes: DataFrame)`` and
    ``search(questions: DataFrame) -> DataFrame (qid, node, tier, score, excerpt)``;
    where it is None or fails, nothing is added and nothing found.
    """

    def __init__(self, connect: Callable[[], object] | None = None) -> None:
        try:
            self._there = connect() if connect else None
        except Exception:
            self._there = None

    @property
    def available(self) -> bool:
        return self._there is not None

    def add(self, episodes: DataFrame) -> None:
        """``episodes``: name, body, source_description, group_id; bodies go as :func:`episode_text`."""
        if self._there is not None:
            self._there.add(episodes.withColumn("body", episode_text(F.col("name"), F.col("body"))))

    def search(self, questions: DataFrame) -> DataFrame:
        empty = questions.sparkSession.createDataFrame([], f"qid {questions.schema['qid'].dataType.simpleString()}, node string, tier int, score double, excerpt string")
        if self._there is None:
            return empty
        try:
            return self._there.search(questions).select(*empty.columns)
        except Exception:
            return empty
