"""Keyed tables that are updated in place: hashed buckets, versioned manifests, one rename a commit.

``path/data/<writer>/bucket=<b>`` holds a bucket as some upsert wrote it;
``path/manifest/<version>`` lists which writer's folder each bucket has in
that version. An upsert reads and rewrites the buckets that its keys fall in,
into a folder of its own, and becomes visible when its manifest is renamed
into place. Readers see one whole version: until the rename the former one,
whatever has been written. A writer that dies before it leaves a folder that
nothing names; one that comes second finds its version taken and fails, or
tries again on the newer one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import drop_path

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class KeyedTable:
    """A table with one row for each value of ``key``.

    ``schema``: its columns (DDL), the key among them. The number of buckets is
    fixed when the table is made: some for each task that should share an
    upsert of all keys.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(place)) if self._files.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifest") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> writer of a version, the latest where none is given; at most ``buckets`` entries."""
        known = self.versions()
        if version is None and not known:
            return {}
        rows = self.spark.read.schema("bucket int, writer string").json(f"{self.path}/manifest/{known[-1] if version is None else version}").collect()
        return {r.bucket: r.writer for r in rows}

    def _read(self, held: dict[int, str]) -> DataFrame:
        """Rows of the buckets in ``held``, with their bucket."""
        kinds = f"{self.schema}, bucket int"
        writers: dict[str, list[int]] = {}
        for bucket, writer in held.items():
            writers.setdefault(writer, []).append(bucket)
        out = self.spark.createDataFrame([], kinds)
        for writer, mine in sorted(writers.items()):
            out = out.unionByName(self.spark.read.schema(kinds).parquet(f"{self.path}/data/{writer}").filter(F.col("bucket").isin(*mine)))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)).drop("bucket")

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, order: str | None = None, merge: bool = False) -> int:
        """Store ``rows`` in place of those with equal keys; returns the new version.

        Of several new rows with one key the one greatest by ``order`` counts
        (by all columns where it is None or ties). ``merge``: null fields of
        the new row keep what was stored. Rows without a key are left out.
        """
        base = self.versions()[-1] if self.versions() else -1
        held = self.manifest(base) if base >= 0 else {}
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        fresh = rows.filter(F.col(self.key).isNotNull())
        rank = F.struct(*([F.col(order)] if order else []), *(F.col(n) for n in names))
        latest = fresh.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names), rank).alias("_row")).select("_row.*")
        latest = latest.withColumn("bucket", self.bucket_of(F.col(self.key)))
        touched = [r.bucket for r in fresh.select(self.bucket_of(F.col(self.key)).alias("bucket")).distinct().collect()]
        if not touched:
            return base
        old = self._read({b: w for b, w in held.items() if b in touched})
        if merge:
            met = old.alias("o").join(latest.alias("n"), ["bucket", self.key], "full_outer")
            kept = [F.col(self.key) if n == self.key else F.coalesce(f"n.{n}", f"o.{n}").alias(n) for n in names]
            written = met.select(*kept, "bucket")
        else:
            written = old.join(latest.select("bucket", self.key), ["bucket", self.key], "left_anti").unionByName(latest)
        writer = uuid.uuid4().hex
        written.select(*names, "bucket").repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{writer}")
        self._commit(base + 1, held | dict.fromkeys(touched, writer))
        return base + 1

    def _commit(self, version: int, held: dict[int, str]) -> None:
        aside = f"{self.path}/manifest/.{version}-{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(held.items()), "bucket int, writer string").coalesce(1).write.json(aside)
        final = self._path(f"{self.path}/manifest/{version}")
        if self._files.exists(final) or not self._files.rename(self._path(aside), final):
            drop_path(self.spark, aside)
            raise Conflict(f"version {version} of {self.path} was committed meanwhile")

    def upsert_retrying(self, rows: DataFrame, order: str | None = None, merge: bool = False, times: int = 5) -> int:
        """:meth:`upsert`, again on the newer version after a conflict."""
        for left in reversed(range(times)):
            try:
                return self.upsert(rows, order, merge)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drop all but the last ``keep`` manifests and the folders that none of these names; no writer may be at work."""
        known = self.versions()
        for version in known[:-keep]:
            drop_path(self.spark, f"{self.path}/manifest/{version}")
        live = {w for v in known[-keep:] for w in self.manifest(v).values()}
        gone = [w for w in self._names("data") if w not in live]
        for writer in gone:
            drop_path(self.spark, f"{self.path}/data/{writer}")
        return gone
