"""Session defaults and the shared scratch folder that iterative operators use to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.autoBroadcastJoinThreshold", "10m")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    Where it is unset: the warehouse, except in a ``local`` master, whose
    executors live in the driver and so may use a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="plinth-"))
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_plinth_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/plinth-{os.getpid()}-{uuid.uuid4().hex[:12]}-{label}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, spread: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: lineage ends there and survives executors.

    ``spread`` keeps the plan's own partitions, for steps whose work lies in
    the tasks that write; others write in fewer files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if not spread:
        # no more files than four rounds of tasks over all cores, or an eighth of the shuffle partitions, need
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _MADE:
        with suppress(Exception):
            drop_path(spark, path)
