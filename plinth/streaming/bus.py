"""Event streams: typed routing, dead letters, windowed counts and keyed trace histories on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth import schema

# ---- fixed values: stream names by stage --------------------------------------------------------
STREAMS = (
    "ingest.request", "ingest.completed", "segment.completed", "enrich.completed", "graph.written", "index.completed", "query.request", "retrieval.completed", "generation.completed", "eval.request", "eval.completed",
)
#: Events kept per trace, idle seconds before a trace is forgotten (fixed defaults).
HISTORY, IDLE_S = 512, 900


# ---- fixed values: fields of the eight typed events, beside those that all events have -------------------
ENVELOPE = "event_type string, trace_id string, tenant_id string, matter_id string"
EVENT_FIELDS = {
    "ingest.request": "source string, adapter string, upload_uri string, upload_bucket string, upload_key string, upload_filename string, upload_mime string, upload_sha256 string, upload_size bigint",
    "ingest.completed": "raw_document map<string,string>, episode map<string,string>",
    "segment.completed": "episode_id string, spans array<map<string,string>>, hints map<string,string>",
    "enrich.completed": "episode_id string, nodes array<map<string,string>>, edges array<map<string,string>>",
    "graph.written": "episode_id string, node_ids array<string>, edge_count bigint, indexable array<map<string,string>>",
    "query.request": "question string, matter_scope string, filters map<string,string>, mode string",
    "query.evidence_pack": "pack map<string,string>",
    "query.answer": "answer map<string,string>",
}
#: Fields that an event of a type cannot lack.
EVENT_NEEDS = {
    "ingest.request": ("source",), "ingest.completed": ("raw_document", "episode"), "segment.completed": ("episode_id", "spans"), "enrich.completed": ("episode_id", "nodes", "edges"),
    "graph.written": ("episode_id", "node_ids", "edge_count"), "query.request": ("question",), "query.evidence_pack": ("pack",), "query.answer": ("answer",),
}


def events(spark: SparkSession, path: str, max_files: int = 8, newer_than: str | None = None) -> DataFrame:
    """An unbounded read of an event folder; with ``newer_than`` (a timestamp) only of files written after it."""
    stream = spark.readStream.schema(schema.EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
    if newer_than is None:
        return stream.select(*_event_columns())
    return stream.filter(F.col("_metadata.file_modification_time") > F.lit(newer_than).cast("timestamp")).select(*_event_columns())


def _event_columns() -> list[str]:
    """Fields of the event schema; stages' output folders add query and epoch."""
    return schema.EVENT_SCHEMA.fieldNames()


def from_now_on(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """What arrives from this call on, as a new group of consumers sees it; earlier events stay unread."""
    now = spark.sql("select cast(current_timestamp() as string) as t").first().t
    return events(spark, path, max_files, now)


def typed(raw: DataFrame) -> DataFrame:
    """Events with ``k`` read from their JSON properties; unreadable ones keep null and say why."""
    k = F.try_element_at(F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"}), F.lit("k")).cast("string")
    number = k.try_cast("int")
    return raw.withColumn("k", number).withColumn("problem", F.when(F.col("event_type").isNull(), "no_type").when(number.isNull(), "bad_props"))


def typed_events(messages: DataFrame) -> DataFrame:
    """``messages`` (data: one JSON event each) with the envelope, ``kind`` and one struct for each known type.

    ``kind`` is the event's type if it is one of the eight, ``generic`` for
    other types, and ``unknown`` where the JSON cannot be read or lacks what
    its type needs; such a row has event_type and trace_id ``unknown``.
    """
    envelope = F.from_json("data", ENVELOPE)
    out = messages.withColumn("e", envelope)
    fits = F.lit(False)
    for name, fields in EVENT_FIELDS.items():
        column = name.replace(".", "_")
        mine = F.col("e.event_type") == name
        out = out.withColumn(column, F.when(mine, F.from_json("data", fields)))
        whole = F.lit(True)
        for field in EVENT_NEEDS[name]:
            whole = whole & F.col(f"{column}.{field}").isNotNull()
        fits = fits | (mine & whole)
    other = F.col("e.event_type").isNotNull() & ~F.col("e.event_type").isin(*EVENT_FIELDS) & F.col("e.trace_id").isNotNull()
    fits = fits & F.col("e.trace_id").isNotNull()
    kind = F.when(fits, F.col("e.event_type")).when(other, "generic").otherwise("unknown")
    out = out.withColumn("kind", F.coalesce(kind, F.lit("unknown")))
    read = F.col("kind") != "unknown"
    columns = [F.when(read, F.col(c)).alias(c) for c in (n.replace(".", "_") for n in EVENT_FIELDS)]
    names = [c for c in messages.columns]
    return out.select(*names, "kind", F.when(read, F.col("e.event_type")).otherwise("unknown").alias("event_type"), F.when(read, F.col("e.trace_id")).otherwise("unknown").alias("trace_id"), F.col("e.tenant_id").alias("tenant_id"), F.col("e.matter_id").alias("matter_id"), *columns)


def split_dead(stream: DataFrame, fails: Column) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters): an event that fails is acknowledged once and set aside."""
    return stream.filter(~F.coalesce(fails, F.lit(False))), stream.filter(F.coalesce(fails, F.lit(False)))


#: Halvings of a failing batch, by the bits of its keys' hashes.
SPLITS = 64

# fixed values: what Spark says when a machine and not a row is at fault
INFRASTRUCTURE = ("ExecutorLostFailure", "ExecutorDeadException", "FetchFailed", "No space left", "OutOfMemoryError", "MemoryError", "Connection reset", "Connection refused", "Python worker exited unexpectedly", "Python worker failed to connect", "SparkContext was shut down", "cancelled", "killed", "Stage cancelled")


def to_blame(problem: BaseException) -> bool:
    """Whether the rows are at fault: the handler's own exceptions and errors of values are theirs, lost executors, full disks and memory are not."""
    if isinstance(problem, OSError | MemoryError | ConnectionError):
        return False
    return not any(sign in str(problem) for sign in INFRASTRUCTURE)


class EpochFolder:
    """Output of a streaming query by (query, epoch): an epoch's folder appears whole, by one rename, or not at all."""

    def __init__(self, spark: SparkSession, path: str, query: str, epoch: int) -> None:
        self.path = path.rstrip("/")
        self.spark, self.final, self.aside = spark, f"{self.path}/query={query}/epoch={epoch}", f"{self.path}/_pending/{query}-{epoch}"
        self._path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self) -> bool:
        return self._files.exists(self._path(self.final))

    def clear(self) -> None:
        self._files.delete(self._path(self.aside), True)

    def write(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.aside)

    def publish(self) -> None:
        for place in (self.aside, self.final.rpartition("/")[0]):
            self._files.mkdirs(self._path(place))
        if not self._files.rename(self._path(self.aside), self._path(self.final)):
            raise OSError(f"{self.final} could not be published")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps with its checkpoint over restarts."""
    return spark.read.json(f"{checkpoint}/metadata").first().id


def run_stage(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str, key: str = "event_id") -> None:
    """Drain what has arrived: handled rows go to ``out``, rows that make the handler fail to ``dead``, and the stream moves on.

    Both are written by (query, epoch): an epoch that Spark replays after a
    crash is left alone if its output is there, and else written anew, so each
    event's output is there once. A batch that raises is halved by the hash of
    ``key`` until the rows that are to blame stand alone; the others are
    handled. What is not the rows' fault (see :func:`to_blame`) ends the stage
    with its exception, and the epoch is replayed by the next run.
    """
    spark = stream.sparkSession

    def attempt(rows: DataFrame, bit: int, good: EpochFolder, bad: EpochFolder) -> None:
        try:
            good.write(handler(rows))  # a job that fails leaves no files
            return
        except Exception as problem:
            if not to_blame(problem):
                raise
            reason = type(problem).__name__
        if rows.select(key).distinct().limit(2).count() < 2:
            bad.write(rows.withColumn("problem", F.lit(reason)))
            return
        if bit < SPLITS:
            side = F.shiftrightunsigned(F.xxhash64(key), bit).bitwiseAND(F.lit(1))
            parts = [rows.filter(side == half) for half in (0, 1)]
        else:  # different keys with one hash
            parts = [rows.filter(F.col(key).eqNullSafe(F.lit(k[0]))) for k in rows.select(key).distinct().collect()]
        for part in parts:
            if part.limit(1).count():
                attempt(part, bit + 1, good, bad)

    def batch(rows: DataFrame, epoch: int) -> None:
        query = query_id(spark, checkpoint)
        good, bad = (EpochFolder(spark, path, query, epoch) for path in (out, dead))
        if good.done():
            return
        good.clear()
        bad.clear()
        held = rows.persist()
        try:
            attempt(held, 0, good, bad)
        finally:
            held.unpersist()
        if not bad.done():  # a replay whose dead letters were published before the crash
            bad.publish()
        good.publish()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@dataclass
class Stage:
    """One agent: what it listens to, what it publishes, and what it makes of a batch."""

    name: str
    listens: str
    publishes: str
    handler: Callable[[DataFrame], DataFrame]


def run_stages(spark: SparkSession, stages: list[Stage], root: str, expected: dict[str, int] | None = None, timeout_s: float = 60.0) -> dict[str, int]:
    """Let every stage work through its stream below ``root`` until nothing new arrives; returns the events of each stream.

    Streams are folders ``root/<stream>``; a handler returns rows of the event
    schema. Rounds go on while a stage publishes, until each stream in
    ``expected`` holds as many events as that, or ``timeout_s`` has passed.
    """
    ends = time.monotonic() + timeout_s
    path = lambda stream: f"{root}/{stream}"
    streams = sorted({s for stage in stages for s in (stage.listens, stage.publishes)})

    def sizes() -> dict[str, int]:
        return {s: spark.read.schema(schema.EVENT_SCHEMA).parquet(path(s)).count() if _there(spark, path(s)) else 0 for s in streams}

    before, now = {}, sizes()
    while now != before and time.monotonic() < ends and not (expected and all(now.get(s, 0) >= n for s, n in expected.items())):
        before = now
        for stage in stages:
            if _there(spark, path(stage.listens)):
                run_stage(events(spark, path(stage.listens)), stage.handler, path(stage.publishes), f"{root}/dead/{stage.name}", f"{root}/checkpoints/{stage.name}")
        now = sizes()
    return now


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def answered_within(requests: DataFrame, answers: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, request_id, answer_id, asked, answered): each request with the answers of its user in the time after it.

    On streams both sides have a watermark, so that what cannot meet any more
    leaves the state; what comes later than ``late`` is dropped.
    """
    one = requests.select("user_id", F.col("event_id").alias("request_id"), F.col("ts").alias("asked"))
    two = answers.select(F.col("user_id").alias("answer_user"), F.col("event_id").alias("answer_id"), F.col("ts").alias("answered"))
    if requests.isStreaming:
        one, two = one.withWatermark("asked", late), two.withWatermark("answered", late)
    met = (F.col("user_id") == F.col("answer_user")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"interval {within}"))
    return one.join(two, met).select("user_id", "request_id", "answer_id", "asked", "answered")


def tumbling(rows: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts by window; on a stream late rows past the watermark are dropped."""
    marked = rows.withWatermark("ts", late) if late and rows.isStreaming else rows
    out = marked.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(rows: DataFrame, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    out = rows.groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def sessions(rows: DataFrame, gap_s: int = IDLE_S) -> DataFrame:
    """(user_id, start, n): sessions that end after ``gap_s`` idle seconds."""
    marked = rows.withWatermark("ts", f"{gap_s} seconds") if rows.isStreaming else rows
    out = marked.groupBy("user_id", F.session_window("ts", f"{gap_s} seconds")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def last_events(rows: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The latest ``keep`` events of each trace: the batch form of :func:`trace_history`."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return ranked.filter(F.col("_k") <= keep).drop("_k")


def trace_history(stream: DataFrame, keep: int = HISTORY, idle_s: int = IDLE_S) -> DataFrame:
    """(user_id, n_kept, last_event): per trace a ring of its last ``keep`` events, forgotten once event time is ``idle_s`` seconds past its last one."""
    out, state = "user_id long, n_kept int, last_event long", "ids array<long>"

    def update(key: tuple, frames: Iterable[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        ring, latest = (list(group.get[0]) if group.exists else []), group.getCurrentWatermarkMs()
        for f in frames:
            latest = max(latest, int(f["ts"].max().timestamp() * 1000))
            ring = (ring + f.sort_values(["ts", "event_id"])["event_id"].tolist())[-keep:]
        group.update((ring,))
        group.setTimeoutTimestamp(latest + idle_s * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "n_kept": [len(ring)], "last_event": [ring[-1]]})

    return stream.withWatermark("ts", f"{idle_s} seconds").groupBy("user_id").applyInPandasWithState(update, out, state, "update", "EventTimeTimeout")


def once(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each content hash once: redelivered events are dropped while the watermark remembers them."""
    keyed = stream.withColumn("digest", F.sha2(F.concat_ws("|", "event_type", "user_id", "value", "props"), 256))
    return keyed.withWatermark("ts", within).dropDuplicatesWithinWatermark(["digest"]) if stream.isStreaming else keyed.dropDuplicates(["digest"])


def server_sent(row: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(row), F.lit("\n\n"))
