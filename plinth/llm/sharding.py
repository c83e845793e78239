"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots. Bytes and rows are summed for
each slot; a versioned map assigns every slot to a shard. The map is a stored
table: :class:`MapStore` keeps each version, a run follows the latest one, and
rebalancing edits it and stores the edit as the next version instead of
rehashing records. Law: ``bytes`` (shard sizes are near equal).

A key's rows lie in one slot, unless more than HOT_ROWS rows share the key:
those hash by key, content and a number among equal rows, so that neither a
slot nor a task grows with one id or one text. Equal rows are interchangeable,
so the placement depends on the rows alone and not on how they are dealt to
tasks. Groups of equal texts with different ids hash by their ids: they are
not kept together and may lie in all shards.

Defined cases: a null text counts as empty (8 bytes, crc 0); a null id hashes
by its text; repeated rows are placed together and each takes a position; a
very long text counts with all its bytes and is never cut;
an empty table gives no rows. Columns of the input whose names clash with
the output's are dropped first.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.llm.sizes import bounded
from plinth.session import drop_path, materialize, scratch_path

VIRTUAL_SLOTS = 8192
SHARDS = 24
#: Rows of one key from which on they are dealt over all slots.
HOT_ROWS = 100_000
#: Equal rows of such a key that one task numbers.
PIECE = 10_000


def record_key(doc_id: Column, text_crc: Column) -> Column:
    """What decides a record's slot: its id, and its text where the id is null."""
    return F.when(doc_id.isNull(), F.xxhash64(text_crc)).otherwise(F.xxhash64(doc_id.cast("string")))


def virtual_slot(key: Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(key, F.lit(slots)).cast("int")


def initial_map(slot_bytes: list[int], shards: int) -> list[int]:
    """Version 0: largest slots first, each to the lightest shard so far (ties: lowest shard, lowest slot)."""
    heap = [(0, shard) for shard in range(shards)]
    slot_map = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
        load, shard = heapq.heappop(heap)
        slot_map[slot] = shard
        heapq.heappush(heap, (load + slot_bytes[slot], shard))
    return slot_map


def rebalanced_map(slot_map: list[int], slot_bytes: list[int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The next version for ``shards`` shards: moves as few slots as bring every load within tolerance of the mean.

    Slots leave the heaviest shard for the lightest one while that narrows
    their gap; slots of shards that no longer exist are placed first. All
    other slots stay where they are.
    """
    edited = list(slot_map)
    load = [0] * shards
    homeless = []
    for slot, shard in enumerate(edited):
        if shard < shards:
            load[shard] += slot_bytes[slot]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-slot_bytes[s], s)):
        shard = min(range(shards), key=lambda s: (load[s], s))
        edited[slot], load[shard] = shard, load[shard] + slot_bytes[slot]
    mean = sum(load) / shards
    for _ in range(len(edited)):
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            break
        fits = [s for s, shard in enumerate(edited) if shard == high and 0 < slot_bytes[s] < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        edited[slot] = low
        load[high] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
    return edited


ADDED = ("size", "text_crc32", "vslot", "law", "shard", "slot", "grown_shard")


class MapStore:
    """Versions of a slot map under one path: a folder for each, complete from the moment it is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._files.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.path))]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def read(self, version: int) -> list[int]:
        rows = self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/version={version}").collect()
        return [r.shard for r in sorted(rows)]

    def latest(self) -> list[int] | None:
        known = self.versions()
        return self.read(known[-1]) if known else None

    def append(self, slot_map: list[int]) -> int:
        """Write the next version aside and rename it into place; a writer that comes second fails."""
        version = (self.versions() or [-1])[-1] + 1
        aside = f"{self.path}/.writing-{version}"
        map_table(self.spark, [slot_map]).select("vslot", "shard").write.mode("overwrite").parquet(aside)
        final = self._path(f"{self.path}/version={version}")
        if self._files.exists(final) or not self._files.rename(self._path(aside), final):
            drop_path(self.spark, aside)
            raise FileExistsError(f"version {version} of {self.path} was stored meanwhile")
        return version


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, size, text_crc32, key and vslot of each row; ``kept`` holds the columns as one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.struct(*(F.col(f"`{c}`") for c in keep if c not in ADDED))
    rows = docs.select(kept.alias("kept"), F.col("doc_id").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = rows.withColumn("key", record_key(F.col("id"), F.col("text_crc32")))
    return keyed.withColumn("vslot", virtual_slot(F.col("key")))


def slot_totals(records: DataFrame, slots: int = VIRTUAL_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot; ``slots`` numbers at most reach the driver, whatever the input."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], rows[r.vslot] = r.b, r.n
    return size, rows


def dealt(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``records`` with the rows of keys that more than ``hot_rows`` rows share dealt over all slots.

    Equal rows are counted, on the map side first, and come back numbered from
    their count, in pieces of ``PIECE`` rows that are dealt to tasks.
    """
    hot = materialize(records.groupBy("key").count().filter(F.col("count") > hot_rows).select(F.col("key").alias("hot")), "shard-hot")
    if not hot.limit(1).count():
        return records
    side = bounded(hot)
    equal = records.join(side, records["key"] == side["hot"], "left_semi").groupBy(*records.columns).agg(F.count("*").alias("n"))
    pieces = equal.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    pieces = pieces.repartition(F.xxhash64("key", "kept", "from"))
    each = pieces.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + PIECE, F.col("n")) - 1)))
    spread = each.withColumn("vslot", virtual_slot(F.xxhash64("key", "kept", "text_crc32", "nth"))).select(*records.columns)
    return records.join(side, records["key"] == side["hot"], "left_anti").unionByName(materialize(spread, "shard-dealt"))


def _lookup(values: list[int], index: Column, kind: str) -> Column:
    """``values[index]`` as a constant array: at most VIRTUAL_SLOTS numbers inside the plan."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), index + 1).cast(kind)


def map_table(spark, versions: list[list[int]]) -> DataFrame:
    """(version, vslot, shard): the stored form of the map and its edits."""
    n = len(versions[0])
    parts = [spark.range(0, n, 1, 1).select(F.lit(v).alias("version"), F.col("id").cast("int").alias("vslot"), _lookup(m, F.col("id").cast("int"), "int").alias("shard")) for v, m in enumerate(versions)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def place(records: DataFrame, slot_map: list[int], slot_rows: list[int], seed: int | None = None) -> DataFrame:
    """Shard of each record, and its gapless position in the shard.

    A slot's records are numbered on their own; the rows of the shard's
    earlier slots are added, so no task sorts a whole shard. In a slot the
    order is by id, or with a ``seed`` by a hash in which each of several
    equal rows has a place of its own.
    """
    ahead, seen = [], {}
    for slot, shard in enumerate(slot_map):
        ahead.append(seen.get(shard, 0))
        seen[shard] = ahead[-1] + slot_rows[slot]
    order = ["id", "text_crc32", "size"]
    if seed is not None:
        others = [f"kept.`{c}`" for c in records.schema["kept"].dataType.names if c not in ("doc_id", "text")]
        tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
        records = records.withColumn("nth", F.row_number().over(Window.partitionBy("vslot", "id", "text_crc32").orderBy(tie)))
        order = [F.xxhash64(F.lit(seed), F.col("id"), F.col("text_crc32"), F.col("nth")), *order, "nth"]
    elif len(records.schema["kept"].dataType.names) > 1:
        order.append(F.xxhash64("kept"))
    own = F.row_number().over(Window.partitionBy("vslot").orderBy(*order))
    return records.withColumn("own", (own - 1).cast("long")).select(
        "kept.*", "size", "text_crc32", F.lit("bytes").alias("law"), _lookup(slot_map, F.col("vslot"), "int").alias("shard"),
        (F.col("own") + _lookup(ahead, F.col("vslot"), "long")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def shard(docs: DataFrame, shards: int = SHARDS, store: MapStore | None = None, keep: tuple[str, ...] = ("doc_id",), seed: int | None = None, tolerance: float = 0.01, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Place all rows by the latest map of ``store``.

    A store without versions gets version 0, made from the slots' bytes; where
    the latest version leaves a shard off the mean by more than ``tolerance``,
    or was made for other shards, its edit becomes the next version. Without
    a store the map lives as long as the driver, in the shared folder.
    """
    spark = docs.sparkSession
    store = store or MapStore(spark, scratch_path(spark, "slot-map"))
    records = sized(docs, keep)
    size, rows = slot_totals(records)
    if max(rows) > hot_rows:
        records = dealt(records, hot_rows)
        size, rows = slot_totals(records)
    present = store.latest()
    wanted = initial_map(size, shards) if present is None else rebalanced_map(present, size, shards, tolerance)
    if wanted != present:
        store.append(wanted)
    return place(records, store.latest(), rows, seed)
