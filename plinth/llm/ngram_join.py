"""Exact n-gram Jaccard self-join by set relations.

A document is the set of its distinct 5-word shingles; two link at a Jaccard
similarity of 3/4 or more. The steps:

1. Rows with equal sets fold into one class, named by its least doc_id.
2. Shingles of the classes go, packed, to buckets by their hash. A bucket
   counts the classes of each shingle and returns those that two or more
   share; the others can never match and serve only as the first positions
   of a class's order (rare shingles first).
3. Index lists hold only the prefix that any linked pair must meet in. Lists
   lie in blocks by set size and entries know their position; a probe visits
   the blocks its size reaches and skips entries whose position leaves too
   few shingles to come.
4. Relations: each class is compared with the least class of its lists'
   blocks, its leader. What a leader's comparison says about another leader
   bounds the answers of all members within their differences from their
   leaders: group pairs that link through their leaders, or cannot link
   however the differences fall, are settled without comparing members.
   Pairs of members left open are compared exactly.

Every link is verified by its exact overlap; groups of near copies are tied
by one link to their leader each, so no list is ever expanded into all pairs
of one group. Shingles are held as 64-bit hashes.

Defined cases: null texts and texts without words have an empty set and link
with nothing; fewer than five words form one shingle; a null doc_id keeps its
row, with a null component, and links with nothing; rows that share a doc_id
are one document for links (the row with the least digest stands for it);
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import hashing
from plinth.llm.components import components, small
from plinth.session import materialize

SHINGLE = 5
#: A pair links when NUM * (sizes' sum) <= DEN * overlap, which is Jaccard >= NUM / (DEN - NUM) = 3/4.
NUM, DEN = 3, 7
#: Shingles that one bucket holds on average, and that a task packs at once.
BUCKET_SHINGLES = 1_000_000
PACK_SHINGLES = 1_000_000
#: Buckets that one pack is dealt to at most; beyond, packs go to coarse buckets first and are dealt again there, so that blocks stay long.
FAN = 2_000
#: A shingle that more classes than this may have is heavy: its entries skip the buckets, so no bucket grows with a shingle that all texts share.
HEAVY = 1_000_000
#: One in so many classes is looked at to find the heavy shingles, and so many of them are named at most, the most frequent ones.
HEAVY_SAMPLE, HEAVY_NAMED = 64, 1_000_000
#: Size blocks: a little above 4/3, so that a pair within the size window is never two blocks apart.
BLOCK_BASE = 1.34


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, hashes, rows in hashing.words(column):
        yield a, b, *hashing.distinct(*hashing.grams(hashes, rows, SHINGLE))


def _digests(batches):
    """doc_id, text hash, n, and a 128-bit digest of each row's shingle set."""
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        n, x, y = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        for a, b, values, rows in _sets(text):
            n[a:b] = np.bincount(rows - a, minlength=b - a)
            if len(values):
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                x[rows[first]] = np.add.reduceat(hashing.mix(values + np.uint64(0x5851F42D4C957F2D)), first)
                y[rows[first]] = np.add.reduceat(hashing.mix(values ^ np.uint64(0x14057B7EF767814F)), first)
        yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["doc_id", "h", "n", "x", "y"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def digests(docs: DataFrame) -> DataFrame:
    return _rows(docs).mapInArrow(_digests, "doc_id long, h long, n long, x long, y long")


def _packed(values: np.ndarray, owners: np.ndarray, buckets: int, coarse: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of (bucket, owners, counts, shingles); ``coarse`` folds the buckets, 0 keeps them."""
    bucket = ((values >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    if coarse:
        bucket %= coarse
    order = np.argsort(bucket, kind="stable")
    bucket, who, values = bucket[order], owners[order], values[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    for s, e in zip(starts, np.r_[starts[1:], len(bucket)].astype(np.int64), strict=False):
        first = np.flatnonzero(np.r_[True, who[s + 1 : e] != who[s : e - 1]])
        counts = np.diff(np.r_[first, e - s]).astype(np.uint32)
        yield int(bucket[s]), np.array([len(first)], dtype=np.int64).tobytes() + who[s:e][first].astype(np.int64).tobytes() + counts.tobytes() + values[s:e].tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(owner, shingle) of a block."""
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    who, counts = np.frombuffer(blob, np.int64, k, 8), np.frombuffer(blob, np.uint32, k, 8 + 8 * k)
    return np.repeat(who, counts), np.frombuffer(blob[8 + 12 * k :], np.uint64)


def _pack_all(pairs: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int, coarse: int):
    """Record batches of blocks from a stream of (shingles, owners), PACK_SHINGLES at a time."""
    values, owners, held = [], [], 0

    def flush():
        rows = list(_packed(np.concatenate(values), np.concatenate(owners), buckets, coarse))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["bucket", "block"])

    for v, who in pairs:
        values.append(v)
        owners.append(who)
        held += len(v)
        if held >= PACK_SHINGLES:
            yield flush()
            values, owners, held = [], [], 0
    if held:
        yield flush()
    pa.default_memory_pool().release_unused()


def _to_buckets(buckets: int, coarse: int, heavy: np.ndarray):
    """Blocks of all shingles but the ``heavy`` ones."""

    def pairs(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for _, _, v, rows in _sets(batch.column(1)):
                light = ~_is_heavy(heavy, v)
                yield v[light], ids[rows[light]]

    return lambda batches: _pack_all(pairs(batches), buckets, coarse)


def _dealt_again(buckets: int):
    def pairs(batches):
        for batch in batches:
            for blob in batch.column(1):
                who, values = _unpacked(blob.as_py())
                yield values, who

    return lambda batches: _pack_all(pairs(batches), buckets, 0)


def _by_home(who: np.ndarray, token: np.ndarray, df: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(home, packed classes, shingles and counts): a class's home is named by its hash."""
    home = (hashing.mix(who.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((who, home))
    who, token, df, home = who[order], token[order], df[order], home[order]
    starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(home)].astype(np.int64)
    return [(int(home[s]), np.concatenate([who[s:e], token[s:e], df[s:e]]).tobytes()) for s, e in zip(starts, ends, strict=False)]


def _shared(buckets: int):
    """From a bucket's blocks: the shingles that two or more classes have, with their class counts, packed by class."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(b.as_py()) for b in table.column("block")]
        who, token = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        order = np.argsort(token, kind="stable")
        run_of = token[order]
        repeated = np.zeros(len(run_of), bool)
        repeated[1:] = run_of[1:] == run_of[:-1]
        repeated[:-1] |= repeated[1:]
        who, token = who[order][repeated], run_of[repeated]
        who, token = hashing.distinct(who, token)  # by (shingle, class): a class repeated by equal rows counts once
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(token)])
        df = np.repeat(size, size).astype(np.int64)
        keep = df > 1
        who, token, df = who[keep], token[keep].view(np.int64), df[keep]
        rows = _by_home(who, token, df, buckets)
        return pa.table({"home": pa.array([k for k, _ in rows], pa.int64()), "block": pa.array([b for _, b in rows], pa.binary())})

    return run


def _ordered(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """For each class that keeps a prefix: its shared shingles, rare first, and how many of them are its prefix."""
    empty = {"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "tokens": pa.array([], pa.list_(pa.int64())), "prefix": pa.array([], pa.int32())}
    if not left.num_rows or not right.num_rows:
        return pa.table(empty)
    flat = [np.frombuffer(b.as_py(), np.int64).reshape(3, -1) for b in left.column("block")]
    who, token, df = (np.concatenate([f[i] for f in flat]) for i in range(3))
    order = np.lexsort((token, df, who))
    who, token = who[order], token[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    count = np.diff(np.r_[first, len(who)])
    ids, sizes = right.column("node").to_numpy(), right.column("n").to_numpy()
    by_id = np.argsort(ids, kind="stable")
    n = sizes[by_id][np.searchsorted(ids[by_id], who[first])]
    prefix = (n - (NUM * n + NUM) // (DEN - NUM) + 1) - (n - count)
    keep = prefix > 0
    kept = np.repeat(keep, count)
    offsets = np.r_[0, np.cumsum(count[keep])].astype(np.int32)
    return pa.table({"node": who[first][keep], "n": n[keep], "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[kept])), "prefix": prefix[keep].astype(np.int32)})


def heavy_shingles(rows: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, in order, that more than HEAVY classes are likely to have, and about how many do.

    They are counted in one of HEAVY_SAMPLE classes and named from half of
    HEAVY on, so one with more than HEAVY owners is missed with a chance that
    is nil; where it was, only its bucket would be larger. The choice steers
    the work and leaves the results alone: a heavy shingle is shared, and any
    count that all classes agree on may rank it. With no more than HEAVY
    classes there is none, and nothing is read.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if classes <= HEAVY:
        return none

    def counted(batches):
        for batch in batches:
            for _, _, values, _ in _sets(batch.column(0)):
                token, count = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "c"])

    sampled = rows.filter(F.pmod(F.xxhash64(F.lit(5), "h"), F.lit(HEAVY_SAMPLE)) == 0).select("text").mapInArrow(counted, "token long, c long")
    often = sampled.groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= max(2, HEAVY // (2 * HEAVY_SAMPLE)))
    found = often.orderBy(F.desc("c"), "token").limit(HEAVY_NAMED).toArrow()
    token, count = found.column("token").to_numpy().view(np.uint64), found.column("c").to_numpy() * HEAVY_SAMPLE
    order = np.argsort(token)
    return token[order], count[order]


def _is_heavy(heavy: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(values), bool)
    return heavy[np.minimum(np.searchsorted(heavy, values), len(heavy) - 1)] == values


def _heavy_homes(heavy: tuple[np.ndarray, np.ndarray], buckets: int):
    """The heavy entries of each batch, straight to the homes of their classes, in the form of :func:`_shared`."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), []
            for _, _, values, at in _sets(batch.column(1)):
                hit = _is_heavy(heavy[0], values)
                if hit.any():
                    rows += _by_home(ids[at[hit]], values[hit].view(np.int64), heavy[1][np.searchsorted(heavy[0], values[hit])], buckets)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["home", "block"])

    return run


def candidate_sets(docs: DataFrame, classes: DataFrame, others: DataFrame, shingles: int, n_classes: int, n_others: int) -> DataFrame:
    """(node, n, tokens, prefix) of the classes that can link at all; ``others`` (doc_id, h) are the rows that stand for no class."""
    buckets = max(8, -(-shingles // BUCKET_SHINGLES))
    rows = _rows(docs).filter(F.col("doc_id").isNotNull())
    if n_others:
        rows = rows.join(small(others, n_others), ["doc_id", "h"], "left_anti")
    coarse = -(-buckets // FAN) if buckets > FAN else 0
    heavy = heavy_shingles(rows, n_classes)
    blocks = rows.select("doc_id", "text").mapInArrow(_to_buckets(buckets, coarse, heavy[0]), "bucket long, block binary")
    if coarse:
        blocks = blocks.repartition("bucket").mapInArrow(_dealt_again(buckets), "bucket long, block binary")
    shared = blocks.groupBy("bucket").applyInArrow(_shared(buckets), "home long, block binary")
    if len(heavy[0]):
        shared = shared.unionByName(rows.select("doc_id", "text").mapInArrow(_heavy_homes(heavy, buckets), "home long, block binary"))
    sizes = classes.mapInArrow(_homes(buckets), "home long, node long, n long")
    return shared.groupBy("home").cogroup(sizes.groupBy("home")).applyInArrow(_ordered, "node long, n long, tokens array<long>, prefix int")


def _homes(buckets: int):
    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            home = (hashing.mix(node.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(home), batch.column(0), batch.column(1)], names=["home", "node", "n"])

    return run


def index_lists(sets: DataFrame) -> DataFrame:
    """(token, block, node, n, left): ``left`` counts the shingles from this position on."""
    entries = sets.select("node", "n", F.size("tokens").alias("k"), F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("pos", "token"))
    return entries.select("token", _block(F.col("n")).alias("block"), "node", "n", (F.col("k") - F.col("pos")).cast("long").alias("left"))


def _block(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BLOCK_BASE))).cast("int")


def _may_reach(n1: Column, left1: Column, n2: Column, left2: Column) -> Column:
    """Sizes within the window, and enough shingles left after these positions."""
    return (NUM * F.greatest(n1, n2) <= (DEN - NUM) * F.least(n1, n2)) & (DEN * F.least(left1, left2) >= NUM * (n1 + n2))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with na, nb and the exact overlap."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("tokens").alias(f"t{name}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.withColumn("overlap", F.size(F.array_intersect("ta", "tb")).cast("long")).drop("ta", "tb")


def linked(overlap: Column, na: Column, nb: Column) -> Column:
    return DEN * overlap >= NUM * (na + nb)


def _leader_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified (a, b, na, nb, overlap) between a class b and the least class a of one of its lists' blocks."""
    heads = lists.groupBy("token", "block").agg(F.min(F.struct("node", "n", "left")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    met = lists.join(heads, ["token", "block"]).filter(F.col("head.node") != F.col("node"))
    pairs = met.filter(_may_reach(F.col("n"), F.col("left"), F.col("head.n"), F.col("head.left"))).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    return overlaps(pairs, sets).filter(linked(F.col("overlap"), F.col("na"), F.col("nb")))


def ties(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, comp) of each class, and (a, b): links between such names.

    A name stands for classes that leader links tie to it; the components of
    the names are those of all links.
    """
    lists = materialize(index_lists(sets), "join-lists")
    first = materialize(_leader_links(lists, sets), "join-leaders")
    led = first.groupBy("b").agg(F.min_by(F.struct("a", "overlap"), F.struct(-F.col("overlap"), "a")).alias("best"), F.min("a").alias("low"))
    led = materialize(led.select(F.col("b").alias("node"), F.col("best.a").alias("leader"), F.col("best.overlap").alias("overlap"), "low"), "join-led")
    n_led = led.count()
    relation = sets.select("node", "n").join(led, "node", "left")
    relation = relation.select("node", F.coalesce("leader", "node").alias("leader"), F.coalesce(F.col("n") - F.col("overlap"), F.lit(0)).alias("extra"), F.coalesce("low", "node").alias("low"))
    # three steps along verified links name a part of the component: equal names are tied already
    step = small(led.select(F.col("node").alias("low"), F.col("low").alias("next")), n_led)
    for _ in range(3):
        relation = relation.join(step, "low", "left").withColumn("low", F.coalesce("next", "low")).drop("next")
    relation = materialize(relation.withColumnRenamed("low", "comp"), "join-relations")
    names, n_names = relation.select("node", "comp"), relation.count()

    def between(found: DataFrame) -> DataFrame:
        end = lambda x: small(names.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")), n_names)
        named = found.select("a", "b").join(end("a"), "a").join(end("b"), "b")
        return named.filter("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))

    entries = lists.join(relation, "node")
    # groups: one entry for all members of a leader in a list's block
    grouped = entries.groupBy("token", "block", "leader").agg(F.max("extra").alias("extra"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("left"), F.min("comp").alias("comp"), F.max((F.col("node") != F.col("leader")).cast("int")).alias("more"))
    grouped = materialize(grouped, "join-groups")
    crowded = grouped.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("token")
    probe = grouped.join(crowded, "token", "left_semi")
    mine = probe.select("token", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), F.col("block").alias("own"), *(F.col(c).alias(f"{c}1") for c in ("leader", "extra", "low", "high", "left", "comp", "more")))
    other = probe.select("token", "block", *(F.col(c).alias(f"{c}2") for c in ("leader", "extra", "low", "high", "left", "comp", "more")))
    fits = (F.col("comp1") != F.col("comp2")) & ((F.col("own") < F.col("block")) | (F.col("leader1") < F.col("leader2")))
    window = (NUM * F.col("low1") <= (DEN - NUM) * F.col("high2")) & (NUM * F.col("low2") <= (DEN - NUM) * F.col("high1"))
    reach = DEN * F.least("left1", "left2") >= NUM * (F.col("low1") + F.col("low2"))
    met = mine.join(other, ["token", "block"]).filter(fits & window & reach)
    group_pairs = met.groupBy(F.least("leader1", "leader2").alias("a"), F.greatest("leader1", "leader2").alias("b")).agg(
        F.max(F.col("extra1") + F.col("extra2")).alias("slack"), F.min(F.col("low1") + F.col("low2")).alias("small"), F.max(F.col("more1") + F.col("more2")).alias("more")
    )
    compared = materialize(overlaps(group_pairs, sets), "join-groups-met")
    direct = compared.filter(linked(F.col("overlap"), F.col("na"), F.col("nb")))
    # neither settled by the leaders' link nor out of reach of every member; members that lie within their leaders have no slack, but are smaller
    open_pairs = compared.filter(~linked(F.col("overlap"), F.col("na"), F.col("nb")) & (F.col("more") > 0) & (DEN * (F.col("overlap") + F.col("slack")) >= NUM * F.col("small")))
    open_pairs = materialize(open_pairs.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("overlap").alias("base")), "join-open")
    found = first.select("a", "b").unionByName(direct.select("a", "b"))
    if not open_pairs.limit(1).count():
        return names, between(found)
    # back to the lists where the two groups met, with the members that the leaders' overlap and the differences leave a chance
    a, b = F.least("leader1", "leader2"), F.greatest("leader1", "leader2")
    places = met.join(open_pairs, (a == F.col("la")) & (b == F.col("lb"))).select("token", "own", "block", "leader1", "leader2", "extra2", "low2", "base")
    side = lambda x, at, who: entries.select(F.col("token"), F.col("block").alias(at), F.col("leader").alias(who), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"left{x}"), F.col("extra").alias(f"e{x}"))
    chance = lambda bound, sizes: DEN * bound >= NUM * sizes
    one = places.join(side("x", "own", "leader1"), ["token", "own", "leader1"]).filter(chance(F.col("base") + F.col("ex") + F.col("extra2"), F.col("nx") + F.col("low2")))
    two = one.join(side("y", "block", "leader2"), ["token", "block", "leader2"]).filter(chance(F.col("base") + F.col("ex") + F.col("ey"), F.col("nx") + F.col("ny")))
    member = two.filter(_may_reach(F.col("nx"), F.col("leftx"), F.col("ny"), F.col("lefty")))
    pairs = member.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    checked = overlaps(pairs, sets)
    return names, between(found.unionByName(checked.filter(linked(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")))


def all_links(sets: DataFrame) -> DataFrame:
    """(a, b, overlap): every link between two classes, members of one group among themselves too."""
    lists = materialize(index_lists(sets), "join-lists")
    mine = lists.select("token", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), F.col("block").alias("own"), *(F.col(c).alias(f"{c}1") for c in ("node", "n", "left")))
    other = lists.select("token", "block", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "left")))
    met = mine.join(other, ["token", "block"]).filter((F.col("own") < F.col("block")) | (F.col("node1") < F.col("node2")))
    met = met.filter(_may_reach(F.col("n1"), F.col("left1"), F.col("n2"), F.col("left2")))
    pairs = met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    return overlaps(pairs, sets).filter(linked(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b", "overlap")


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(digests of all rows, class of each document, shingles of the classes), the last None where no text has words."""
    rows = materialize(digests(docs), "join-digests", spread=True)
    named = rows.filter("doc_id is not null and n > 0")
    # one row stands for an id, one id for a set
    stands = named.groupBy("doc_id").agg(F.min(F.struct("x", "y", "n", "h")).alias("s")).select("doc_id", "s.*")
    classes = stands.groupBy("x", "y", "n").agg(F.min("doc_id").alias("node"))
    member = materialize(stands.join(classes, ["x", "y", "n"]).select("doc_id", "node", "n", "h"), "join-members")
    nodes = member.filter("doc_id = node").select("node", "n", "h")
    others = named.select("doc_id", "h").distinct().join(nodes.select(F.col("node").alias("doc_id"), "h"), ["doc_id", "h"], "left_anti")
    others = materialize(others, "join-others")
    totals = nodes.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if totals.n is None:
        return rows, member, None
    return rows, member, materialize(candidate_sets(docs, nodes.select("node", "n"), others, int(totals.n), totals.k, others.count()), "join-sets")


def ngram_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    return _components(*_prepared(docs))


def _components(rows: DataFrame, member: DataFrame, sets: DataFrame | None) -> DataFrame:
    if sets is None:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    names, found = ties(sets)
    roots = components(found).withColumnRenamed("node", "comp")
    placed = member.join(names.join(roots, "comp", "left"), "node", "left").select(F.col("doc_id").alias("id"), F.coalesce("root", "comp", "node").alias("component"))
    joined = rows.join(placed, rows["doc_id"] == placed["id"], "left")
    return joined.select(rows["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("component", rows["doc_id"]).alias("component_id"))


def link_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join itself: (doc_id, class_id, n_links) of each document with words, and every link (a, b, overlap) between classes.

    Documents of one class have equal sets and link with each other; ``n_links``
    counts the other classes that theirs links with. A group of k near copies
    has up to k * (k - 1) / 2 links, all of which are given.
    """
    _, member, sets = _prepared(docs)
    if sets is None:
        empty = docs.sparkSession.createDataFrame([], "a long, b long, overlap long")
        return member.select("doc_id", F.col("node").alias("class_id"), F.lit(0).cast("long").alias("n_links")), empty
    found = materialize(all_links(sets), "join-all-links")
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
    counted = member.join(ends.groupBy("node").agg(F.count("*").alias("n_links")), "node", "left")
    return counted.select("doc_id", F.col("node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), found


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose component another id names; all columns as they are.

    Rows with a null id stay. Of rows that share id and text one stays, the
    least by the hash of its columns as JSON. Of rows that share an id with
    different texts only the one that stands for the id (see the module) is
    compared; the others are no copies of anything known and stay.
    """
    key = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__h")]
    rows = docs.select(F.struct("*").alias("__row"), *key)
    prepared = _prepared(docs)
    joined = _components(*prepared).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id"))
    stands = prepared[1].select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    gone = materialize(stands.join(joined.distinct(), "__id"), "join-gone")
    kept = rows.join(small(gone, gone.count()), ["__id", "__h"], "left_anti")
    repeated = prepared[0].filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).count().filter("count > 1").select("__id", "__h")
    repeated = materialize(repeated, "join-repeated")
    if n := repeated.count():
        again = small(repeated, n)
        order = F.xxhash64(F.to_json("__row"))
        one = kept.join(again, ["__id", "__h"], "left_semi").groupBy("__id", "__h").agg(F.min_by("__row", order).alias("__row"))
        kept = kept.join(again, ["__id", "__h"], "left_anti").select("__row").unionByName(one.select("__row"))
    return kept.select("__row.*")
