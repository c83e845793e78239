"""Ranked lexical search over inverted treaps.

Documents are indexed in shards of bounded postings, each with the postings of
every query term (term, place of the document in doc_id order, occurrences).
Once the counts over all shards are known, each term's postings in a shard
become a treap: a search tree by document, a heap by impact, so a node holds
the greatest impact of its subtree. An item walks the treaps of all its terms
at once. The state is a range of documents with one node for each term, the
top of what the term has in the range; the summed impacts of the nodes bound
every document in it. A range whose bound is under the k-th score found is
pruned with all its subtrees. Otherwise it is split at the document of its
strongest node, which is scored from the split paths, and both halves go on,
those of the greatest bounds first. Ranges are handled many at a time in
arrays. Every shard gives its k best, and the k best of these are found in two
steps, so no task meets the answers of all shards.

The items are a stated set and are taken in blocks of bounded bytes; a block's
terms and the counts of these travel to all tasks.

Defined cases: null texts and texts without terms count for nothing; null ids
stand after all others among equal scores; rows that repeat an id are
documents of their own, each with its own place; items that repeat id and text
count once, items that share only the id are ranked each; items without terms
and empty tables give no rows; texts of any length are counted whole, in
pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.session import materialize

TOP = 20
#: Bytes of item texts in a block, on average.
ITEM_BYTES = 4 << 20
#: Postings after which a shard is closed.
SHARD_POSTINGS = 500_000
#: Parts in which the best of all shards are found first.
PARTS = 256
#: Numbers (ranges times terms) that are handled at once.
CELLS = 1 << 18
#: Terms that are counted at once in a long text.
HELD = 1 << 18

# a maximal run of ASCII letters, digits and what is not ASCII, as UTF-8
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def term_counts(text: bytes) -> tuple[int, Counter]:
    """(terms with repeats, occurrences of each) of a text as UTF-8; only A-Z are lower-cased."""
    text = text.lower()
    if len(text) <= 1 << 20:
        found = _TERM.findall(text)
        return len(found), Counter(found)
    counts: Counter = Counter()
    matches = (m.group() for m in _TERM.finditer(text))
    while some := list(islice(matches, HELD)):
        counts.update(some)
    return counts.total(), counts


def impact(tf, m):
    """The weightless part of a term's score, for counts and lengths in whole numbers."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Item:
    """``terms``: numbers of the distinct terms; ``repeats``: how often each occurs."""

    item_id: int | None
    terms: np.ndarray
    repeats: np.ndarray


class Queries:
    """A block of items with their vocabulary."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[Item] = []
        for item_id, text in rows:
            _, counts = term_counts(text.encode())
            terms = [self.numbers.setdefault(t, len(self.numbers)) for t in counts]
            if terms:
                self.items.append(Item(item_id, np.array(terms, np.int64), np.array(list(counts.values()), np.int64)))


SHARD = "shard long, n_docs long, n_terms long, docs array<long>, lengths binary, terms binary, counts binary, places binary, tfs binary"


def shards(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """The postings of the terms in ``numbers``, shard by shard: a table in the shared folder."""

    def closed(key, seen, ids, lengths, sizes, terms, tfs):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        places, terms = np.repeat(place, np.frombuffer(sizes, np.int32)), np.frombuffer(terms, np.int32)
        by = np.lexsort((places, terms))
        distinct, counts = np.unique(terms, return_counts=True)
        blob = lambda x, kind: pa.array([np.asarray(x, kind).tobytes()], pa.binary())
        columns = {"shard": pa.array([key], pa.int64()), "n_docs": pa.array([seen[0]], pa.int64()), "n_terms": pa.array([seen[1]], pa.int64())}
        columns |= {"docs": pa.array([[ids[k] for k in order]], pa.list_(pa.int64())), "lengths": blob(np.frombuffer(lengths, np.int64)[order], np.int64), "terms": blob(distinct, np.int32), "counts": blob(counts, np.int32)}
        return pa.RecordBatch.from_pydict(columns | {"places": blob(places[by], np.int32), "tfs": blob(np.frombuffer(tfs, np.int32)[by], np.int32)})

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 24
        fresh = lambda: ([0, 0], [], array("q"), array("i"), array("i"), array("i"))
        held = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                seen, ids, lengths, sizes, terms, tfs = held
                n, counts = term_counts(text.as_py() or b"")
                seen[0] += n > 0
                seen[1] += n
                wanted = numbers.keys() & counts.keys()
                if wanted:
                    ids.append(doc_id)
                    lengths.append(n)
                    sizes.append(len(wanted))
                    terms.extend(numbers[t] for t in wanted)
                    tfs.extend(counts[t] for t in wanted)
                if len(terms) >= SHARD_POSTINGS:
                    yield closed(key, *held)
                    key, held = key + 1, fresh()
        if held[0][0]:
            yield closed(key, *held)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARD), "search-shards", spread=True)


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches):
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pydict({"term": pa.array(np.frombuffer(terms.as_py(), np.int32)), "df": pa.array(np.frombuffer(counts.as_py(), np.int32).astype(np.int64))})

    return index.select("terms", "counts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def treap(keys: list[int], left: list[int], right: list[int], base: int) -> int:
    """The root of the treap over ``keys`` in their order, greatest on top; children of k are noted at ``base + k``."""
    spine: list[int] = []
    for k, key in enumerate(keys, base):
        below = -1
        while spine and keys[spine[-1] - base] < key:
            below = spine.pop()
        left[k] = below
        if spine:
            right[spine[-1]] = k
        spine.append(k)
    return spine[0]


class Shard:
    """The treaps of one shard: nodes of all terms in one numbering."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, tfs: np.ndarray, n: int, total: int, size: int):
        m = 75 + (25 * lengths * n) // total
        self.place = places.astype(np.int64)
        self.impact = impact(tfs.astype(np.int64), m[places])
        # equal impacts are ordered at random by their place, else a frequent word's treap would be a list
        chance = (self.place * 2_654_435_761 >> 7) & 0xFFFFF
        keys = ((self.impact << 20) | chance).tolist()
        left, right = [-1] * len(keys), [-1] * len(keys)
        self.root = np.full(size, -1, np.int64)
        at = 0
        for term, count in zip(terms.tolist(), counts.tolist(), strict=True):
            self.root[term] = treap(keys[at : at + count], left, right, at)
            at += count
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def split(self, nodes: np.ndarray, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tops between low and at, tops between at and high, node at) for the documents of each row, in the subtrees under ``nodes``; -1 where there is none."""
        width = nodes.shape[1]
        y = nodes.ravel().copy()
        low, d, high = (np.repeat(x, width) for x in (low, at, high))
        before, after, here = (np.full(len(y), -1, np.int64) for _ in range(3))
        active = np.flatnonzero(y >= 0)
        while len(active):
            node = y[active]
            place = self.place[node]
            under, over = place < d[active], place > d[active]
            new = under & (place > low[active]) & (before[active] < 0)
            before[active[new]] = node[new]
            new = over & (place < high[active]) & (after[active] < 0)
            after[active[new]] = node[new]
            found = ~(under | over)
            here[active[found]] = node[found]
            y[active] = np.where(under, self.right[node], self.left[node])
            active = active[~found & (y[active] >= 0)]
        met = np.flatnonzero(here >= 0)
        for top, edge, inner, outer in ((before, low, self.left, self.right), (after, high, self.right, self.left)):
            # under the document's own node the range goes on to the edge, beyond which other nodes may stand on top
            a = met[top[met] < 0]
            x = inner[here[a]]
            while len(a):
                there = x >= 0
                a, x = a[there], x[there]
                inside = self.place[x] > edge[a] if top is before else self.place[x] < edge[a]
                top[a[inside]] = x[inside]
                a, x = a[~inside], outer[x[~inside]]
        return before.reshape(nodes.shape), after.reshape(nodes.shape), here.reshape(nodes.shape)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, documents scored): the ``k`` best for these terms, equal scores by place."""
        here = (self.root[terms] >= 0) & (weights > 0)
        roots, weights = self.root[terms][here], weights[here]
        places, scores, tried = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not len(roots):
            return places, scores, tried
        worth = lambda nodes: np.where(nodes >= 0, self.impact[nodes] * weights, 0)
        wide = max(1, CELLS // len(roots))
        first = roots[None, :]
        heap, made = [(-int(worth(first).sum()), 0, first, np.array([-1]), np.array([len(self.place)]))], 1
        while heap:
            bound, _, nodes, low, high = heapq.heappop(heap)
            least = scores[k - 1] if len(scores) == k else 1
            if -bound < least:
                break
            value = worth(nodes)
            live = value.sum(1) >= least
            nodes, value, low, high = nodes[live], value[live], low[live], high[live]
            at = self.place[nodes[np.arange(len(nodes)), value.argmax(1)]]
            before, after, exact = self.split(nodes, low, at, high)
            tried += len(at)
            places, scores = np.r_[places, at], np.r_[scores, worth(exact).sum(1)]
            by = np.lexsort((places, -scores))[:k]
            places, scores = places[by], scores[by]
            halves, low, high = np.vstack([before, after]), np.r_[low, at], np.r_[at, high]
            bounds = worth(halves).sum(1)
            least = scores[k - 1] if len(scores) == k else 1
            order = np.flatnonzero(bounds >= least)
            order = order[np.argsort(-bounds[order], kind="stable")]
            for s in range(0, len(order), wide):
                some = order[s : s + wide]
                heapq.heappush(heap, (-int(bounds[some[0]]), made, halves[some], low[some], high[some]))
                made += 1
        return places[scores > 0], scores[scores > 0], tried


def _found(docs: DataFrame, queries: Queries, k: int) -> DataFrame | None:
    """(item, item_id, shard, doc_id, score): the ``k`` best documents of each shard for each item of a block."""
    index = shards(docs, queries.numbers)
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    if not sums.n:
        return None
    n, total, size = int(sums.n), int(sums.total), len(queries.numbers)
    weights = np.zeros(size, np.int64)
    for r in document_counts(index).collect():  # as many as the block has terms
        weights[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
    items = queries.items

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts, places, tfs = (np.frombuffer(row[c], np.int32) for c in ("terms", "counts", "places", "tfs"))
                shard = Shard(np.frombuffer(row["lengths"], np.int64), terms, counts, places, tfs, n, total, size)
                found = [shard.best(item.terms, item.repeats * weights[item.terms], k)[:2] for item in items]
                lengths = [len(p) for p, _ in found]
                at = np.concatenate([p for p, _ in found])
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array(np.repeat(np.arange(len(items), dtype=np.int32), lengths)),
                    "item_id": pa.array([items[i].item_id for i, c in enumerate(lengths) for _ in range(c)], pa.int64()),
                    "shard": pa.array(np.full(len(at), row["shard"], np.int64)),
                    "doc_id": pa.array([row["docs"][p] for p in at.tolist()], pa.int64()),
                    "score": pa.array(np.concatenate([s for _, s in found])),
                })

    return index.filter(F.size("docs") > 0).drop("n_docs", "n_terms").mapInArrow(run, "item int, item_id long, shard long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) for each item (item_id, text), scores above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16).alias("bytes")).first().bytes or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # ITEM_BYTES on average
        queries = Queries([(r.item_id, r.text) for r in rows])
        found = _found(docs, queries, k) if queries.items else None
        if found is None:
            continue
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = Window.partitionBy("item", F.pmod(F.xxhash64("shard"), F.lit(PARTS))).orderBy(*order)
        some = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
