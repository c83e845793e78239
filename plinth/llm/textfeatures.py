"""Hashed features of whole texts, shared by the linear models, and their bounded training samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import hashing
from plinth.session import materialize

BITS = 20
#: Shape features are numbered from here on, apart from the hashed ones.
SHAPE_BASE = 1 << BITS
SIZE = SHAPE_BASE + 1024
#: Labelled rows used at most to fit a model, by the smallest hash of their id.
TRAIN_ROWS = 12_000
#: Feature numbers that the training rows hold at most together: in hash order, the sample ends before the row that would pass it. Rows are whole or out.
TRAIN_VALUES = 20_000_000
#: Features of fewer training rows than this are left out of a fit.
MIN_ROWS = 4


def _slot(h: np.ndarray) -> np.ndarray:
    return (hashing.mix(h) >> np.uint64(64 - BITS)).astype(np.int32)


def gram_features(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, feature, row): distinct hashed words, word pairs, and pairs that skip one word.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z.
    """
    for a, b, h, rows in hashing.words(text, hashing.NOT_WORD):
        parts, at = [_slot(h)], [rows]
        for skip, salt in ((1, 0x1234567), (2, 0x89ABCDE)):
            if len(h) > skip:
                same = rows[:-skip] == rows[skip:]
                parts.append(_slot((h[:-skip] * np.uint64(3) + h[skip:] * np.uint64(5) + np.uint64(salt))[same]))
                at.append(rows[:-skip][same])
        values, rows = hashing.distinct(np.concatenate(parts), np.concatenate(at))
        yield a, b, values, rows


#: Bytes whose shares in a text are features, next to its letters in capitals.
_MARKS = np.frombuffer(b"!#$%&*|<>{}[]=_+~@\\/;:?\"'()-.,0123456789", dtype=np.uint8)


def shape_features(text: pa.Array) -> np.ndarray:
    """(rows, k) feature numbers: the quantised share of each mark, of capitals, and of words that repeat the one before."""
    data, offsets = hashing.buffers(text)
    n = len(offsets) - 1
    out = np.zeros((n, len(_MARKS) + 2), dtype=np.int32)
    level = lambda x: np.clip(np.ceil(np.log2(np.maximum(x, 1e-9) * 256)), 0, 12).astype(np.int32)
    share = np.zeros((n, len(_MARKS) + 2))
    for i in range(n):
        row = data[offsets[i] : offsets[i + 1]]
        count = np.bincount(row, minlength=256) if len(row) <= hashing.PIECE else sum(np.bincount(row[p : p + hashing.PIECE], minlength=256) for p in range(0, len(row), hashing.PIECE))
        share[i, : len(_MARKS)] = count[_MARKS] / max(1, len(row))
        share[i, -2] = count[65:91].sum() / max(1, len(row))
    for a, b, h, rows in hashing.words(text):
        if len(h) > 1:
            again = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
            share[a:b, -1] = np.bincount(rows[1:][again] - a, minlength=b - a) / np.maximum(1, np.bincount(rows - a, minlength=b - a))
    for k in range(share.shape[1]):
        out[:, k] = SHAPE_BASE + 16 * k + level(share[:, k])
    return out


def row_features(text: pa.Array, shapes: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    extra = shape_features(text) if shapes else None
    seen = 0
    for a, b, values, rows in gram_features(text):
        if extra is not None:
            values = np.r_[values, extra[a:b].ravel()]
            rows = np.r_[rows, np.repeat(np.arange(a, b), extra.shape[1])]
            order = np.argsort(rows, kind="stable")
            values, rows = values[order], rows[order]
            for empty in range(seen, a):
                yield empty, empty + 1, extra[empty], np.full(extra.shape[1], empty)
            seen = b
        yield a, b, values, rows
    if extra is not None:
        for empty in range(seen, len(text)):
            yield empty, empty + 1, extra[empty], np.full(extra.shape[1], empty)


def _sampler(shapes: bool):
    def run(batches):
        for batch in batches:
            found: list[bytes] = [b""] * batch.num_rows
            for _, _, values, rows in row_features(batch.column(2), shapes):
                cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
                for s, e in zip(cut, np.r_[cut[1:], len(rows)].astype(int) if len(rows) else [], strict=True):
                    found[rows[s]] = np.unique(values[s:e]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array(found, pa.binary())], names=["h", "label", "n", "features"])

    return run


def fold(doc_id):
    """crc32 of the id as text, modulo 3: remainder 1 is held out from every fit."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def training_sample(docs: DataFrame, labels: DataFrame, label, rows: int = TRAIN_ROWS, shapes: bool = False, values: int = TRAIN_VALUES) -> DataFrame:
    """(h, label, n, features) of labelled documents outside the held-out fold: a table in the shared folder.

    At most ``rows`` ids with the smallest hashes, as far as their feature
    numbers stay within ``values`` together. One row for an id: of rows that
    share it, the least text teaches; of several labels the largest holds.
    Labelled ids without a document are counted in ``rows`` and teach nothing.
    """
    graded = labels.select("doc_id", label.alias("label")).filter("doc_id is not null and label is not null").filter(fold(F.col("doc_id")) != 1)
    ids = graded.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))
    sample = materialize(texts.select("h", "label", "text").mapInArrow(_sampler(shapes), "h long, label int, n long, features binary"), "training-sample")
    held = 0
    for r in sample.select("h", "n").orderBy("h").collect():  # at most ``rows`` pairs of numbers
        held += r.n
        if held > values:
            return sample.filter(F.col("h") < r.h)
    return sample


@dataclass
class Sample:
    """Training rows in hash order: the frequent features of each, its label, and how many hashed features it has in all."""

    rows: list[np.ndarray]
    labels: np.ndarray
    hashed: np.ndarray


def unpacked(batches) -> Sample:
    """The batches of a training sample; features of fewer than MIN_ROWS rows are left out, but count in ``hashed``."""
    keys, labels, flat, lengths = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        labels.append(batch.column(1).to_numpy(zero_copy_only=False))
        flat += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(3)]
        lengths.append(batch.column(2).to_numpy(zero_copy_only=False))
    numbers, offsets = np.concatenate(flat), np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int64)
    del flat
    order = np.argsort(np.concatenate(keys), kind="stable") if keys else np.zeros(0, np.int64)
    frequent = np.bincount(numbers, minlength=SIZE) >= MIN_ROWS
    pick = lambda x: x[frequent[x]]
    rows = [pick(numbers[offsets[i] : offsets[i + 1]]) for i in order]
    hashed = np.array([int((numbers[offsets[i] : offsets[i + 1]] < SHAPE_BASE).sum()) for i in order], np.int64)
    return Sample(rows, np.concatenate(labels)[order] if keys else np.zeros(0, np.int32), hashed)


def fitted(sample: DataFrame, fit, schema: str) -> dict:
    """The one record that ``fit(Sample)`` makes, in a task of an executor: the sample is bounded, and the driver never holds it."""

    def run(batches):
        kinds = {"binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
        fields = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])
        yield pa.RecordBatch.from_pylist([fit(unpacked(batches))], schema=fields)

    found = sample.coalesce(1).mapInArrow(run, schema).collect()
    return found[0].asDict() if found else fit(unpacked([]))


def values_of(x: np.ndarray, hashed: int) -> np.ndarray:
    """1 for a shape feature, one over the root of ``hashed`` for each hashed one; ``hashed`` counts all that the text has, frequent or not."""
    return np.where(x < SHAPE_BASE, 1 / np.sqrt(max(1, hashed)), 1.0)


def scored(docs: DataFrame, score, shapes: bool = False, scaled: bool = False) -> DataFrame:
    """doc_id and ``z``, the sum of weights of each whole text's features; ``score`` is (numbers, weights) of the non-zero ones.

    ``scaled``: each feature counts by :func:`values_of`.
    """
    numbers, weights = score

    def run(batches):
        table = np.zeros(SIZE)
        table[numbers] = weights
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for a, b, values, rows in row_features(batch.column(1), shapes):
                w = table[values]
                if scaled:
                    hashed = values < SHAPE_BASE
                    n = np.bincount(rows[hashed] - a, minlength=b - a)
                    w = np.where(hashed, w / np.sqrt(np.maximum(1, n))[rows - a], w)
                z[a:b] += np.bincount(rows - a, weights=w, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z)], names=["doc_id", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, z double")


def filtered(docs: DataFrame, score, offset: float, below: float) -> DataFrame:
    """Whole rows of ``docs`` whose ``z + offset`` is under ``below``."""
    numbers, weights = score
    at = docs.columns.index("text")

    def run(batches):
        table = np.zeros(SIZE)
        table[numbers] = weights
        for batch in batches:
            z = np.full(batch.num_rows, offset)
            for a, b, values, rows in gram_features(batch.column(at)):
                z[a:b] += np.bincount(rows - a, weights=table[values], minlength=b - a)
            yield batch.filter(pa.array(z < below))

    return docs.mapInArrow(run, docs.schema)
