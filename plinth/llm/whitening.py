"""Embedding whitening: blockwise TSQR of the centred vectors, then one-sided Jacobi rotations of R.

Entries are cut to 256ths as whole numbers, so counts and sums are exact. The
distinct vectors are the fit list: each task centres its rows and folds them
block by block into one upper triangle, triangles are folded in groups of
``FAN`` until one is left, and plane rotations make the columns of that R
orthogonal. The rotations gathered are the components, and the lengths of the
columns over the root of n are the standard deviations; no product of the
vectors with themselves is formed, which would square the condition number.
A task holds one block and a triangle, both bounded by the dimension.

Defined cases: rows whose vector is null or holds null or non-finite entries
are dropped; so are empty vectors and those of another length than most rows
have (of lengths as frequent the greatest counts). Repeated rows are each
returned and count once in the fit. A component without variance (less than
the rounding of the largest, as with constant or dependent dimensions or a
single vector) has ``whitened`` null, ``explained`` 0 (null where the trace is
0), and no part in ``identity_error``, which is 0 if no component has any.
``deviation`` is null where it passes 64 bits. Equal eigenvalues leave their
components free within their plane; one choice serves all rows. A null id
stays. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import materialize

SCALE = 256
#: Components that the query returns.
COMPONENTS = 4
#: Rows that are folded into a triangle at once.
BLOCK = 2048
#: Triangles that one task folds into one.
FAN = 32
#: Sweeps of rotations at most; some eight are needed.
SWEEPS = 60


@dataclass
class Whitening:
    """``components``: a unit vector in each row, by falling eigenvalue; zeros in ``eigenvalues`` mark those without variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, components) whitened; NaN for components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, (x - mean) @ self.components.T / np.sqrt(self.eigenvalues), np.nan)


def quantised(table: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers of 256ths."""
    c = F.col("embedding")
    usable = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size(c) > 0)
    usable = usable.filter(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    return usable.select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _folded(top: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of ``rows`` under the triangle ``top``."""
    return np.linalg.qr(rows if top is None else np.vstack([top, rows]), mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components in rows, lengths of the rotated columns), by falling length; ``r`` times the components is orthogonal.

    Each step of a sweep rotates disjoint pairs of columns, all at once, in
    the order of a round-robin tournament.
    """
    d = r.shape[1]
    odd = d % 2
    u = np.zeros((r.shape[0], d + odd))
    u[:, :d] = r
    v = np.eye(d + odd)
    order = np.arange(d + odd)
    half = len(order) // 2
    for _ in range(SWEEPS):
        largest = 0.0
        for _ in range(max(1, len(order) - 1)):
            p, q = order[:half], order[half:][::-1]
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            turn = np.abs(ab) > 1e-16 * size
            largest = max(largest, float(np.max(np.abs(ab)[turn] / size[turn], initial=0.0)))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (bb - aa) / (2 * ab)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            u[:, p], u[:, q] = c * a - s * b, s * a + c * b
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
            order = np.r_[order[:1], order[-1:], order[1:-1]]
        if largest < 1e-15:
            break
    length = np.sqrt((u * u).sum(0))[:d]
    by = np.argsort(-length, kind="stable")
    found = v[:d, :d][:, by].T
    flip = np.sign(found[np.arange(d), np.abs(found).argmax(1)])
    return found * np.where(flip == 0, 1, flip)[:, None], length[by]


def _triangles(vectors: DataFrame, d: int, mean: np.ndarray) -> DataFrame:
    """(k, r): one triangle of each task's centred rows."""

    def first(batches):
        from pyspark import TaskContext

        top = None
        for batch in batches:
            x = _matrix(batch.column(0), d) - mean
            for at in range(0, len(x), BLOCK):
                top = _folded(top, x[at : at + BLOCK])
        if top is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([top.tobytes()], pa.binary())})

    def onward(frame):
        top = None
        for r in frame.sort_values("k")["r"]:
            top = _folded(top, np.frombuffer(r).reshape(-1, d))
        return frame.iloc[:1].assign(k=frame["k"].min() // FAN, r=top.tobytes())

    made = materialize(vectors.select("x").mapInArrow(first, "k long, r binary"), "triangles", spread=True)
    while made.count() > 1:
        made = materialize(made.groupBy(F.floor(F.col("k") / FAN)).applyInPandas(onward, "k long, r binary"), "triangles")
    return made


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors`` (column x, all of one length); None without any.

    One record a task, then one of the dimension's size, reach the driver.
    """
    listed = materialize(vectors.select("x").distinct(), "fit-list")
    one = listed.first()
    if one is None:
        return None
    d = len(one.x)

    def totals(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(d + 1, dtype=np.int32)), "high": pa.array(np.r_[0, high]), "low": pa.array(np.r_[n, low])})

    summed = listed.mapInArrow(totals, "part int, high long, low long").groupBy("part").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("part").collect()
    n, *sums = [(int(r.high) << 32) + int(r.low) for r in summed]
    mean = np.array([s / n for s in sums])

    def rotated(batches):
        for batch in batches:
            for r in batch.column(1):
                found, length = jacobi(np.frombuffer(r.as_buffer()).reshape(-1, d))
                e = length**2 / n
                e[length <= length[:1] * np.finfo(float).eps * max(d, 64)] = 0.0
                yield pa.RecordBatch.from_pydict({"v": pa.array([found[:components].tobytes()], pa.binary()), "e": pa.array([e.tobytes()], pa.binary())})

    made = _triangles(listed, d, mean).mapInArrow(rotated, "v binary, e binary").first()
    e = np.frombuffer(made.e)
    model = Whitening(n, sums, np.frombuffer(made.v).reshape(-1, d), e[:components], float(e.sum()))
    model.identity_error = _identity_error(listed, d, model)
    return model


def _identity_error(listed: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity: one pass for the means, one for centred products."""
    good = np.flatnonzero(model.eigenvalues > 0)
    k = len(good)
    if not k:
        return 0.0

    def over(product):
        def run(batches):
            total = np.zeros(k * k)
            for batch in batches:
                x = _matrix(batch.column(0), d)
                for at in range(0, len(x), BLOCK):
                    part = product(model.project(x[at : at + BLOCK])[:, good])
                    total[: len(part)] += part
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(k * k, dtype=np.int32)), "s": pa.array(total)})

        found = listed.mapInArrow(run, "part int, s double").groupBy("part").agg(F.sum("s").alias("s")).orderBy("part").collect()
        return np.array([r.s for r in found]) / model.n

    centre = over(lambda w: w.sum(0))[:k]
    covariance = over(lambda w: ((w - centre).T @ (w - centre)).ravel()).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, x) and component."""
    d, k = len(model.sums), len(model.eigenvalues)
    # the sum of squares as one of 64-bit numbers, where a bound in doubles shows that it fits
    whole = all(-(2**62) < s < 2**62 for s in model.sums)
    sums = np.array(model.sums if whole else [0] * d, np.int64)
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.eigenvalues]

    def deviations(x: np.ndarray) -> list[int | None]:
        rough = ((model.n * x.astype(float) - np.array(model.sums, float)) ** 2).sum(1)
        if whole and float(np.abs(x).max(initial=0)) * model.n < 2**61 and rough.max(initial=0) < 2**62:
            return ((model.n * x - sums) ** 2).sum(1).tolist()
        exact = (sum((model.n * int(v) - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x)
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            w = model.project(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(x) * k, model.n, np.int64)),
                "deviation": pa.array(np.repeat(np.array(deviations(x), object), k).tolist(), pa.int64()),
                "whitened": pa.array(w.ravel(), from_pandas=True),
                "explained": pa.array(explained * len(x), pa.float64()),
                "identity_error": pa.array(np.full(len(x) * k, model.identity_error)),
            })

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row of ``table`` (vec_id, embedding), whitened on its first ``components`` components."""
    vectors = quantised(table)
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    vectors = vectors.filter(F.size("x") == (lengths.d if lengths else 0))
    model = fit(vectors, components) if lengths else None
    return whitened(vectors, model or Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0))
