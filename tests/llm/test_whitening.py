"""Embedding whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from plinth.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "c") for i, v in rows], SCHEMA)


def brute(rows, k=4):
    x = {n: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for n, (_, v) in enumerate(rows)}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, {i: int(((n * y - s) ** 2).sum()) for i, y in x.items()}, {i: (y - s / n) @ v / np.sqrt(e) for i, y in x.items()}, e / np.trace(np.cov(fit.T, bias=True))


def test_rotations_diagonalise():
    rng = np.random.default_rng(1)
    for shape in ((5, 5), (9, 4), (7, 1), (12, 6), (3, 3)):
        r = np.triu(rng.normal(size=shape)) * 10.0 ** rng.integers(-5, 5, shape[1])
        found, length = whitening.jacobi(r)
        assert np.allclose(found @ found.T, np.eye(shape[1]), atol=1e-12)
        assert np.allclose(length, np.linalg.svd(r, compute_uv=False)[: len(length)], rtol=1e-10, atol=1e-18)
        product = (r @ found.T) / np.where(length > 0, length, 1)
        assert np.abs(product.T @ product - np.eye(shape[1]))[: min(shape), : min(shape)].max() < 1e-10
    small = np.diag([1.0, 1e-9, 1e-14])  # what a product with itself would lose
    assert np.allclose(whitening.jacobi(small @ np.linalg.qr(rng.normal(size=(3, 3)))[0])[1], [1.0, 1e-9, 1e-14], rtol=1e-2)


def test_whitened_equals_dense(spark):
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(6, 6))
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) @ spread + 3]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (2005, [1.0, 2.0])]
    out = whitening.whiten(vectors(spark, rows + bad).repartition(40)).toPandas()
    assert list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, white, explained = brute(rows)
    assert len(out) == 4 * len(rows) and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-10
    key = lambda i: -1 if i is None or i != i else i
    want = sorted((key(rows[k][0]), c, deviation[k], abs(white[k][c - 1])) for k in range(len(rows)) for c in range(1, 5))
    got = sorted((key(r.vec_id), r.component, r.deviation, abs(r.whitened)) for r in out.itertuples())
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-8) for a, b in zip(got, want, strict=True))
    for c in range(1, 5):
        assert out[out.component == c].explained.iloc[0] == pytest.approx(explained[c - 1], rel=1e-9)
        sign = {np.sign(r.whitened * white[k][c - 1]) for k, r in zip(range(300), out[(out.component == c) & (out.vec_id < 300)].drop_duplicates("vec_id").sort_values("vec_id").itertuples(), strict=True)}
        assert len(sign) == 1  # one sign for all rows


def test_triangles_of_many_tasks_fold_to_one(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (500, 3))
    table = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(70)
    made = whitening._triangles(table, 3, x.mean(0)).collect()
    assert len(made) == 1
    r = np.frombuffer(made[0].r).reshape(-1, 3)
    assert np.allclose(r.T @ r, (x - x.mean(0)).T @ (x - x.mean(0)))


def test_degenerate_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 and r.identity_error == 0 for r in one)
    flat = whitening.whiten(vectors(spark, [(i, [float(i % 5), 4.0, 2.0 * (i % 5)]) for i in range(20)])).collect()  # one direction only
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in flat} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    assert max(r.identity_error for r in flat) < 1e-12 and {r.n for r in flat} == {5}
    huge = whitening.whiten(vectors(spark, [(1, [3e15]), (2, [-3e15]), (3, [0.0])])).collect()
    assert {r.deviation for r in huge} == {None, 0}
    whole = whitening.whiten(vectors(spark, [(1, [2.0**30]), (2, [-(2.0**30)])])).collect()
    assert {r.deviation for r in whole} == {None} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in whole)
    near = whitening.whiten(vectors(spark, [(1, [2.0**21]), (2, [-(2.0**21)])])).collect()
    assert {r.deviation for r in near} == {(2 * 2**29) ** 2}
