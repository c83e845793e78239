"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates follow each feature's own gradients, and L1 keeps all
but a few thousand weights at exactly zero, so the model travels in the task
closure. It is fitted in one task on a bounded sample of labelled rows (whole
texts, TRAIN_ROWS rows and TRAIN_VALUES feature numbers at most), in hash
order, outside the held-out fold; a fifth of the sample chooses the strength
of L1 and the offset that puts the best cut at ``CUT``. Every whole text is
scored.

Defined cases: null and empty texts have no features and score the offset
alone; a null id scores like any other (held_out null is given as false);
repeated rows score alike, and an id that repeats teaches once, by its least
text; ids with several labels count as toxic if one of them says so; without
labels of both classes the score is 0; an empty table gives no rows. Extra
columns are ignored. Texts and words of any length are read whole, in pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import textfeatures
from plinth.llm.textfeatures import BITS, TRAIN_ROWS, fold

CUT = 0.7
#: Weight of recall against precision in the choice of the cut: clean documents should pass.
BETA = 0.7
#: The strengths of L1 that are tried.
L1 = (8.0, 16.0)


@dataclass
class Model:
    numbers: np.ndarray
    weights: np.ndarray
    offset: float
    steep: float = 1.0


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 4.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.1, passes: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias after ``passes`` over the rows in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(passes):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb, nb + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -zb / ((beta + np.sqrt(nb)) / alpha)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    made = textfeatures.fitted(textfeatures.training_sample(docs, labels, F.col("toxic"), rows), _chosen, "numbers binary, weights binary, offset double")
    return Model(np.frombuffer(made["numbers"], np.int32), np.frombuffer(made["weights"], np.float64), made["offset"])


def _chosen(sample: textfeatures.Sample) -> dict:
    """The non-zero weights of the strength of L1 that does best on a fifth of the sample, and the offset for its cut."""
    features, y = sample.rows, (sample.labels > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return {"numbers": b"", "weights": b"", "offset": -40.0}
    part = np.arange(len(y)) % 5 == 4
    truth = y[part]
    tried = []
    for l1 in L1:
        w, _ = ftrl([x for x, held in zip(features, part, strict=True) if not held], y[~part], l1=l1, passes=8)
        check = np.array([w[x].sum() for x, held in zip(features, part, strict=True) if held])
        cut, f1 = _best_cut(check, truth)
        tried.append((f1, l1, cut))
    _, l1, cut = max(tried)
    full, _ = ftrl(features, y, l1=l1)
    kept = np.flatnonzero(full).astype(np.int32)
    return {"numbers": kept.tobytes(), "weights": full[kept].tobytes(), "offset": float(np.log(CUT / (1 - CUT)) - cut)}


def _best_cut(z: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The middle of the gap between sums at the best F-measure, and that measure."""
    if not truth.sum():
        return (float(z.max() + 1) if len(z) else 1.0), 0.0
    order = np.argsort(-z, kind="stable")
    s, t = z[order], truth[order]
    hit = np.cumsum(t)
    f1 = (1 + BETA**2) * hit / (np.arange(1, len(t) + 1) + BETA**2 * t.sum())
    ends = np.r_[s[1:] < s[:-1], True]
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = s[best + 1] if best + 1 < len(s) else s[best] - 2
    return float((s[best] + below) / 2), float(f1[best])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    z = textfeatures.scored(docs, (model.numbers, model.weights))
    p = 1 / (1 + F.exp(-(F.col("z") + F.lit(model.offset))))
    return z.select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def judged(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    out = score(docs, fit(docs, labels, rows))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; one pass, no join."""
    model = fit(docs, labels, rows)
    return textfeatures.filtered(docs, (model.numbers, model.weights), model.offset, float(np.log(CUT / (1 - CUT))))
