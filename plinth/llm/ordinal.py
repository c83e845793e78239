"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its line into grades, P(grade <= k) = sigmoid(t_k - w.x). The
expected grade and the probability of the top grades select documents. The
fit is by per-coordinate adaptive gradients, in one task, over a bounded
sample (whole texts, TRAIN_ROWS rows and TRAIN_VALUES feature numbers at most)
outside the held-out fold; every whole text is scored. A hashed feature weighs
one over the root of all hashed features of its text, in fit and score alike.

Defined cases: null and empty texts are scored on their shape alone; repeated
rows score alike, and an id that repeats teaches once, by its least text; a
null id scores like any other; an empty table gives no rows; without ratings of two
grades at least, every document has the one grade known (or 0) and is kept.
Equal expected grades stay equal, whatever stands beside them; texts of any
length are read whole, in pieces; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import textfeatures
from plinth.llm.textfeatures import SIZE, TRAIN_ROWS, fold, values_of


@dataclass
class Model:
    numbers: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    only: int | None = None


def rating(quality: Column, toxic: Column) -> Column:
    """0 low quality, 1 good but toxic, 2 good and clean."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality == 1, 2)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def cumulative_link(rows: list[np.ndarray], hashed: np.ndarray, grades: np.ndarray, levels: int, rate: float = 0.2, l2: float = 1e-4, passes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ``levels - 1`` ordered thresholds; the first threshold and the logs of the gaps are what is fitted."""
    w, gw = np.zeros(SIZE), np.full(SIZE, 1e-2)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    gt = np.full(levels - 1, 1e-1)
    for _ in range(passes):
        for x, k, y in zip(rows, hashed, grades, strict=True):
            t = np.r_[first, first + np.cumsum(np.exp(gaps))]
            v = values_of(x, k)
            s = (w[x] * v).sum()
            upper, lower = (_sigmoid(t[y] - s) if y < levels - 1 else 1.0), (_sigmoid(t[y - 1] - s) if y else 0.0)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            p = max(upper - lower, 1e-9)
            g = (du - dl) / p * v  # gradient of -log p by each weight
            gw[x] += g * g
            w[x] -= rate * (g / np.sqrt(gw[x]) + l2 * w[x])
            gt_now = np.zeros(levels - 1)
            if y < levels - 1:
                gt_now[y] -= du / p
            if y:
                gt_now[y - 1] += dl / p
            tail = np.cumsum(gt_now[::-1])[::-1]
            grads = np.r_[tail[0], tail[1:] * np.exp(gaps)]
            gt += grads**2
            step = 0.1 * grads / np.sqrt(gt)
            first, gaps = first - step[0], np.clip(gaps - step[1:], -6, 3)
    return w, np.r_[first, first + np.cumsum(np.exp(gaps))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, grade: Column | None = None) -> Model:
    sample = textfeatures.training_sample(docs, labels, grade if grade is not None else rating(F.col("quality"), F.col("toxic")), rows, shapes=True)
    made = textfeatures.fitted(sample, _fitted, "numbers binary, weights binary, thresholds binary, only int")
    numbers, weights, thresholds = np.frombuffer(made["numbers"], np.int32), np.frombuffer(made["weights"], np.float64), np.frombuffer(made["thresholds"], np.float64)
    return Model(numbers, weights, thresholds, made["only"])


def _fitted(sample: textfeatures.Sample) -> dict:
    y = sample.labels.astype(int)
    if len(set(y.tolist())) < 2:
        return {"numbers": b"", "weights": b"", "thresholds": b"", "only": int(y[0]) if len(y) else 0}
    w, thresholds = cumulative_link(sample.rows, sample.hashed, y, int(y.max()) + 1)
    seen = np.flatnonzero(np.abs(w) > 1e-4).astype(np.int32)
    return {"numbers": seen.tobytes(), "weights": w[seen].tobytes(), "thresholds": thresholds.tobytes(), "only": None}


def score(docs: DataFrame, model: Model, tail_grade: int = 1, keep_at: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail = P(grade >= tail_grade), and whether the row is kept."""
    if model.only is not None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(model.only)).alias("expected_grade"), F.lit(1.0).alias("tail"), F.lit(True).alias("kept"))
    z = textfeatures.scored(docs, (model.numbers, model.weights), shapes=True, scaled=True)
    above = [1 / (1 + F.exp(F.lit(float(t)) - F.col("z"))) for t in model.thresholds]
    expected = above[0]
    for p in above[1:]:
        expected = expected + p
    return z.select("doc_id", expected.alias("expected_grade"), above[min(tail_grade, len(above)) - 1].alias("tail")).withColumn("kept", F.col("tail") >= keep_at)


def judged(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    out = score(docs, fit(docs, labels, rows))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "expected_grade", "tail", "kept")
