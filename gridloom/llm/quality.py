"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled good texts; the unlabelled are texts of the
corpus as they come. The risk of a linear classifier over binned surface
statistics of whole texts is pi * R_p+ + max(0, R_u- - pi * R_p-) (Kiryo et
al., 2017): the part that stands for the negatives is kept from falling below
zero, as it would by overfitting. The class prior pi is estimated from
positives and unlabelled texts alone, by best bin estimation (Garg et al.,
2021): a contrast of the two is fitted on one half of each; on the other
half, the least ratio of their shares over a threshold, with room for chance,
is the share of positives among the unlabelled, as some top bin holds nearly
no negative. No row labelled 0 is learnt from.

Bounds: `label_rows` positives, by a hash of the id, and at most `train_rows`
drawn unlabelled texts are fetched for training; the score covers every whole
text.

Nulls: a null text is empty and scores as an empty one; a null id is not held
out; labels of null ids or of null class are not used, of several labels of an
id the highest counts. Without positives every text scores `default_prior`. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_text_an_id, row_blocks, sampled
from .features import STATISTICS, statistics
from .toxicity import held_out, usable

BINS = 24


def _vectors(rows: DataFrame) -> np.ndarray:
    """Statistics of a bounded number of texts."""

    def work(batches):
        for _, texts in row_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(texts)), pa.list_(pa.float64()))], ["v"])

    found = rows.select("text").mapInArrow(work, "v array<double>").toArrow().column("v")
    flat = found.combine_chunks().flatten() if len(found) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def binned(vectors: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The place of each text's bin of each statistic among all bins."""
    at = 0
    out = np.empty(vectors.shape, np.int64)
    for k, e in enumerate(edges):
        out[:, k] = at + np.searchsorted(e, vectors[:, k], side="right")
        at += len(e) + 1
    return out


def bin_edges(vectors: np.ndarray) -> list[np.ndarray]:
    """Quantiles, the outermost close to the ends, where rare texts lie."""
    points = np.concatenate([[0.002, 0.005, 0.01, 0.02], np.linspace(0.04, 0.96, BINS - 8), [0.98, 0.99, 0.995, 0.998]])
    return [np.unique(np.quantile(vectors[:, k], points)) if len(vectors) else np.zeros(0) for k in range(vectors.shape[1])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, size: int, rounds: int = 600, l2: float = 1e-3) -> np.ndarray:
    """Weights of bins, the bias last, by Adam on the non-negative risk with the logistic loss."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))

    def gradient(rows, error):
        g = np.bincount(rows.ravel(), weights=np.repeat(error, rows.shape[1]), minlength=size + 1) / len(rows)
        g[-1] = error.mean()
        return g

    for step in range(1, rounds + 1):
        p, u = (1 / (1 + np.exp(-np.clip(w[x].sum(1) + w[-1], -30, 30))) for x in (positive, unlabelled))
        risk = -np.log(np.maximum(1 - u, 1e-9)).mean() + prior * np.log(np.maximum(1 - p, 1e-9)).mean()
        negative = gradient(unlabelled, u) - prior * gradient(positive, p)
        g = prior * gradient(positive, p - 1) + negative if risk >= 0 else -negative
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def contrast(positive: np.ndarray, unlabelled: np.ndarray, size: int, rounds: int = 250, l2: float = 3e-3) -> np.ndarray:
    """Weights of bins that tell positives from unlabelled rows: logistic regression, both sides alike in weight."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    mean = lambda rows, error: np.bincount(rows.ravel(), weights=np.repeat(error, rows.shape[1]), minlength=size) / len(rows)
    for step in range(1, rounds + 1):
        p, u = (1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30))) for x in (positive, unlabelled))
        g = mean(positive, p - 1) + mean(unlabelled, u) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, size: int, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows of bins; close to 1 where rows are too few to tell."""
    w = contrast(positive[::2], unlabelled[::2], size)
    p, u = (np.sort(w[x[1::2]].sum(1)) for x in (positive, unlabelled))
    if not len(p) or not len(u):
        return 1.0
    share_p = 1 - np.searchsorted(p, p, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    room = np.sqrt(np.log(4 / doubt) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((share_u + room) / share_p)
    return float(min(1.0, share_u[best] / share_p[best]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", divisor: int = 4, rest: int = 2, id_col: str = "doc_id", text_col: str = "text", label_rows: int = 8000, train_rows: int = 20_000, default_prior: float = 0.8) -> dict:
    """The bins, their weights and the class prior."""
    once = usable(labels, label_col, divisor, rest, id_col).groupBy("label_id").agg(F.max("label").alias("label"))
    trusted = F.broadcast(once.where("label = 1").orderBy(F.xxhash64("label_id"), "label_id").limit(label_rows).select("label_id"))  # label_rows rows at most
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text"))
    positive = _vectors(one_text_an_id(texts.join(trusted, "label_id", "left_semi")))
    unlabelled = _vectors(sampled(texts, train_rows))
    edges = bin_edges(np.concatenate([positive, unlabelled]))
    size = sum(len(e) + 1 for e in edges)
    if not len(positive) or not len(unlabelled):
        return {"edges": edges, "weights": np.append(np.zeros(size), np.log(default_prior / (1 - default_prior))), "prior": default_prior}
    good, mixed = binned(positive, edges), binned(unlabelled, edges)
    prior = float(np.clip(estimated_prior(good, mixed, size), 0.02, 0.98))
    return {"edges": edges, "weights": fit(good, mixed, prior, size), "prior": prior}


def score(docs: DataFrame, model: dict, divisor: int = 4, rest: int = 2, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    edges, weights = model["edges"], model["weights"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, divisor, rest).alias("held_out"), F.col(text_col).alias("text"))

    def work(batches):
        for part, texts in row_blocks(batches, "text"):
            z = weights[binned(statistics(texts), edges)].sum(1) + weights[-1]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "held_out", "score"])

    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))
