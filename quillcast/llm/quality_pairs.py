"""Quality scores from preference pairs (Bradley-Terry), with a quantile as threshold.

A document's score is a weighted sum of text statistics. Weights come from pairs of a
good and a bad labelled document by logistic loss on the difference of their statistics.
Such scores have no zero of their own: the threshold is the quantile of the labelled
scores at the share of bad ones, and scores are shifted so that it lands at a stated
probability.

Weights are fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of
the id, and on ``PAIRS`` pairs drawn from them with a fixed seed; every document is scored over its whole text. Labels, ids and all columns but
the text stay out of the statistics.

Null texts count as empty, empty texts are scored like others. Several labels of an id
count as the lowest; null labels and labels without a document are left out. Without
labels of both kinds every score is 0.5. Repeated rows are scored each. An empty table
gives no rows. Further columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcast.llm.common import few_rows

SAMPLE = 20_000
PAIRS = 60_000
SHOWN = range(33, 127)


def statistics(text: str) -> np.ndarray:
    """Shares of printable signs and of kinds of them, word and line statistics."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size = max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    lines = text.split("\n")
    repeated = len(lines) - len(set(lines))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    kinds = [
        counts[65:91].sum() / max(letters, 1),
        counts[48:58].sum() / size,
        counts[128:].sum() / size,
        (size - letters - counts[32] - counts[10]) / size,
        letters / size,
        letters / n / 10,
        len(set(words)) / n,
        max(Counter(words).values(), default=0) / n,
        repeated / len(lines),
        np.log1p(len(words)) / 10,
        np.log1p(len(words) / len(lines)) / 5,
        float(not words),
    ]
    # shares are small, so roots spread them
    return np.concatenate([np.sqrt(counts[SHOWN] / size), np.sqrt(np.abs(kinds[:4])), kinds[4:]])


WIDTH = len(statistics(""))


class PairModel:
    """Weights of standardised statistics, and the threshold on their sum."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, lands_at: float):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.threshold, self.shift = threshold, np.log(lands_at / (1 - lands_at))
        self.trained = bool(np.any(weights))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z - self.threshold + self.shift, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, lands_at: float, ridge: float = 1e-3, steps: int = 25) -> PairModel:
    """Newton steps for the logistic loss of the pairs' differences."""
    if not len(x) or good.all() or not good.any():
        return PairModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, lands_at)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    rng = np.random.default_rng(0)
    a, b = rng.choice(best, PAIRS), rng.choice(worst, PAIRS)
    difference = z[a] - z[b]
    weights = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(difference @ weights, -40, 40)))
        gradient = difference.T @ (p - 1) / PAIRS + ridge * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / PAIRS + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return PairModel(mean, scale, weights, float(np.quantile(z @ weights, (~good).mean())), lands_at)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def sampled(labels: DataFrame, label: str, usable, rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id."""
    one = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = one.groupBy("doc_id").agg(F.min(label).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "quality", lands_at: float = 0.3) -> PairModel:
    """Fit on labelled rows for which ``usable`` (a condition on the id) holds."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["x", "label"])

    chosen = F.broadcast(sampled(labels, label, usable))  # of at most SAMPLE rows
    rows = texts_of(docs.select("doc_id", "text").join(chosen, "doc_id"), "label")
    found = rows.mapInArrow(measured, "x array<double>, label int").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, WIDTH)
    good = np.array(found.column("label").to_pylist(), int) == 1
    order = np.lexsort(np.c_[x, good].T) if len(x) else []  # the same fit whatever the order of the rows
    return fit(x[order], good[order], lands_at)


def scored(docs: DataFrame, model: PairModel) -> DataFrame:
    """Id and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, f"doc_id {kind}, score double")


def good_documents(docs: DataFrame, model: PairModel, at_least: float) -> DataFrame:
    """The documents, with all their columns, that score as much."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.scores(x) >= at_least))

    return docs.mapInArrow(run, docs.schema)
