"""Toxicity from confirmed toxic texts and unlabelled ones: non-negative PU learning.

A linear classifier over telling words of a text is trained in numpy on the risk that needs
no confirmed clean texts: the prior times the risk of toxic texts, plus the risk of
unlabelled texts as clean ones less the share that toxic texts have in it. That second
part can't be negative in truth; where the sample makes it so, the step goes the other
way. The prior is the share of toxic rows among usable labels.

At most ``TOXIC`` toxic and ``UNLABELLED`` other texts are fitted, those with the smallest
hash of the id; all documents are scored over their whole texts. Words are runs of
letters in lower case, each counted once a text. Only words that toxic texts have more
often than unlabelled ones, by ``TELLING`` standard deviations, get a weight.
Unlabelled texts are drawn from all documents, whatever their labels.

Null texts count as empty, empty texts get the score of a text without known words.
Several labels of an id count as toxic if one is; null labels and labels without a
document are left out. Without toxic labels every score is 0. Repeated rows are scored
each. An empty table gives no rows. Further columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOXIC = 4_000
UNLABELLED = 12_000
TELLING = 5.0
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


class WordModel:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & words_of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(codes: np.ndarray, texts: np.ndarray, toxic: np.ndarray, prior: float, width: int, steps: int = 300) -> tuple:
    """Weights and bias by Adam on the non-negative risk with sigmoid loss.

    ``codes`` and ``texts`` are the word and the text of each entry of the presence matrix.
    """
    n, n_toxic, n_other = len(toxic), toxic.sum(), (~toxic).sum()
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weights, bias = np.zeros(width), np.log(prior / (1 - prior))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    rate, ridge = 0.1, 1e-6
    for step in range(1, steps + 1):
        z = bias + np.bincount(texts, weights[codes], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        # the sigmoid loss: p for a clean text, 1 - p for a toxic one
        clean_risk = p[~toxic].sum() / n_other - prior * p[toxic].sum() / n_toxic
        rise = p * (1 - p)
        slope = np.where(toxic, -prior * rise / n_toxic, rise / n_other)
        if clean_risk >= 0:
            slope -= np.where(toxic, prior * rise / n_toxic, 0)
        else:
            slope = -slope
        gradient = np.r_[np.bincount(codes, slope[texts], width) + ridge * weights, slope.sum()]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def telling(codes: np.ndarray, of_toxic: np.ndarray, n_toxic: int, n_other: int, width: int) -> np.ndarray:
    """Words that stand in more toxic texts than their share of unlabelled texts lets expect."""
    seen = np.bincount(codes[of_toxic], minlength=width)
    expected = np.bincount(codes[~of_toxic], minlength=width) / n_other * n_toxic
    return np.flatnonzero((seen - expected) / np.sqrt(expected + 0.5) >= TELLING)


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic") -> WordModel:
    """Fit with labels of rows for which ``usable`` (a condition on the id) holds."""
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    n, n_toxic = known.agg(F.count("*"), F.count(F.when(F.col("label") == 1, 1))).first()
    if not n_toxic:
        return WordModel({}, -40.0)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.where("label = 1").select("doc_id", F.lit(True).alias("toxic")).orderBy(*by_hash).limit(TOXIC)
    other = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    other = other.orderBy(*by_hash).limit(UNLABELLED).select("doc_id", F.lit(False).alias("toxic"))
    chosen = F.broadcast(toxic.unionByName(other))  # of at most TOXIC + UNLABELLED rows

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], ["words", "toxic"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    rows = rows.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), "toxic")
    found = rows.mapInArrow(measured, "words array<string>, toxic boolean").toArrow().combine_chunks()
    is_toxic = found.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    if not is_toxic.any() or is_toxic.all():
        return WordModel({}, -40.0)
    words = found.column("words")
    texts = pc.list_parent_indices(words).to_numpy()
    encoded = pc.list_flatten(words).combine_chunks().dictionary_encode()
    codes, names = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
    chosen_words = telling(codes, is_toxic[texts], is_toxic.sum(), (~is_toxic).sum(), len(names))
    # words in alphabetical order, so that the fit doesn't depend on the order of rows
    vocabulary = sorted(chosen_words.tolist(), key=names.__getitem__)
    new = np.full(len(names), -1)
    new[vocabulary] = np.arange(len(vocabulary))
    kept = new[codes] >= 0
    weights, bias = fit(new[codes[kept]], texts[kept], is_toxic, n_toxic / n, len(vocabulary))
    return WordModel({names[c]: float(w) for c, w in zip(vocabulary, weights)}, float(bias))


def scored(docs: DataFrame, model: WordModel) -> DataFrame:
    """Id and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")
