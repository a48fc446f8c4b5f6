"""Quality classifier of supervised subword embeddings.

Words and character n-grams are hashed to buckets; each bucket has a learned vector. A text is the mean of
the vectors of all its features, and a softmax layer over it gives the class. The vectors are
trained by stochastic gradient descent on a bounded sample of labelled rows; as the layer is linear,
scoring folds it into the vectors, and every whole text costs one look-up per feature.

An empty or null text has no features: its score is the learned bias alone. Rows without a label
are only scored. If fewer than two classes are labelled, every score is the share of label 1
(0.5 without any label). Repeated rows get equal scores, so there are no ties to break; a very long text is
worked through in slices. Scoring keeps whole rows, so no column can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import labelled_sample, small, whole_row
from wardspark.llm.features import character_grams, word_buckets

BITS = 15
DIM = 16
GRAMS = (3, 4, 5)
# About so many rows of each label are fitted; all others are only scored.
SAMPLE_PER_LABEL = 500
EPOCHS = 8
RATE = 0.5


def buckets(text: object) -> Iterator[np.ndarray]:
    if isinstance(text, str) and text:
        yield word_buckets(text.encode(), BITS)
        yield from character_grams(text, GRAMS, BITS)


def _counted(text: object) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(1 << BITS, np.int64)
    for part in buckets(text):
        total += np.bincount(part, minlength=1 << BITS)
    found = np.flatnonzero(total)
    return found.astype(np.int16), total[found].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, for label 1 against 0
    bias: float

    def score(self, text: object) -> float:
        total, n = 0.0, 0
        for part in buckets(text):
            total += float(self.weights[part].sum(dtype=np.float64))
            n += len(part)
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / max(n, 1), -30, 30))))


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
        rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the buckets, weights and bias of the two classes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            out = hidden @ layer + bias
            wrong = np.exp(out - out.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            back = layer @ wrong
            layer -= lr * np.outer(hidden, wrong)
            bias -= lr * 0.1 * wrong
            # scaled so that the text's mean moves by the rate, however many features it has
            vectors[at] -= (lr / float(share @ share) * share)[:, None] * back
    return vectors, layer, bias


def train(docs: DataFrame, label: str, per_label: int = SAMPLE_PER_LABEL,
          labels: DataFrame | None = None) -> Model:
    """Fits a sample of the rows of ``docs`` (``doc_id, text``) by a label of 0 or 1, from ``labels``
    (``doc_id`` and the label) or ``docs`` itself.

    The labels are sampled first; only the ids of the sample, about ``per_label`` of each, are
    broadcast to the texts, which aren't shuffled. Should ids repeat so often that the sample is large, it is
    joined by a shuffle instead.
    """
    labelled = (docs if labels is None else labels).select(
        "doc_id", F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    sizes = dict(labelled.groupBy("y").count().collect())
    if len(sizes) < 2:
        share = 0.5 if not sizes else float(next(iter(sizes)))
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + .01) / (1.01 - share))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_counted(t) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "at": [a for a, _ in found],
                                "n": [n for _, n in found]})

    chosen = small(labelled_sample(labelled, "y", per_label, F.col("doc_id")))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").filter("text != ''")
    fitted = (sample.select("text", "y").mapInPandas(run, "y int, at array<smallint>, n array<float>")
              .toPandas())
    order = np.argsort([(int(np.sum(a)), len(a)) for a in fitted["at"]], axis=0)[:, 0]
    fitted = fitted.iloc[order]  # independent of the order in which tasks end
    rows = [(np.asarray(a), np.asarray(n) / np.sum(n))
            for a, n in zip(fitted["at"], fitted["n"])]
    labels = fitted["y"].to_numpy()
    vectors, layer, bias = sgd(rows, labels)
    # the sample holds the classes evenly; the corpus doesn't
    fit = np.bincount(labels, minlength=2) + 1.0
    prior = np.log(sizes[1] / sizes[0]) - np.log(fit[1] / fit[0])
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32),
                 float(bias[1] - bias[0] + prior))


def score(docs: DataFrame, model: Model, text: Column | None = None) -> DataFrame:
    """``_row`` (the whole row of ``docs``) and ``score``, 0 to 1, of its text."""
    @F.pandas_udf("double")
    def scored(texts):
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.select(whole_row(docs).alias("_row"),
                       scored(F.col("text") if text is None else text).alias("score"))
