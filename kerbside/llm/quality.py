"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character runs have learned vectors; a document is their average, and a
softmax over two outputs gives its quality. Vectors and outputs are trained by stochastic gradient
descent in numpy on a bounded sample. As the output is linear in the average, a vector's effect is
one number per bucket, and scoring a text is an average of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import grams
from kerbside.session import spread

DIM = 16
EPOCHS = 6
RATE = 0.5


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 3) -> tuple[np.ndarray, float]:
    """(effect of each bucket on the log odds of label 1, bias).

    With one label only, the bias alone says which; without rows it is 0.
    """
    rows = [(y, at, n / max(1, n.sum())) for y, at, n in rows]
    labels = [y for y, _, _ in rows]
    if len(set(labels)) < 2:
        return np.zeros(grams.BUCKETS, np.float32), (0.0 if not labels else 4.0 if labels[0] else -4.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (grams.BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    share = {y: len(labels) / (2 * labels.count(y)) for y in (0, 1)}  # both labels weigh the same
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, at, part = rows[i]
            rate = RATE * share[y] * (1 - done / steps)
            done += 1
            mean = part.astype(np.float32) @ vectors[at]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            wrong = p / p.sum()
            wrong[y] -= 1
            back = out @ wrong
            out -= rate * np.outer(mean, wrong)
            bias -= 0.1 * rate * wrong
            # a bucket's step is its share of the document times the number of its buckets, as if
            # each feature were seen in turn
            vectors[at] -= (rate * 20 * part[:, None] * back).astype(np.float32)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def quality_scorer(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality",
                   per_class: int = grams.SAMPLE_PER_CLASS):
    """A function of a text column: the probability of label 1, judged by the whole text.

    ``learn`` says which rows of ``labels`` (doc_id, label) may be learned from; at most ``per_class``
    documents of each label are. Null and empty texts have the score of the bias. Labels other than 0
    and 1 are ignored, an id with both counts as 1; empty tables leave the score at one half.
    """
    effect, bias = train(grams.sample_counts(grams.sample(docs, grams.labelled_ids(labels, label, learn), per_class),
                                             grams.subword_features))
    weights = effect[:, None]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        mean, _ = grams.sums_of(texts, grams.subword_features, weights)
        return pa.array(1 / (1 + np.exp(-np.clip(mean[:, 0] + bias, -40, 40))), pa.float64())

    return score


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """(doc_id, score) for every row, rows that repeat too; see ``quality_scorer``. Other columns than
    doc_id and text are not read."""
    score = quality_scorer(docs, labels, learn, **options)
    return spread(docs.select("doc_id", "text")).select("doc_id", score("text").alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, **options) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    score = quality_scorer(docs, labels, learn, **options)
    return docs.where(score("text") >= threshold)
