"""Language identification in two steps: the family first, then the languages within it.

All decisions are linear support vector machines on hashed letter runs, one versus one: between
families on the first level, between the languages of a family on the second.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import grams
from kerbside.llm.common import in_arrow

UNKNOWN = "und"
PER_LANGUAGE = 400
EPOCHS = 8
SCALE = 30.0  # of feature frequencies, which add up to 1

#: Families of common language codes. Other codes are families of their own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int = 5, strength: float = 1e-4) -> np.ndarray:
    """Weights per bucket, the bias last: hinge loss by stochastic subgradient steps, averaged at the end."""
    rng = np.random.default_rng(seed)
    w, mean, scale, t = np.zeros(grams.BUCKETS + 1), np.zeros(grams.BUCKETS + 1), 1.0, 0
    side = {s: len(sign) / (2 * max(1, (sign == s).sum())) for s in (-1, 1)}
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1 / (strength * (t + 1e4))
            at, x = rows[i]
            margin = sign[i] * (scale * (w[at] @ x) + w[-1])
            scale *= 1 - rate * strength
            if margin < 1:
                step = rate * side[sign[i]] * sign[i]
                w[at] += step / scale * x
                w[-1] += 0.01 * step
        mean = mean + np.append(w[:-1] * scale, w[-1]) if epoch >= EPOCHS // 2 else mean
    return mean / (EPOCHS - EPOCHS // 2)


class Model:
    """Pairwise machines of both levels; their weights stand side by side as columns."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        rows = [(lang, at, SCALE * n / max(1, n.sum())) for lang, at, n in rows]
        self.languages = sorted({r[0] for r in rows})
        self.groups: dict[str, list[str]] = {}
        for lang in self.languages:
            self.groups.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.groups)
        self.pairs = list(combinations(self.families, 2))
        machines = [self._machine(rows, self.groups[a], self.groups[b]) for a, b in self.pairs]
        for family in self.families:
            for a, b in combinations(self.groups[family], 2):
                self.pairs.append((a, b))
                machines.append(self._machine(rows, [a], [b]))
        table = np.array(machines).T if machines else np.zeros((grams.BUCKETS + 1, 0))
        self.weights, self.bias = (table[:-1] * SCALE).astype(np.float32), table[-1]

    @staticmethod
    def _machine(rows, left, right):
        some = [(at, x) for lang, at, x in rows if lang in left or lang in right]
        return svm(some, np.array([1 if lang in left else -1 for lang, _, _ in rows if lang in left or lang in right]))

    def _choose(self, names: list[str], margins: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most wins (then largest sum of margins), and its smallest margin."""
        votes = np.zeros((len(margins), len(names)))
        least = np.full((len(margins), len(names)), np.inf)
        for c, (a, b) in enumerate(combinations(range(len(names)), 2)):
            m = margins[:, first + c]
            for side, value in ((a, m), (b, -m)):
                votes[:, side] += (value > 0) + 0.01 * np.tanh(value)
                least[:, side] = np.minimum(least[:, side], value)
        best = votes.argmax(axis=1)
        return best, least[np.arange(len(margins)), best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        mean, _ = grams.sums_of(texts, grams.letter_features, self.weights)
        margins = mean + self.bias
        family, sure = self._choose(self.families, margins, 0)
        names = np.empty(len(margins), object)
        first = len(self.families) * (len(self.families) - 1) // 2
        for f, name in enumerate(self.families):
            group = self.groups[name]
            best, least = self._choose(group, margins, first)
            first += len(group) * (len(group) - 1) // 2
            here = family == f
            names[here] = np.array(group, object)[best[here]]
            sure = np.where(here, np.minimum(sure, least), sure)
        return list(names), 1 / (1 + np.exp(-2 * np.clip(sure, -20, 20)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row's whole text.

    Learns from text and ``lang`` of the rows that ``learn`` marks, at most ``per_language`` of each
    language; ``lang`` is no input of a prediction. Null texts and texts without a letter are
    ``und`` with score 0, and so is everything if there is nothing to learn from. Rows that repeat
    are judged each, empty tables give empty results, other columns are not read.
    """
    learned = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    model = Model(grams.sample_counts(grams.sample(docs, learned, per_language), grams.letter_features))

    def score(texts: pa.Array) -> list:
        known = np.array([has_letter(t) for t in texts.to_pylist()], bool)
        if not model.languages:
            known[:] = False
            names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        else:
            names, sure = model.predict(texts)
        return [pa.array([n if k else UNKNOWN for n, k in zip(names, known)], pa.string()),
                pa.array(np.where(known, sure, 0.0), pa.float64())]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *score(batch.column(1))], ["doc_id", "lang_pred", "score"])

    return in_arrow(docs.select("doc_id", "text"), run,
                    f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")
