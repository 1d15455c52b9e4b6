"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed in their context.

The lexicon is a trie of whole terms and of stems (any word that begins so). The automaton that
accepts what is within one edit of a term is intersected with the trie and made deterministic as
words are read, so reading a letter is one look-up and most words are dropped after a few letters.
Terms and stems come from a list and from words that labels show to be toxic; a logistic model over
a document's matches gives the score. Matches in quotation marks or after words of reporting count
less, matches that address someone count more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import grams
from kerbside.session import spread

PER_CLASS = 4000
EVIDENCE = 10.5  # nats by which a term's families of documents differ from the share of toxic ones
STEM = (4, 8)  # letters
WINDOW = 6  # words of context on either side
FUZZY_LETTERS = 5  # terms shorter than this are matched exactly
_CACHE = 400_000
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~" + "«»“”„‘’‚…–—¡¿"

#: Common English insults, in use unless labels speak against them.
SEED_TERMS = ("idiot idiots idiotic moron morons moronic stupid loser losers scum trash worthless pathetic disgusting "
              "imbecile dumbass bastard scumbag retard degenerate vermin").split()
#: Words that report what others say, and words that address someone.
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes term word words claimed "
                      "sagte sagt schrieb wort nannte dit disait mot dijo dice palabra".split())
ADDRESSING = frozenset("you your youre you're u ur du dein deine ihr tu ton toi vous votre te tus eres usted".split())
_QUOTES = "\"“”„«»"


class Lexicon:
    """Terms and stems as a trie, read through a Levenshtein automaton of one edit."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], banned: frozenset[str] = frozenset()):
        self.terms, self.stems, self.banned = terms, stems, banned
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.stem_ends: list[str | None] = [None]
        self.fuzzy = [False]  # below this node lies a term long enough for an edit
        for word in sorted(terms):
            self._add(word, self.ends)
        for stem in sorted(stems):
            self._add(stem, self.stem_ends)
        start = frozenset(self._with_deletions({(0, 0)}))
        self.states = [start]
        self.number = {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.verdicts: dict[str, tuple[str, float, int] | None] = {}

    def _add(self, word: str, ends: list) -> None:
        node = 0
        for letter in word:
            if ends is self.ends and len(word) >= FUZZY_LETTERS:
                self.fuzzy[node] = True
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.ends.append(None)
                self.stem_ends.append(None)
                self.fuzzy.append(False)
            node = self.children[node][letter]
        if ends is self.ends and len(word) >= FUZZY_LETTERS:
            self.fuzzy[node] = True
        ends[node] = word

    def _with_deletions(self, places: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """A place is (trie node, edits); leaving out a letter of the term is an edit without input."""
        for node, edits in list(places):
            if edits == 0 and self.fuzzy[node]:
                places.update((child, 1) for child in self.children[node].values() if self.fuzzy[child])
        return places

    def _move(self, state: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(letter)
            if child is not None and (edits == 0 or self.fuzzy[child]):
                after.add((child, edits))
            if edits == 0 and self.fuzzy[node]:
                after.add((node, 1))  # a letter too many
                after.update((c, 1) for c in self.children[node].values() if self.fuzzy[c])  # another letter
        key = frozenset(self._with_deletions(after))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][letter] = to = self.number[key]
        return to

    def match(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of the best entry for a word in lower case, or None."""
        state, stem = 0, None
        for letter in word:
            to = self.moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            places = self.states[state]
            if not places:
                break
            for node, edits in places:
                if edits == 0 and self.stem_ends[node] is not None:
                    stem = self.stem_ends[node]
        else:
            best = None
            for node, edits in self.states[state]:
                term = self.ends[node]
                if term is not None and (edits == 0 or (len(term) >= FUZZY_LETTERS and word not in self.banned)):
                    best = min(best or (2, ""), (edits, term))
            if best and (best[0] == 0 or stem is None):
                return best[1], self.terms[best[1]], best[0]
        return (stem, self.stems[stem], 0) if stem else None

    def verdict(self, token: str) -> tuple[str, float, int] | None:
        """Of a token between white space, whatever punctuation stands at its ends."""
        if token in self.verdicts:
            return self.verdicts[token]
        if len(self.verdicts) > _CACHE:
            self.verdicts.clear()
        got = self.match(token.strip(_EDGE)) or self.match(token)
        self.verdicts[token] = got
        return got


class Match(NamedTuple):
    at: int  # word number
    term: str
    edits: int
    weight: float  # of the term
    context: float  # below 1 in a quotation, above 1 in an address


def _context(tokens: list[str], at: int) -> float:
    near = tokens[max(0, at - WINDOW):at + WINDOW + 1]
    before = tokens[max(0, at - WINDOW):at]
    after = tokens[at + 1:at + 1 + WINDOW]
    opened = sum(t.count(q) for t in before for q in _QUOTES) + sum(tokens[at][:1].count(q) for q in _QUOTES)
    closed = sum(t.count(q) for t in after for q in _QUOTES) + sum(tokens[at][1:].count(q) for q in _QUOTES)
    words = {t.strip(_EDGE) for t in near}
    value = 1.0
    if opened % 2 and closed:
        value *= 0.3
    if {t.strip(_EDGE) for t in before} & REPORTING:
        value *= 0.6
    if words & ADDRESSING:
        value *= 1.5
    return value


def find(text: str | None, lexicon: Lexicon) -> tuple[int, list[Match]]:
    """Number of words and all matches of a whole text."""
    tokens = (text or "").lower().split()
    hits = {t: v for t in set(tokens) if (v := lexicon.verdict(t)) is not None}
    if not hits:
        return len(tokens), []
    return len(tokens), [Match(i, v[0], v[2], v[1], _context(tokens, i))
                         for i, t in enumerate(tokens) if (v := hits.get(t)) is not None]


FEATURES = ("log of weighted exact matches", "their rate", "log of weighted fuzzy matches at their rate", "distinct terms")


def features(size: int, matches: list[Match]) -> list[float]:
    exact = sum(m.weight * m.context for m in matches if m.edits == 0)
    fuzzy = sum(m.weight * m.context for m in matches if m.edits)
    per = 100 / max(20, size)
    return [math.log1p(exact), math.log1p(exact * per), math.log1p(fuzzy * per), math.log1p(len({m.term for m in matches if not m.edits}))]


#: What the model holds of each feature before it has seen labels, and the bias.
PRIOR = np.array([1.0, 1.0, 1.0, 0.5, -2.5])


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression around the prior, by Newton steps; the last weight is the bias."""
    w = PRIOR.copy()
    if not len(y):
        return w
    x = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - PRIOR)
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + strength * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w -= step / max(1, np.abs(step).max())
    return w


def _evidence(toxic, clean, share: float):
    """Nats by which the share of toxic documents among a word's documents exceeds the share of all."""
    n = toxic + clean
    p = toxic / n
    with np.errstate(divide="ignore", invalid="ignore"):
        other = np.where(clean > 0, (1 - p) * np.log((1 - p) / (1 - share)), 0.0)
    return np.where(p > share, n * (p * np.log(p / share) + other), 0.0)


def learn_lexicon(sampled: DataFrame) -> Lexicon:
    """Terms and stems whose documents are toxic far more often than chance allows.

    Words and their beginnings are counted in Spark, by families of documents: texts whose words
    have the same smallest hash, as copies and most near copies do, count as one. Only those in
    several toxic families and in nearly no other come to the driver, a number bounded by the sample.
    """
    def words_of(text: str | None) -> set[str]:
        found = {t.strip(_EDGE) for t in set((text or "").lower().split())}
        return {w for w in found if len(w) > 2 and w.isalpha()}

    def family(found: set[str]) -> int:
        return min((crc32(w.encode()) * 0x9E3779B1 % 2**32 for w in found), default=0)

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(
                [family(words_of(t)) for t in batch.column(1).to_pylist()], pa.int64())], ["label", "family"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = words_of(text)
                stems = {w[:n] + "*" for w in found for n in range(STEM[0], STEM[1] + 1) if len(w) > n}
                kin = family(found)
                out += [(w, label, kin) for w in found | stems]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                                              pa.array([o[2] for o in out], pa.int64())], ["word", "label", "family"])

    counted = sampled.mapInArrow(run, "word string, label int, family long").distinct()
    sizes = {r["label"]: r["n"] for r in sampled.mapInArrow(families, "label int, family long").distinct().groupBy(
        "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({t: 2.0 for t in SEED_TERMS}, {})
    share = sizes[1] / (sizes[0] + sizes[1])
    words = counted.groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    counts = words.where("toxic >= 4 and toxic > 8 * clean").toPandas()
    sure = _evidence(counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float), share) >= EVIDENCE
    chosen = {w: (t, c) for w, t, c in counts[sure][["word", "toxic", "clean"]].itertuples(index=False)}
    odds = lambda t, c: math.log((t + 0.5) / (sizes[1] + 1) / ((c + 0.5) / (sizes[0] + 1)))
    begins = {w[:-1]: n for w, n in chosen.items() if w.endswith("*")}
    stems = {}
    for stem in sorted(begins, key=lambda s: (len(s), s)):
        inside = max((t for w, (t, _) in chosen.items() if not w.endswith("*") and w.startswith(stem)), default=0)
        if any(stem.startswith(s) for s in stems) or begins[stem][0] <= 1.5 * inside or begins[stem][1] > 0.02 * begins[stem][0]:
            continue
        while longer := [s for s in begins if s.startswith(stem) and len(s) == len(stem) + 1 and begins[s][0] >= 0.9 * begins[stem][0]]:
            stem = longer[0]  # as long as it hardly loses a document
        stems[stem] = min(6.0, odds(*begins[stem]))
    terms = {w: min(6.0, odds(t, c)) for w, (t, c) in chosen.items() if not w.endswith("*")}
    common = {r["word"] for r in words.where(F.col("word").isin(SEED_TERMS) & (F.col("clean") * 4 > F.col("toxic"))).collect()}
    terms = {t: 2.0 for t in SEED_TERMS if t not in common} | terms
    return Lexicon(terms, stems)


def _innocent(sampled: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words of clean documents that only an edit takes to a term: they are words of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {t.strip(_EDGE) for text in batch.column(1).to_pylist() for t in set((text or "").lower().split())
                   if (v := lexicon.verdict(t)) is not None and v[2]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["word"])

    rows = sampled.where("label = 0").mapInArrow(run, "word string").distinct().collect()
    return frozenset(r["word"] for r in rows)


def toxicity_scorer(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = PER_CLASS):
    """A function of a text column: the probability that the whole text is toxic.

    Learns from at most ``per_class`` documents of each label among the rows of ``labels`` that
    ``learn`` marks. Null and empty texts have no match and score lowest. Without labels of both
    kinds the built-in terms and weights serve.
    """
    sampled = grams.sample(docs, grams.labelled_ids(labels, label, learn), per_class).persist()
    try:
        lexicon = learn_lexicon(sampled)
        lexicon = Lexicon(lexicon.terms, lexicon.stems, _innocent(sampled, lexicon))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [features(*find(t, lexicon)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["x", "label"])

        got = sampled.mapInArrow(measure, "x array<double>, label int").toPandas()
    finally:
        sampled.unpersist()
    got = got.sort_values("x", key=lambda c: c.map(tuple)) if len(got) else got  # sums don't depend on the order of rows
    weights = fit(np.array(got["x"].to_list()).reshape(-1, len(PRIOR) - 1), got["label"].to_numpy(float))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([features(*find(t, lexicon)) for t in texts.to_pylist()]).reshape(-1, len(PRIOR) - 1)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))), pa.float64())

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, **options) -> DataFrame:
    """(doc_id, score) for every row, rows that repeat too; see ``toxicity_scorer``. Empty tables give
    empty results; columns other than doc_id and text are not read."""
    score = toxicity_scorer(docs, labels, learn, **options)
    return spread(docs.select("doc_id", "text")).select("doc_id", score("text").alias("score"))
