"""Toxicity: a logistic model with a counterfactual penalty.

Words and word beginnings are hashed; those most associated with the label in a
bounded sample carry the model. For every sampled text with identity terms,
copies are made in which each term is swapped for another group's, and a
squared difference of the logits of text and copy is added to the loss. A term
that happens to stand in many toxic texts thus gets no weight of its own, and a
neutral mention of a group does not raise the score.

Null and empty texts get the score of a text without features. Without labels of
both kinds every score is the share of toxic labels (0 without any). Repeated
rows get equal scores; other columns are ignored. Ties need no rule: nothing is
ranked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import shared, text_blocks, without_rows
from urbanframe.llm.labelled import Lookup, associated, hashed, remainder, sample

#: At most so many labelled documents are fitted, with so many features.
SAMPLE, FEATURES = 12_000, 1_500
#: Strengths of the counterfactual and of the ridge penalty; steps of the fit.
FAIRNESS, RIDGE, STEPS = 1.0, 2e-4, 400
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: Copies of a text, each with another swap.
SWAPS = 2

# Identity terms by kind; a term is swapped within its kind.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
)
_WORD = re.compile(r"[^\W\d_]+")
_KIND = {term: terms for terms in IDENTITY for term in terms}


def swapped(word: str, turn: int) -> str:
    """The identity term ``turn`` places further in its kind; another word stays."""
    terms = _KIND.get(word)
    if terms is None:
        return word
    return terms[(terms.index(word) + 1 + turn % (len(terms) - 1)) % len(terms)]


def word_features(word: str) -> list[int]:
    return [hashed("w", word), *(hashed(f"{k}", word[:k]) for k in PREFIXES if len(word) >= k)]


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def text_features(text: str) -> set[int]:
    return {f for w in _words(text) for f in word_features(w)}


class Model:
    """Weights of the chosen features; ``score(text)``."""

    def __init__(self, features: list[int], weights: np.ndarray, base: float):
        self.base = base
        self.weights = dict(zip(features, weights.tolist(), strict=True))

    def scorer(self):
        known = Lookup(lambda w: tuple(f for f in word_features(w) if f in self.weights))

        def score(text: str) -> float:
            found = {f for w in _words(text) for f in known[w]}
            logit = self.base + sum(self.weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


def _rows(held: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = [len(x) for x in held]
    return np.repeat(np.arange(len(held)), size), np.fromiter((i for x in held for i in x), np.int64, sum(size))


def fit(features: list[int], texts: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]]) -> Model:
    """Minimise log loss + FAIRNESS * mean squared logit change of the pairs + ridge, by Adam.

    ``texts`` and ``pairs`` hold positions in ``features``.
    """
    n, m = len(texts), len(features)
    row, col = _rows(texts)
    first, second = _rows([a for a, _ in pairs]), _rows([b for _, b in pairs])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(m + 1)
    w[m] = np.log(share / (1 - share))
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    add = lambda at, x, size: np.bincount(at, weights=x, minlength=size)
    for step in range(1, STEPS + 1):
        logit = add(row, w[col], n) + w[m]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        grad = np.append(add(col, error[row], m) + RIDGE * w[:m], error.sum())
        if pairs:
            change = (add(first[0], w[first[1]], len(pairs)) - add(second[0], w[second[1]], len(pairs))) * 2 * FAIRNESS / len(pairs)
            grad[:m] += add(first[1], change[first[0]], m) - add(second[1], change[second[0]], m)
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Model(features, w[:m], float(w[m]))


def train(rows: DataFrame) -> Model:
    """Fit on a sample (text, y): features are chosen and looked up by tasks, only their positions are gathered."""
    features = associated(rows, text_features, FEATURES)
    place = {f: i for i, f in enumerate(features)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(lambda w: tuple(place[f] for f in word_features(w) if f in place))
        positions = lambda words: sorted({i for w in words for i in known[w]})
        for batch, texts in text_blocks(batches):
            own, other = [], []
            for text in texts:
                words = _words(text)
                own.append(positions(words))
                turns = range(SWAPS) if not words.isdisjoint(_KIND) else ()
                other.append([positions({swapped(w, k) for w in words}) for k in turns])
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32())))],
                names=["y", "own", "other"],
            )

    found = rows.mapInArrow(look, "y int, own array<int>, other array<array<int>>").toArrow()
    y = found["y"].to_numpy().astype(float)
    if not features:
        share = float(y.mean()) if len(y) else 0.0
        return Model([], np.zeros(0), float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    own, other = found["own"].to_pylist(), found["other"].to_pylist()
    order = sorted(range(len(y)), key=lambda i: (own[i], y[i]))  # the sum does not depend on how rows arrive
    own, other, y = [own[i] for i in order], [other[i] for i in order], y[order]
    return fit(features, own, y, [(a, b) for a, swaps in zip(own, other, strict=True) for b in swaps])


def scores(docs: DataFrame, model: Model, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``carried`` (long) and score of every document."""
    names = ["doc_id", *carried]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).cast(pa.int64()) for c in names), pa.array([score(x) for x in texts], pa.float64())], names=[*names, "score"]
            )

    return docs.select(*names, "text").mapInArrow(rate, ", ".join(f"{c} long" for c in names) + ", score double")


def rated(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt where held_out is false."""
    model = train(sample(docs, labels, "toxic", remainder(4) != 2, bound))
    return scores(docs, model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they came.

    Rows are judged by their own text, also where an id repeats or is missing.
    """
    model = train(sample(docs, labels, "toxic", remainder(4) != 2, bound))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = scores(docs.select("doc_id", "text").withColumn("h", digest), model, ["h"])
    gone = rows.where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias("_id"), F.col("h").alias("_text"))
    return without_rows(docs, shared(gone.distinct()), digest)
