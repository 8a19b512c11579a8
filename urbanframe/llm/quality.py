"""Quality: a factorisation machine over hashed words, structure statistics and text metadata.

A text is a sparse vector: the hashed tokens most associated with the label in a
bounded sample, binned statistics of its structure (signs, capitals, digits,
lines, repeats) and its size as metadata. The machine adds a low-rank product
for each pair of features; a score needs one pass over a text's features,
because the sum over pairs is half of (square of the sum - sum of the squares)
in each factor.

Null and empty texts get the score of their bins. Without labels of both kinds
every score is the share of good labels (0 without any). Repeated rows get
equal scores; other columns are ignored. Ties need no rule: nothing is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import text_blocks
from urbanframe.llm.labelled import Lookup, associated, hashed, remainder, sample

#: At most so many labelled documents are fitted, with so many hashed tokens.
SAMPLE, TOKENS = 10_000, 600
RANK, STEPS, RIDGE = 8, 250, 1e-3
THRESHOLD = 0.3
BINS = 10

_KINDS = np.full(256, 5, np.uint8)  # 5: part of a letter beyond ASCII
_KINDS[:128] = 4  # 4: a sign
_KINDS[[9, 10, 11, 12, 13, 32]] = 3
_KINDS[48:58] = 2
_KINDS[65:91] = 1
_KINDS[97:123] = 0
_LINE = ord("\n")
STATISTICS = ("signs", "capitals", "digits", "lines", "distinct", "word bytes", "commonest", "size")


def statistics(text: str, words: list[str], distinct: set[str]) -> list[float]:
    """One value for each of STATISTICS; shares of bytes or words, and the log of the size."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    held = np.bincount(_KINDS[data], minlength=6)
    n, count = len(data) + 1, len(words) + 1
    lines = int((data == _LINE).sum())
    run = sum(a == b for a, b in zip(words, words[1:], strict=False)) if len(distinct) < 0.6 * len(words) else 0
    return [held[4] / n, held[1] / n, held[2] / n, lines / count, len(distinct) / count, n / count, run / count, float(np.log(n))]


def token_feature(token: str) -> int:
    """Letters count as one kind, so that a sign pattern is a token of its own."""
    stem = token.strip("!$%&*#.,:;-|=~^<>")
    return hashed("s", token.replace(stem, "a", 1)) if stem and stem != token else hashed("t", token)


def text_features(text: str) -> set[int]:
    return {token_feature(x) for x in set(text.split())}


class Machine:
    """``score`` of a vector with ones at the given positions; the positions are tokens, then bins."""

    def __init__(self, tokens: list[int], edges: np.ndarray, base: float, linear: np.ndarray, factors: np.ndarray):
        self.tokens = {f: i for i, f in enumerate(tokens)}
        self.edges, self.base, self.linear, self.factors = edges, base, linear, factors

    def reader(self):
        place, bins = self.tokens, len(self.tokens)
        known = Lookup(lambda w: place.get(token_feature(w), -1))

        def positions(text: str) -> list[int]:
            words = text.split()
            distinct = set(words)
            found = {known[w] for w in distinct} - {-1}
            values = statistics(text, words, distinct)
            held = [bins + i * BINS + int(np.searchsorted(e, v)) for i, (e, v) in enumerate(zip(self.edges, values, strict=True))]
            return sorted(found) + held

        return positions

    def logit(self, at: list[int]) -> float:
        v = self.factors[at]
        total = v.sum(0)
        return float(self.base + self.linear[at].sum() + 0.5 * (total * total - (v * v).sum(0)).sum())


def fit(machine: Machine, rows: list[list[int]], y: np.ndarray) -> Machine:
    """Log loss with a ridge penalty, by Adam over all rows."""
    n, m = len(rows), len(machine.linear)
    x = np.zeros((n, m), np.float32)
    for i, at in enumerate(rows):
        x[i, at] = 1
    w, v = machine.linear.astype(np.float32), machine.factors.astype(np.float32)
    base = np.float32(machine.base)
    held = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1, np.float32))]
    for step in range(1, STEPS + 1):
        total = x @ v
        logit = base + x @ (w - 0.5 * (v * v).sum(1)) + 0.5 * (total * total).sum(1)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        seen = x.T @ error
        grads = (seen + RIDGE * w, x.T @ (error[:, None] * total) - seen[:, None] * v + RIDGE * v, np.array([error.sum()]))
        moves = []
        for (mean, square), grad in zip(held, grads, strict=True):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            moves.append(0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8))
        w, v, base = w - moves[0], v - moves[1], base - np.float32(moves[2][0])
    return Machine(list(machine.tokens), machine.edges, float(base), w.astype(float), v.astype(float))


def train(rows: DataFrame) -> Machine:
    """Fit on a sample (text, y): tokens are chosen and looked up by tasks, only positions are gathered."""
    tokens = associated(rows, text_features, TOKENS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(tokens)}
        for batch, texts in text_blocks(batches):
            values, found = [], []
            for text in texts:
                words = text.split()
                distinct = set(words)
                values.append(statistics(text, words, distinct))
                found.append(sorted({place[f] for f in map(token_feature, distinct) if f in place}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(values, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int32()))],
                names=["y", "values", "found"],
            )

    got = rows.mapInArrow(measure, "y int, values array<double>, found array<int>").toArrow()
    y = got["y"].to_numpy().astype(np.float32)
    values, found = got["values"].to_pylist(), got["found"].to_pylist()
    share = float(y.mean()) if len(y) else 0.0
    base = float(np.log(max(share, 1e-13) / max(1 - share, 1e-13)))
    m = len(tokens) + len(STATISTICS) * BINS
    if not 0 < share < 1:
        return Machine(tokens, np.zeros((len(STATISTICS), BINS - 1)), base, np.zeros(m), np.zeros((m, RANK)))
    order = sorted(range(len(y)), key=lambda i: (values[i], found[i], y[i]))  # so that arrival does not matter
    y, values, found = y[order], np.array([values[i] for i in order]), [found[i] for i in order]
    edges = np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    rows_ = [
        at + [len(tokens) + i * BINS + int(np.searchsorted(e, x)) for i, (e, x) in enumerate(zip(edges, own, strict=True))]
        for at, own in zip(found, values, strict=True)
    ]
    factors = np.random.default_rng(0).normal(0, 0.02, (m, RANK))
    return fit(Machine(tokens, edges, base, np.zeros(m), factors), rows_, y)


def rated(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learnt where held_out is false."""
    machine = train(sample(docs, labels, "quality", remainder(5) != 0, bound))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = machine.reader()
        for batch, texts in text_blocks(batches):
            logit = np.clip([machine.logit(positions(x)) for x in texts], -30, 30)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-logit)))], names=["doc_id", "score"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, score double")
    return scored.select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
