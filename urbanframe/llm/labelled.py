"""Labelled samples and hashed features for the two classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import shared, text_blocks

#: Entries a worker remembers of a feature lookup.
REMEMBERED = 200_000
#: Documents that must have a feature before it can be chosen.
LEAST = 5


def remainder(divisor: int) -> Column:
    """crc32(doc_id as text) mod ``divisor``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """text, y of at most ``bound`` labelled documents that are ``usable``, equal texts once.

    Those with the lowest hash of their id are taken, so the choice is the same
    in every run; of repeated labels the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(usable)
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # the bound is the proof that this side may be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(shared(ids)), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(
        F.min_by("text", "doc_id").alias("text"), F.min_by("y", "doc_id").alias("y")
    )
    return shared(rows.select("text", "y"))


class Lookup(dict):
    """Remembers a function of a string, for as many strings as fit."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = self.make(word)
        return got


def hashed(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}{word}".encode("utf-8", "surrogatepass"))


def associated(rows: DataFrame, features: Callable[[str], set[int]], top: int) -> list[int]:
    """The ``top`` hashed features that go most with the label (squared difference of shares over its variance)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, chars=8 << 20):
            y = batch.column("y").to_numpy()
            found = [np.fromiter(features(x), np.int64) for x in texts]
            size = [len(x) for x in found]
            if not sum(size):
                continue
            feature, at = np.unique(np.concatenate(found), return_inverse=True)
            n = np.bincount(at, minlength=len(feature))
            pos = np.bincount(at, weights=np.repeat(y, size), minlength=len(feature)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(n), pa.array(pos)], names=["feature", "n", "pos"])

    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < n:
        return []
    sums = rows.mapInArrow(count, "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    gap = F.col("pos") / pos - (F.col("n") - F.col("pos")) / (n - pos)
    share = F.col("n") / n
    spread = share * (1 - share) + 1 / n
    best = sums.where(F.col("n") >= LEAST).orderBy((gap * gap / spread).desc(), "feature").limit(top)
    return sorted(r.feature for r in best.select("feature").collect())


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a positive and a negative that are in order (ties count half)."""
    kinds, at, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = int(y.sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))
