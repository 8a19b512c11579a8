"""Best-fit packing of token sequences: a configuration LP over the length histogram, rounded.

The histogram has at most ``capacity`` lengths, whatever the corpus, so the LP
is solved on the driver: multiplicative weights keep a price for each length,
a knapsack over the capacity prices the best filling around every length, and
fillings that are used too much make their lengths cheaper. The averaged
fillings are rounded to whole sequences and what is left goes to the tightest
space that holds it. The outcome is a plan of intervals: pieces number r0 to
r0+q of a length go to sequences s0 to s0+q at one offset. Pieces get their
number within a length from counts by task, so no task holds a whole length.

Null and empty texts are one piece of the closing id alone. Repeated rows are
packed each by itself. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.llm.common import shared
from urbanframe.llm.word_bpe import blocks, encoder

CAPACITY = 4096
#: The id that closes each document.
CLOSING = 1
#: Rounds of the weights, and how many of the last ones are averaged.
ROUNDS, AVERAGED = 20, 6
STEP = 0.35

PIECE_FIELDS = [
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()),
]
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """The pieces of every document, numbered by length within their task (``task``, ``nth``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode, close = encoder(tokenizer).encode, np.uint32(closing).astype("<u4").tobytes()
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                ids, at = encode(texts)
                data, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
                doc, start, length, crc = [], [], [], []
                for k in range(len(texts)):
                    own = data[at[k] : at[k + 1]] + close
                    for i in range(0, len(own), 4 * capacity):
                        part = own[i : i + 4 * capacity]
                        doc.append(first + k)
                        start.append(i // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                length = np.array(length, np.int64)
                order = np.argsort(length, kind="stable")
                held = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(held) - held, held)
                nth += seen[length]
                seen += held
                start = np.array(start, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)).cast(pa.int64()), *(
                        pa.array(x, t) for x, (_, t) in zip(
                            (start // capacity, start, length, crc, np.full(len(length), task), nth),
                            PIECE_FIELDS[1:], strict=True,
                        )
                    )], names=[n for n, _ in PIECE_FIELDS],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA)


def fillings(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Fillings of one sequence (lengths, falling) and how often each is used, as fractions."""
    price, used = lengths / capacity, {}
    for turn in range(ROUNDS):
        best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        for room in range(int(lengths[0]), capacity + 1):  # the knapsack over the capacity
            fit = np.searchsorted(lengths, room, side="right")
            worth = best[room - lengths[:fit]] + price[:fit]
            at = int(worth.argmax())
            best[room], last[room] = worth[at], lengths[at]
        rows, room = [lengths], capacity - lengths
        while (take := last[room]).any():
            rows.append(take)
            room = room - take
        table = -np.sort(-np.stack(rows, 1), axis=1)
        size = (table > 0).sum(1)
        share = counts / size
        cover = np.zeros(capacity + 1)
        np.add.at(cover, table, np.broadcast_to(share[:, None], table.shape))
        price = np.maximum(price * np.exp(-STEP * np.clip(cover[lengths] / counts - 1, -1, 2)), 1e-9)
        price /= best[capacity]
        if turn >= ROUNDS - AVERAGED:
            for row, k, x in zip(table.tolist(), size.tolist(), (share / AVERAGED).tolist(), strict=True):
                key = tuple(row[:k])
                used[key] = used.get(key, 0.0) + x
    return used


class _Space:
    """Groups of sequences with equal room left: (first sequence, how many)."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.groups = capacity, [], {}

    def add(self, room: int, first: int, many: int) -> None:
        if room and many:
            if room not in self.groups:
                self.groups[room] = []
                insort(self.rooms, room)
            self.groups[room].append((first, many))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, many = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.rooms[at]
        return room, first, many


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, how many, first sequence, offset), sorted by the first two."""
    if not histogram:
        return np.zeros((0, 5), np.int64)
    left, placed, rows = dict(histogram), dict.fromkeys(histogram, 0), []
    space, sequences = _Space(capacity), 0

    def put(length: int, many: int, sequence: int, offset: int) -> None:
        rows.append((length, placed[length], many, sequence, offset))
        placed[length] += many
        left[length] -= many

    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths.tolist()], float)
    exact = 0.0
    for filling, x in sorted(fillings(lengths, counts, capacity).items(), reverse=True):
        many = int(exact + x) - int(exact)  # the running total, rounded
        exact += x
        groups = [(sequences, many, 0)] if many else []
        sequences += many
        for length in filling:
            after = []
            for first, n, offset in groups:
                if k := min(n, left[length]):
                    put(length, k, first, offset)
                    after.append((first, k, offset + length))
                if n > k:
                    after.append((first + k, n - k, offset))
            groups = after
        for first, n, offset in groups:
            space.add(capacity - offset, first, n)
    for length in sorted(left, reverse=True):
        while left[length]:
            found = space.tightest(length)
            if found is None:
                n = -(-left[length] // (capacity // length))
                found = (capacity, sequences, n)
                sequences += n
            room, first, n = found
            k = min(n, left[length])
            put(length, k, first, capacity - room)
            space.add(room - length, first, k)
            space.add(room, first + k, n - k)
    out = np.array(rows, np.int64)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    found = shared(pieces(docs, tokenizer, capacity, closing))
    held = shared(found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # at most ROUNDS * capacity fillings, and one row for each length and task that has it
    table = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = held.select("task", "length", F.coalesce(before, F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        wide = 1 << 48
        keys = rows[:, 0] * wide + rows[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(keys, length * wide + number, side="right") - 1
            sequence = rows[at, 3] + number - rows[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(rows[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = found.join(first.hint("merge"), ["task", "length"]).withColumn("number", F.col("nth") + F.col("first"))
    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
