"""Ranked lexical search: exact inner products through sparse ball trees.

A document is a sparse vector over the terms the items use, an item a vector
over its own terms; the score is their inner product, in whole numbers.

1. Every whole text is read once: its term count and its counts of the items'
   terms become a row of a table. Document counts of terms, the number of
   documents and of all terms are summed from it.
2. Rows are weighed and sorted by their three heaviest terms over range
   partitions, so that neighbours are alike; the document id comes last in the
   order, so a third of all rows with one text still spreads over tasks.
3. A task cuts its rows into blocks and each block into a ball tree: a node has a
   centroid, a radius and the terms that occur in it. For an item q and any
   document x of a node, q.x <= q.c + |q|.r, with |q| over the terms of the node;
   all roundings go up.
4. First pass: every block follows each item into its most promising leaf. The
   best scores of these documents give each item a threshold that ``k`` documents
   reach. Second pass: subtrees are visited best bound first, as long as the bound
   is not below the threshold or the k-th best of the task. Leaves are scored in
   64-bit integers, as are all sums.
5. Each task hands on ``k`` documents an item; Spark merges those.

Items are taken in groups of ``ITEMS``, so what a task holds of them does not
grow with their number. Null texts have no terms; items and documents without
terms find nothing and are not found. Equal scores go by ascending ``doc_id``,
rows without one last; repeated rows are documents of their own. Rows of items
with the same id and text are one item; the same id with another text is another
item, ranked by itself. Empty tables give an empty result; other columns are
ignored. Very long texts are counted in pieces cut between terms.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.llm.common import shared, text_blocks

#: Documents of a block and of a leaf, items searched together, bytes of text split at once.
BLOCK, LEAF, ITEMS, PIECE = 1024, 16, 256, 1 << 20

#: Bytes of terms: digits, letters (A-Z become lower case) and everything beyond ASCII; the rest separates.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(text: str) -> Iterator[list[bytes]]:
    data = text.encode().translate(TERMS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _item_terms(text: str | None) -> list[bytes]:
    return sorted({t for piece in _terms(text or "") for t in piece})


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and, for the numbered terms that occur, terms and tf; only rows with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in text_blocks(batches):
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in texts:
                held, n = Counter(), 0
                for piece in _terms(text):
                    n += len(piece)
                    held.update(piece)
                known = [(numbers[t], tf) for t, tf in held.items() if t in numbers]
                known.sort()
                terms += [t for t, _ in known]
                tfs += [tf for _, tf in known]
                sizes.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            out = pa.record_batch({
                "doc_id": block.column("doc_id").cast(pa.int64()), "n": pa.array(sizes, pa.int64()),
                "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                "tf": pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
            })
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "doc_id long, n long, terms array<int>, tf array<long>"
    )


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def weighed(rows: DataFrame, weight: np.ndarray, documents: int, occurrences: int) -> DataFrame:
    """doc_id, terms, score (of each term in the document) and the three heaviest terms; only rows with a score."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [10 + 90 * n * documents // occurrences for n in batch.column("n").to_pylist()]
            lists = batch.column("terms")
            terms, tf = lists.flatten().to_numpy(zero_copy_only=False), batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            long = np.repeat(np.array(m, np.int64), sizes)
            score = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * long))
            rank = np.lexsort((terms, -score, np.repeat(np.arange(len(sizes)), sizes)))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            heavy = {}
            for j in range(3):
                at = np.minimum(ends[:-1] + j, max(len(terms) - 1, 0))
                heavy[f"t{j}"] = np.where(sizes > j, terms[rank[at]] if len(terms) else -1, -1).astype(np.int32)
            offsets = pa.array(ends, pa.int32())
            out = pa.record_batch({
                "doc_id": batch.column("doc_id"), "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                "score": pa.ListArray.from_arrays(offsets, pa.array(score, pa.int64())), **{c: pa.array(v) for c, v in heavy.items()},
            })
            yield out.filter(pa.array(sizes > 0))

    return rows.mapInArrow(weigh, "doc_id long, terms array<int>, score array<long>, t0 int, t1 int, t2 int")


class BallTree:
    """Ball tree over the sparse documents of one block.

    Scores are split between the two sides: a term of weight w counts sqrt(w) in
    the item and score / sqrt(w) in the document.
    """

    def __init__(self, ends: np.ndarray, terms: np.ndarray, scores: np.ndarray, weight: np.ndarray, leaf: int = LEAF):
        self.columns, local = np.unique(terms, return_inverse=True)
        share = scores / np.sqrt(np.maximum(weight[terms], 1))
        rows = len(ends) - 1
        doc = np.repeat(np.arange(rows), np.diff(ends))
        square = np.bincount(doc, share * share, rows)
        width = len(self.columns)
        order, self.nodes, centres, held = np.arange(rows), [], [], []  # node: first, last, radius, left, right
        todo = [(0, rows, None, 0)]
        while todo:
            first, last, parent, side = todo.pop()
            at = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in order[first:last]])
            sizes = np.diff(ends)[order[first:last]]
            cols, vals, starts = local[at], share[at], np.concatenate([[0], np.cumsum(sizes)[:-1]])
            centre = np.bincount(cols, vals, width) / (last - first)
            norm, own = float(centre @ centre), square[order[first:last]]
            apart = own - 2 * np.add.reduceat(vals * centre[cols], starts) + norm
            # rounding of the three sums is far below this share of them
            radius = math.sqrt(max(float((apart + 1e-9 * (own + norm)).max()), 0.0)) * (1 + 1e-9)
            number = len(self.nodes)
            self.nodes.append([first, last, radius, -1, -1])
            centres.append(centre)
            held.append(np.bincount(cols, minlength=width) > 0)
            if parent is not None:
                self.nodes[parent][3 + side] = number
            if last - first > leaf:
                # two far documents; the halves are those nearer to the one or to the other
                a = self._dense(at, starts, sizes, int(apart.argmax()), local, share, width)
                far = own - 2 * np.add.reduceat(vals * a[cols], starts)
                b = self._dense(at, starts, sizes, int(far.argmax()), local, share, width)
                lean = np.add.reduceat(vals * (a - b)[cols], starts)
                half = (last - first) // 2
                order[first:last] = order[first:last][np.argsort(-lean, kind="stable")]
                todo += [(first, first + half, number, 0), (first + half, last, number, 1)]
        self.order = order
        self.at = [np.concatenate([np.arange(ends[d], ends[d + 1]) for d in order[f:l]]) if lo < 0 else None for f, l, _, lo, _ in self.nodes]
        self.starts = [
            np.concatenate([[0], np.cumsum(np.diff(ends)[order[f:l]])[:-1]]) if lo < 0 else None for f, l, _, lo, _ in self.nodes
        ]
        self.local, self.scores = local, scores
        self.centres, self.held = np.array(centres), np.array(held, np.float64)
        self.root = np.sqrt(weight[self.columns].astype(np.float64))

    @staticmethod
    def _dense(at, starts, sizes, i, local, share, width):
        own = at[starts[i] : starts[i] + sizes[i]]
        out = np.zeros(width)
        out[local[own]] = share[own]
        return out

    def bounds(self, items: np.ndarray) -> np.ndarray:
        """Upper bound of the score in each node for each item (rows of 0 and 1 over the block's terms)."""
        q = items * self.root
        radius = np.array([n[2] for n in self.nodes])[:, None]
        return (self.centres @ q.T + radius * np.sqrt(self.held @ (q * q).T)) * (1 + 1e-9) + 1

    def leaf(self, node: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of a leaf's documents; ``wanted`` is 1 at the item's terms."""
        at = self.at[node]
        return self.order[self.nodes[node][0] : self.nodes[node][1]], np.add.reduceat(self.scores[at] * wanted[self.local[at]], self.starts[node])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, list ends, terms and scores of ``size`` documents at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield _columns(held)
                held, n = [], 0
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(parts)
    lists, scores = table.column("terms").combine_chunks(), table.column("score").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return table.column("doc_id").to_pylist(), ends, lists.flatten().to_numpy(), scores.flatten().to_numpy()


def _search(
    items: list[list[int]], weight: np.ndarray, k: int, thresholds: dict[int, int] | None, block: int, leaf: int, seen: Callable | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best ``k`` documents an item of all blocks of a task; without thresholds only the most promising leaf of each block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, no id, id), sorted
        for ids, ends, terms, scores in _blocks(batches, block):
            tree = BallTree(ends, terms, scores, weight, leaf)
            place = {c: i for i, c in enumerate(tree.columns.tolist())}
            known = [[place[t] for t in item if t in place] for item in items]
            asked = [i for i, cols in enumerate(known) if cols]
            for start in range(0, len(asked), 64):
                group = asked[start : start + 64]
                wanted = np.zeros((len(group), len(place)), np.int64)
                for r, i in enumerate(group):
                    wanted[r, known[i]] = 1
                bounds = tree.bounds(wanted.astype(np.float64)).T
                for r, i in enumerate(group):
                    best[i] = _descend(tree, bounds[r], wanted[r], ids, best[i], k, thresholds.get(i, 1) if thresholds is not None else None, seen)
        rows = [(i, -s, None if none else d) for i, found in enumerate(best) for s, none, d in found]
        yield pa.record_batch({
            "item": pa.array([r[0] for r in rows], pa.int32()), "score": pa.array([r[1] for r in rows], pa.int64()),
            "doc_id": pa.array([r[2] for r in rows], pa.int64()),
        })

    return search


def _descend(tree, bound, wanted, ids, best, k, threshold, seen):
    """Subtrees by falling bound, until none can reach the threshold or the k-th best so far."""
    once = threshold is None
    heap = [(-bound[0], 0)]
    while heap:
        up, node = heapq.heappop(heap)
        floor = max(threshold or 1, -best[k - 1][0] if len(best) >= k else 1)
        if -up < floor:
            break
        _, _, _, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                if bound[child] >= floor:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        places, scores = tree.leaf(node, wanted)
        if seen is not None:
            seen(len(places))
        hits = np.nonzero(scores >= floor)[0]
        if len(hits):
            found = [(-int(scores[h]), ids[places[h]] is None, ids[places[h]] or 0) for h in hits]
            best = heapq.nsmallest(k, best + found)
        if once:
            break
    return best


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, leaf: int = LEAF, group: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents with a score above 0 for each item."""
    spark = docs.sparkSession
    listed = shared(items.select("item_id", "text").distinct().withColumn("part", F.monotonically_increasing_id()))
    out, after = None, -1
    while True:
        # the next items by number; a row each, ``group`` at most
        rows = listed.where(F.col("part") > after).orderBy("part").limit(group).collect()
        if not rows:
            break
        after = rows[-1]["part"]
        found = _ranked_group(docs, [_item_terms(r["text"]) for r in rows], k, block, leaf)
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {listed.schema['item_id'].dataType.simpleString()}")
            found = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            out = found if out is None else out.union(found)
        if len(rows) < group:
            break
    if out is None:
        out = spark.createDataFrame([], f"item_id {listed.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


def _ranked_group(docs: DataFrame, items: list[list[bytes]], k: int, block: int, leaf: int) -> DataFrame | None:
    terms = sorted({t for item in items for t in item})
    numbers = {t: i for i, t in enumerate(terms)}
    if not terms:
        return None
    table = shared(counted(docs, numbers))
    total = table.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")).first()
    if not total["documents"]:
        return None
    df = np.zeros(len(terms), np.int64)
    for term, n in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the items' terms
        df[term] = n
    weight = weights(df, total["documents"])
    order = ["t0", "t1", "t2", F.xxhash64("doc_id")]
    placed = weighed(table, weight, total["documents"], total["occurrences"]).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = shared(placed.select("doc_id", "terms", "score"))
    numbered = [[numbers[t] for t in item] for item in items]
    schema = "item int, score long, doc_id long"
    first = _top(placed.mapInArrow(_search(numbered, weight, k, None, block, leaf), schema), k)
    reached = first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).collect()
    thresholds = {r["item"]: r["score"] for r in reached}
    return _top(shared(placed.mapInArrow(_search(numbered, weight, k, thresholds, block, leaf), schema)), k)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents) GROUP BY doc_id, term
), d AS (SELECT doc_id, sum(tf) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS documents, sum(n) AS occurrences FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM t, total GROUP BY term, documents
), s AS (
  SELECT q.item_id, t.doc_id,
    CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (10 + CAST(90 * d.n * documents AS BIGINT) // CAST(occurrences AS BIGINT))))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN d ON d.doc_id = t.doc_id, total GROUP BY q.item_id, t.doc_id
), r AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
