"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stop.

Vectors are projected on a few random Gaussian directions. The projected squared
distance of two vectors over their true one follows a chi-square law, so once the
next projected distance exceeds a quantile of that law times the k-th best true
distance, every neighbour still unseen would have to be an outlier of it: the
search stops. Projected neighbours come leaf by leaf from kd-trees and are
verified on the original vectors.

The outer levels of the tree (cells) are fitted on a bounded sample, but every
vector is indexed. A query first searches its own cell, which bounds its k-th
distance; the same chi-square test then tells which other cells it must visit.
A cell is a number of blocks of bounded size, and queries go in bounded chunks.

A vector takes part if its components are all finite, not all zero, and as many
as most such vectors have (of equally common sizes, the larger); null ids take no part, and a row that repeats an id
and its vector counts once. Equal vectors are searched once; of more copies than
could be returned only the smallest ids are candidates, which loses nothing.
Ties go to the smaller id; with fewer candidates than k all are returned. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.llm.common import shared

#: Random directions, and the share of the chi-square law at which a search stops.
DIRECTIONS, SURE = 8, 0.98
#: Vectors the cells are fitted on, and the least of them in a cell.
SAMPLE, CELL_SAMPLE = 20_000, 64
#: Vectors of a cell (as far as the sample allows more cells), of a block, and queries of a chunk.
CELL_ROWS, BLOCK_ROWS, CHUNK = 8192, 8192, 8192
LEAF, LEAVES_AT_ONCE = 64, 4


def chi_square_quantile(share: float, freedom: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def usable(vector: Column, size: Column | int) -> Column:
    """Whether a vector takes part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


class Cells:
    """The outer kd-tree over projected vectors: ``of`` gives cells, ``within`` all cells near a point."""

    def __init__(self, projected: np.ndarray, depth: int):
        self.depth, self.splits = depth, {}
        dims = projected.shape[1] if len(projected) else DIRECTIONS
        self.low, self.high = np.full((1 << depth, dims), -np.inf), np.full((1 << depth, dims), np.inf)
        self._split(projected, 0, 0)

    def _split(self, points: np.ndarray, level: int, node: int) -> None:
        if level == self.depth:
            return
        dim = int(np.argmax(points.max(0) - points.min(0))) if len(points) else 0
        at = float(np.median(points[:, dim])) if len(points) else 0.0
        self.splits[level, node] = (dim, at)
        below = self.depth - level - 1
        left, right = slice(2 * node << below, (2 * node + 1) << below), slice((2 * node + 1) << below, (2 * node + 2) << below)
        self.high[left, dim] = np.minimum(self.high[left, dim], at)
        self.low[right, dim] = np.maximum(self.low[right, dim], at)
        goes = points[:, dim] > at
        self._split(points[~goes], level + 1, 2 * node)
        self._split(points[goes], level + 1, 2 * node + 1)

    def of(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        for level in range(self.depth):
            dim = np.array([self.splits[level, i][0] for i in range(1 << level)])
            at = np.array([self.splits[level, i][1] for i in range(1 << level)])
            node = 2 * node + (projected[np.arange(len(node)), dim[node]] > at[node])
        return node

    def within(self, point: np.ndarray, square: float) -> np.ndarray:
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return np.flatnonzero((gap * gap).sum(1) <= square)


class Tree:
    """A kd-tree with leaves of LEAF vectors; ``search`` verifies projected neighbours in order of their leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        order = np.arange(len(ids))
        parts = [order]
        while parts and max(map(len, parts)) > LEAF:
            more = []
            for rows in parts:
                if len(rows) <= LEAF:
                    more.append(rows)
                    continue
                own = projected[rows]
                dim = int(np.argmax(own.max(0) - own.min(0)))
                half = len(rows) // 2
                rows = rows[np.argpartition(own[:, dim], half)]
                more += [rows[:half], rows[half:]]
            parts = more
        self.leaves = parts
        self.low = np.array([projected[r].min(0) for r in parts])
        self.high = np.array([projected[r].max(0) for r in parts])
        self.ids, self.vectors, self.projected = ids, vectors, projected

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, bound: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(squared distances, ids) of the best ``k`` found; ``bound``: a squared distance that k others are known to keep."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        gap = (gap * gap).sum(1)
        order = np.argsort(gap, kind="stable")
        best, ids = np.zeros(0), np.zeros(0, np.int64)
        for i in range(0, len(order), LEAVES_AT_ONCE):
            limit = min(bound, best[k - 1]) if len(best) >= k else bound
            if gap[order[i]] > stop * limit:
                break
            rows = np.concatenate([self.leaves[j] for j in order[i : i + LEAVES_AT_ONCE]])
            move = self.projected[rows] - point
            rows = rows[(move * move).sum(1) <= stop * limit]
            away = self.vectors[rows] - vector
            best, ids = np.concatenate((best, (away * away).sum(1))), np.concatenate((ids, self.ids[rows]))
            if len(best) > k:
                own = np.lexsort((ids, best))[:k]
                best, ids = best[own], ids[own]
        own = np.lexsort((ids, best))[:k]
        return best[own], ids[own]


def _matrix(batch: pa.RecordBatch | pa.Table, column: str, size: int) -> np.ndarray:
    x = batch.column(column)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(
    rows: DataFrame, k: int = 10, every: int = 100, directions: int = DIRECTIONS, sure: float = SURE, cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS, chunk: int = CHUNK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row of (vec_id, embedding) whose id is divisible by ``every``."""
    known = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = known.schema["embedding"].dataType.simpleString()  # vectors travel as they came, distances are in doubles
    sizes = known.where(usable(F.col("embedding"), F.size("embedding"))).groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = int(sizes.agg(F.coalesce(F.max(F.struct("n", "size"))["size"], F.lit(0))).first()[0])
    known = shared(known.where(usable(F.col("embedding"), size)).distinct())
    same = Window.partitionBy("embedding").orderBy("vec_id")
    points = shared(known.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"))
    queries = shared(known.where(F.col("vec_id") % every == 0))
    asked = shared(queries.groupBy("embedding").agg(F.min("vec_id").alias("query")))
    n, n_asked = points.count(), asked.count()

    sample = points.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toArrow()
    rng = np.random.default_rng(17)
    plane = rng.normal(size=(size, directions))
    depth = max(0, min(math.ceil(math.log2(max(1, n / cell_rows))), int(math.log2(max(1, sample.num_rows / CELL_SAMPLE)))))
    tree = Cells((_matrix(sample, "embedding", size) @ plane) if sample.num_rows else np.zeros((0, directions)), depth)
    context = rows.sparkSession.sparkContext
    shape = context.broadcast((plane, tree))  # at most SAMPLE / CELL_SAMPLE cells
    stop = chi_square_quantile(sure, directions)
    chunks = max(1, math.ceil(n_asked / chunk))

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane, tree = shape.value
        for batch in batches:
            yield batch.append_column("cell", pa.array(tree.of(_matrix(batch, "embedding", size) @ plane)))

    placed = shared(points.mapInArrow(cells_of, f"vec_id long, embedding {kind}, cell long"))
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    counts = shared(counts)
    turn = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    stored = placed.join(F.broadcast(counts), "cell").withColumn("block", turn("vec_id", F.col("blocks")))  # a row for each cell
    stored = stored.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).drop("blocks")

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        plane, _ = shape.value
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            vectors, asked = _matrix(left, "embedding", size), _matrix(right, "embedding", size)
            tree = Tree(left["vec_id"].to_numpy(), vectors, vectors @ plane)
            bounds = right["bound"].to_numpy()
            for query, vector, bound in zip(right["query"].to_numpy(), asked, bounds, strict=True):
                square, ids = tree.search(vector, vector @ plane, k + 1, bound, stop)
                out[0].append(np.full(len(ids), query))
                out[1].append(ids)
                out[2].append(np.sqrt(square))
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        by = ["cell", "block", "chunk"]
        return stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query long, vec_id long, score double")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane, tree = shape.value
        for batch in batches:
            cell = tree.of(_matrix(batch, "embedding", size) @ plane)
            yield batch.append_column("cell", pa.array(cell)).append_column("bound", pa.array(np.full(len(cell), np.inf)))

    schema = f"embedding {kind}, query long, cell long, bound double"
    home = asked.mapInArrow(at_home, schema).join(F.broadcast(counts), "cell")
    home = home.withColumn("block", turn("query", F.col("blocks"))).withColumn("chunk", turn("query", F.lit(chunks))).drop("blocks")
    first = shared(searched(home))
    reached = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("far"))
    reached = reached.select("query", F.when(F.col("n") > k, F.col("far") * F.col("far")).alias("bound"))
    bounded = asked.join(reached, "query", "left").select("embedding", "query", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane, tree = shape.value
        for batch in batches:
            bounds = batch.column("bound").to_numpy()
            cells = [tree.within(p, stop * b) for p, b in zip(_matrix(batch, "embedding", size) @ plane, bounds, strict=True)]
            at = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            if len(at):
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [own.column("embedding"), own.column("query"), pa.array(np.concatenate(cells)), own.column("bound")],
                    names=["embedding", "query", "cell", "bound"],
                )

    visits = bounded.mapInArrow(elsewhere, schema).join(F.broadcast(counts), "cell")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("chunk", turn("query", F.lit(chunks)))
    visits = visits.drop("blocks").join(home.select("query", "cell", "block"), ["query", "cell", "block"], "left_anti")
    found = first.union(searched(visits))
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = shared(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth"))

    # every query gets the list of its vector, without itself
    ids = queries.join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "query")
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # k + 1 at most
    own = ids.join(lists, "query").select(
        "query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit")
    )
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
