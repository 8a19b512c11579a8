"""Helpers the operators share: tables in the shared folder, components, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a task; a longer text is a block by itself.
BLOCK_CHARS = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set (tests), one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        )
    return sc.getCheckpointDir()


def shared(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write the frame as a table in the shared folder and read it from there.

    Work above it is never repeated, and a lost executor costs nothing of it. With
    ``tidy`` the shuffle files of the write go when it is done; use it where nothing
    reads them again and they are large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(_CLEANUP)
        elif tidy:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)  # then lower() touches nothing else
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def without_rows(docs: DataFrame, gone: DataFrame, digest: Column) -> DataFrame:
    """The documents without the rows of ``gone`` (_id, _text): an id, which may be missing, and the digest of a text.

    Rows are told apart by both, so another text under a repeated id stays.
    """
    names, known = docs.columns, F.col("doc_id").cast("long")
    marked = docs.withColumns({"_own_text": digest, "_own_id": F.coalesce(known, F.lit(0)), "_own_none": known.isNull()})
    gone_id = F.col("_id").cast("long")
    keys = gone.select(F.coalesce(gone_id, F.lit(0)).alias("_own_id"), gone_id.isNull().alias("_own_none"), F.col("_text").alias("_own_text"))
    return marked.join(keys, ["_own_id", "_own_none", "_own_text"], "left_anti").select(*names)


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BLOCK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters each, and their texts (null: empty)."""
    for batch in batches:
        texts = [x or "" for x in batch.column(column).to_pylist()]
        start, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= chars:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, component), component = smallest node.

    Each round hooks every node to the neighbour of lowest random rank and
    contracts the graph, which shrinks it by a constant factor whatever its
    shape. A node's edges are never gathered; only minima travel.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = shared(ends.where("a < b").distinct())
    labels, turn = None, 0
    while not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("n"))  # noqa: E731, B023
        hooked = both.groupBy("a").agg(F.min(rank("b")).alias("low")).select(
            F.col("a").alias("node"), F.least("low", rank("a"))["n"].alias("up")
        )
        hooked = shared(hooked)
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hooked = shared(hooked.join(above, "up").select("node", F.col("top").alias("up")))
        if labels is None:
            labels = hooked.select("node", F.col("up").alias("root"))
        else:
            moved = labels.join(hooked.withColumnRenamed("node", "root"), "root", "left")
            labels = shared(moved.select(labels["node"], F.coalesce("up", "root").alias("root")))
        to = lambda c: hooked.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: E731, B023
        moved = rest.join(to("a"), "a").join(to("b"), "b")
        moved = moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        rest = shared(moved.where("a < b").distinct())
        turn += 1
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    lowest = shared(labels.groupBy("root").agg(F.min("node").alias("component")))
    return labels.join(lowest, "root").select("node", "component")
