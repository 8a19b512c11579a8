"""Dense row numbers, ranks in groups and surrogate keys, without unbounded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.session import any_size, cut_lineage

_SHIFT = 33  # bits below the partition number in monotonically_increasing_id


def dense_id(
    df: DataFrame, order: list[str | Column], name: str = "gid", start: int = 1,
    settled: bool = False,
) -> DataFrame:
    """``row_number() OVER (ORDER BY ...)`` over the whole frame; the order should be unique.

    The input is written once (unless ``settled``: cheap to read again),
    range-partitioned by the order, numbered inside each partition and shifted
    by the rows before it; it is written with its partition numbers, so both
    passes agree even when tasks are repeated.
    """
    columns = df.columns
    df = df if settled else cut_lineage(df)
    marked = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumns({"_pid": F.shiftright("_m", _SHIFT), "_m": F.col("_m").bitwiseAND((1 << _SHIFT) - 1)})
    )
    marked = cut_lineage(marked)
    # one row per partition
    sizes = marked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("_pid", before.alias("_before"))
    return (
        marked.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_before") + F.col("_m") + start).cast("long"))
        .select(name, *columns)
    )


def rank_in_group(
    df: DataFrame, group: str, order: list[Column], name: str = "rank"
) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY ...)`` for groups of any size.

    The frame is sorted globally by group and order, and the rank is the position
    minus the first position of the group, so no group has to fit into a task.
    """
    rows = dense_id(df, [F.col(group), *order], "_pos")
    first = rows.groupBy(group).agg(F.min("_pos").alias("_first"))
    return (
        rows.join(any_size(first), rows[group].eqNullSafe(first[group])).drop(first[group])
        .withColumn(name, F.col("_pos") - F.col("_first") + 1)
        .select(*df.columns, name)
    )


def assign_ids(existing: DataFrame, new_rows: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """Number new rows after the largest key already in use."""
    used = existing.select(F.coalesce(F.max(key), F.lit(0))).scalar()
    rows = dense_id(new_rows, order, "_seq")
    return rows.withColumn(key, (used + F.col("_seq")).cast("long")).select(key, *new_rows.columns)
