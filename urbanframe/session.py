"""Session helpers: lineage cuts and small size checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set in local mode, one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame once as a table in the shared folder and go on from there.

    Later steps then read only the columns they need, know the size of the
    table, and never repeat the work above it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows a task should have at least before a frame is dealt to more tasks, and tasks a core.
SPREAD_ROWS, SPREAD_TASKS = 2500, 3


def spread(df: DataFrame) -> DataFrame:
    """The frame dealt evenly to the cores, where its files would be read by fewer tasks than there are.

    Rows of city tables are short and costly: a file of some megabytes, which Spark
    reads in one task, can hold a million of them. For frames that are cheap to count,
    as read from Parquet files.
    """
    most = SPREAD_TASKS * df.sparkSession.sparkContext.defaultParallelism
    tasks = df.rdd.getNumPartitions()
    if tasks >= most:
        return df
    tasks_wanted = min(most, df.count() // SPREAD_ROWS)
    return df.repartition(tasks_wanted) if tasks_wanted > tasks else df


def any_size(df: DataFrame) -> DataFrame:
    """The frame as a join side that is never broadcast.

    For id sets and references that grow with the input: Spark estimates a few columns
    of a wide compressed table at a small part of its files, far below its rows.
    """
    return df.hint("merge")


def side_by_side(*jobs: Callable) -> list:
    """Results of independent Spark jobs, submitted together so that none waits for another's last tasks."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]
