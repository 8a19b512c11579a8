"""Readers and writers of store tables and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.schema import table_names, table_schema
from urbanframe.sources.catalogue import save_layer  # noqa: F401  (part of this module's interface)


def read_city_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Store tables as Parquet folders under one path, with their fixed schemas."""
    return {n: spark.read.schema(table_schema(n)).parquet(f"{path}/{n}") for n in names or table_names()}


def write_city_tables(store: dict[str, DataFrame], path: str) -> None:
    for n, df in store.items():
        df.write.mode("overwrite").parquet(f"{path}/{n}")


def read_city_tables_jdbc(
    spark: SparkSession, url: str, names: list[str], partitions: int = 64, bounds: dict[str, tuple[int, int]] | None = None,
    options: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Store tables over JDBC, split by id range where bounds are given (geometry columns as text or bytes)."""
    out = {}
    for n in names:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", n).options(**(options or {}))
        if bounds and n in bounds:
            lo, hi = bounds[n]
            reader = reader.option("partitionColumn", "id").option("lowerBound", lo).option("upperBound", hi).option("numPartitions", partitions)
        out[n] = reader.load()
    return out


def define_view(df: DataFrame, name: str) -> DataFrame:
    """A layer that is computed when read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def layer_row_counts(layers: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in layers.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("layer"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def layer_extent(df: DataFrame, box: str = "bbox") -> DataFrame:
    return df.agg(G.extent_agg(F.col(box)).alias("e")).select("e.xmin", "e.ymin", "e.xmax", "e.ymax")


def upgrade_tables(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Older layouts to the current one: null data types, numeric flags, JSON text, null log dates."""
    out = dict(store)
    if "property" in out:
        out["property"] = out["property"].withColumn("datatype_id", F.coalesce("datatype_id", F.lit(1)).cast("int"))
    # Flag columns that were numeric (fixed list).
    flags = {
        "objectclass": ("is_abstract", "is_toplevel"), "datatype": ("is_abstract",), "appearance": ("is_global",),
        "surface_data": ("is_front", "x3d_is_smooth"),
    }
    for t, cols in flags.items():
        if t in out:
            out[t] = out[t].withColumns({c: F.col(c).cast("int") for c in cols if c in out[t].columns})
    # JSON columns (fixed list) are kept as compact text.
    texts = {"address": ("free_text",), "geometry_data": ("geometry_properties",), "property": ("val_array",)}
    for t, cols in texts.items():
        if t in out:
            out[t] = out[t].withColumns({c: F.to_json(F.parse_json(c)) for c in cols if c in out[t].columns})
    if "feature_changelog" in out:
        first = F.lit("0001-01-01 00:00:00").cast("timestamp")
        out["feature_changelog"] = out["feature_changelog"].withColumn("transaction_date", F.coalesce("transaction_date", first))
    return out
