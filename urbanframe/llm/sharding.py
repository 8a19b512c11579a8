"""Shards that all match the mixture of sources: proportional stratified interleaving.

1. A thin table (id, source, size, checksum, shuffle key) is written once; texts
   are not shuffled. The shuffle key is the MD5 of seed and id.
2. Rows are sorted by source and shuffle key over range partitions. Position
   minus the first position of the source is the rank inside the source, so a
   source with a third of all rows spreads over tasks like any other.
3. The fractional rank (rank + 1/2) / rows of the source interleaves the
   sources: any run of positions holds each source in proportion.
4. The rows are sorted by fractional rank; position times shards, divided by the
   rows, is the shard. Row counts differ by one at most (law ``rows``), and each
   source's share of a shard is within two rows of its part of the whole.

Positions come from range partitions and one row count per partition. Null texts
have no bytes (size 1, checksum 0); rows without source are a source of their
own; rows without id are shuffled by size and checksum; repeated rows are rows of
their own (equal rows may change places). An empty table gives an empty result;
other columns are ignored. Equal texts are not kept together: this method deals
rows, not groups, and a group may hold more rows than a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.llm.common import shared

_SHIFT = 33  # bits below the partition number in monotonically_increasing_id


def positions(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``name``: place of each row (from 0) in the sorted whole, from range partitions and their row counts.

    ``rows`` must be a written table: reading it again gives the same rows in
    the same order, so equal rows are spread by where they stand.
    """
    rows = rows.withColumn("_spread", F.monotonically_increasing_id())
    order = [*order, "_spread"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_m", _SHIFT), "_in": F.col("_m").bitwiseAND((1 << _SHIFT) - 1)})
    rows = shared(rows.drop("_m", "_spread"))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def interleaved(docs: DataFrame, strata: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, stratum, frac, place: every row with its place (from 0) in the interleaved order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id", F.col(strata).cast("string").alias("stratum"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("key"),
    )
    thin = shared(thin)
    sizes = thin.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"))
    ranked = shared(positions(thin, ["stratum", "key", "doc_id", "size", "text_crc32"], "at"))
    # first position of a source: rows of all sources before it
    firsts = ranked.groupBy("stratum").agg(F.min("at").alias("first"))
    stats = firsts.join(sizes, firsts["stratum"].eqNullSafe(sizes["stratum"])).select(firsts["stratum"].alias("of"), "first", "rows")
    frac = ((F.col("at") - F.col("first")) * 2 + 1) / (F.col("rows") * 2)
    rows = ranked.join(stats, ranked["stratum"].eqNullSafe(F.col("of"))).select(
        "doc_id", "stratum", "size", "text_crc32", "key", frac.alias("frac")
    )
    return positions(shared(rows), ["frac", "stratum", "key", "doc_id", "size", "text_crc32"], "place").drop("key")


def sharded(docs: DataFrame, shards: int = 8, strata: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and stratum of every row."""
    rows = shared(interleaved(docs, strata, seed))
    total = rows.select(F.count(F.lit(1))).scalar()
    rows = rows.withColumn("total", total).withColumn("shard", F.expr(f"place * {shards} div total"))
    # the first place of shard s is the smallest p with p * shards >= s * total
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "stratum",
    )


ORACLE = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), b AS (
  SELECT doc_id, source, md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR))) AS key,
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda x: CAST('0x' || x AS BIGINT))) AS bytes
  FROM documents
), thin AS (
  SELECT doc_id, source, key, CAST(len(bytes) AS BIGINT) AS size,
    xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) AS text_crc32
  FROM b, tab
), ranked AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1 AS DOUBLE) / (2 * count(*) OVER (PARTITION BY source)) AS frac
  FROM thin
), placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, key, doc_id) - 1 AS place, count(*) OVER () AS total FROM ranked
), dealt AS (SELECT *, place * 8 // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM dealt
"""
