"""Exact duplicates through an extendible-hash index on shared files.

1. The index: every document's hash, length and digest go to a table in the
   shared folder; a hash is one slot of the index, copies chain behind it.
2. The directory: slots are counted by their next leading bits; a bucket with
   more slots than ``capacity`` doubles its part of the directory until it is
   small enough. Slots are stored by bucket. The result does not use the
   buckets: what follows is dealt by the hash itself.
3. Collisions: only slots with a chain of two or more documents are read again;
   their texts are compared byte by byte (the text itself is the grouping key,
   combined before the shuffle, so a hot text travels once for each task).
4. Every document looks up its group; a hot group is split by Spark's skew join.

Texts are equal when identical after lower-casing A-Z. Null counts as empty, and
empty texts equal each other. Of equal texts the largest ``doc_id`` stays;
repeated rows with that id all stay. Rows without ``doc_id`` never win against
an id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import ascii_lower, shared, without_rows

#: Slots of a bucket before it splits, and directory bits that are added at a time.
CAPACITY, BITS = 4096, 12


def entries(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, norm, h for every document; fewer ``hash_bits`` force collisions (for tests)."""
    norm = docs.select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    return norm.withColumn("h", F.shiftrightunsigned(F.xxhash64("norm"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("norm"))


def directory(slots: DataFrame, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """The slots (h, ...) with their bucket: ``depth`` leading bits of the hash, and those bits as ``prefix``.

    Every round counts the unsettled slots by ``bits`` further bits, rolls the
    counts up to all shorter prefixes and settles the shallowest that fit.
    """
    done, rest, base = None, slots, 0
    while True:
        step = min(bits, 64 - base)
        at = lambda depth: F.shiftrightunsigned("h", 64 - depth)
        fine = rest.groupBy(at(base + step).alias("fine")).agg(F.count(F.lit(1)).alias("n"))
        # at most 2^bits rows for each bucket that was overfull before
        steps = fine.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(step))))
        steps = steps.withColumn("prefix", F.expr(f"shiftrightunsigned(fine, {step} - step)"))
        sizes = steps.groupBy("step", "prefix").agg(F.sum("n").alias("n"), F.collect_list("fine").alias("fines"))
        fits = sizes.where((F.col("n") <= capacity) | (F.col("step") + base == 64))
        leaf = fits.select(F.explode("fines").alias("fine"), F.struct("step", "prefix").alias("leaf"))
        leaf = shared(leaf.groupBy("fine").agg(F.min("leaf").alias("leaf")))
        seen = rest.withColumn("fine", at(base + step)).join(leaf, "fine", "left")
        seen = shared(seen)
        found = seen.where("leaf is not null").select(
            *slots.columns, (F.col("leaf.step") + base).alias("depth"), F.col("leaf.prefix").alias("prefix")
        )
        done = found if done is None else done.unionByName(found)
        rest = seen.where("leaf is null").select(*slots.columns)
        base += step
        if base == 64 or rest.isEmpty():
            return done


def groups_of(docs: DataFrame, capacity: int = CAPACITY, bits: int = BITS, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    listed = entries(docs, hash_bits)
    index = shared(listed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")))
    slots = index.groupBy("h").agg(F.count(F.lit(1)).alias("chain"))
    slots = directory(shared(slots), capacity, bits)
    slots = shared(slots.repartitionByRange("prefix", "h").sortWithinPartitions("prefix", "h"))
    chained = shared(slots.where("chain > 1").select("h"))  # small enough for Spark to broadcast, or else shuffled
    same = listed.join(chained, "h").groupBy("h", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    same = same.groupBy("h", F.sha2("norm", 256).alias("text_sha256")).agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share both digests"))).alias("clash"),
    )
    groups = shared(same)
    return index.join(groups, ["h", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they came.

    Rows are told apart by id and normalised text: another text under the id of a
    row that goes stays, and so does a row without id whose text no row with an id has.
    """
    gone = groups_of(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"))
    return without_rows(docs, shared(gone.distinct()), F.sha2(ascii_lower(F.col("text")), 256))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
