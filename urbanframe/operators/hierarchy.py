"""Transitive relations: class tree, nested properties, contained features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.session import any_size, cut_lineage

CONTAINS = 1  # relation type of containment


def class_closure(objectclass: DataFrame, root: int, skip_abstract: bool = False) -> DataFrame:
    """All transitive subclasses of a class, without the class itself."""
    spark = objectclass.sparkSession
    extra = "AND is_abstract <> 1" if skip_abstract else ""
    return spark.sql(
        f"""
        WITH RECURSIVE tree(id, is_abstract) AS (
          SELECT id, is_abstract FROM {{classes}} WHERE id = {int(root)}
          UNION ALL
          SELECT c.id, c.is_abstract FROM {{classes}} c JOIN tree t ON c.superclass_id = t.id
        )
        SELECT id FROM tree WHERE id <> {int(root)} {extra}
        """,
        classes=objectclass.select("id", "superclass_id", "is_abstract"),
    )


def descend(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All ids reachable from the roots (roots included) over edges (parent, child).

    Each round follows the newest ids only and drops those seen before, so
    cycles end. Rounds are written out, which keeps plans short and survives
    lost executors.
    """
    seen = cut_lineage(roots.select("id").where("id is not null").distinct())
    frontier = seen
    while True:
        step = (
            edges.join(any_size(frontier.select(F.col("id").alias("parent"))), "parent")
            .select(F.col("child").alias("id")).where("id is not null").distinct()
            .join(any_size(seen), "id", "left_anti")
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def property_subtree(prop: DataFrame, ids: DataFrame) -> DataFrame:
    """Property ids nested below the given ids, the ids included."""
    edges = prop.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    known = ids.select("id").join(any_size(prop.select("id")), "id", "left_semi")
    return descend(edges, known)


def containment(prop: DataFrame) -> DataFrame:
    return prop.where((F.col("val_relation_type") == CONTAINS) & F.col("val_feature_id").isNotNull()).select(
        F.col("feature_id").alias("parent"), F.col("val_feature_id").alias("child")
    )


def feature_subtree(prop: DataFrame, roots: DataFrame) -> DataFrame:
    """Features contained in the roots at any depth, the roots included."""
    return descend(containment(prop), roots)
