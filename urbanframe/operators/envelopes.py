"""3D envelopes of geometries, templates and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.operators.hierarchy import containment, descend
from urbanframe.schema import BBOX_DDL
from urbanframe.session import cut_lineage

IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
MATRIX_SIZE = 12


def geometry_envelope(geom) -> Column:
    """Five-point envelope with the lowest z on two corners and the highest on two."""
    g = F.col(geom) if isinstance(geom, str) else geom
    return G.slanted_envelope(G.st_bbox(g), g["srid"])


def parse_matrix(text: Column) -> Column:
    """Matrix values of a JSON array; fails on other JSON or fewer than twelve values."""
    values = F.from_json(text, "array<double>")
    fine = F.assert_true(F.size(values) >= MATRIX_SIZE, F.concat(F.lit("Invalid transformation matrix: "), text))
    identity = F.array(*[F.lit(float(v)) for v in IDENTITY])
    return F.when(text.isNull(), identity).when(fine.isNull(), values)


def implicit_envelopes(prop: DataFrame, implicit_geometry: DataFrame, geometry_data: DataFrame) -> DataFrame:
    """Envelope per template use: (property_id, feature_id, envelope).

    The template box goes through the matrix, shifted by the reference point.
    Without a template geometry the reference point alone counts.
    """
    uses = prop.where(F.col("val_implicitgeom_id").isNotNull()).select(
        F.col("id").alias("property_id"), "feature_id", "val_implicitgeom_id",
        F.col("val_implicitgeom_refpoint").alias("_ref"), parse_matrix(F.col("val_array")).alias("_m"),
    )
    shapes = implicit_geometry.select(F.col("id").alias("val_implicitgeom_id"), F.col("relative_geometry_id").alias("_gid")).join(
        geometry_data.where(F.col("implicit_geometry").isNotNull()).select(
            F.col("id").alias("_gid"), geometry_envelope("implicit_geometry").alias("_box")
        ),
        "_gid",
    )
    m = [F.col("_m")[i] for i in range(MATRIX_SIZE)]
    at = F.col("_ref")
    shift = [m[i] + F.when(at.isNotNull(), fn("_ref")).otherwise(0.0) for i, fn in ((3, G.st_x), (7, G.st_y), (11, G.st_z))]
    moved = G.st_affine("_box", [m[0], m[1], m[2], m[4], m[5], m[6], m[8], m[9], m[10], *shift])
    dot = geometry_envelope(G.st_point(*shift, srid=F.col("_ref.srid")))
    return uses.join(shapes, "val_implicitgeom_id", "left").select(
        "property_id", "feature_id", F.when(F.col("_box").isNotNull(), moved).when(at.isNotNull(), dot).alias("envelope")
    )


def _wider(a: str, b: str) -> Column:
    """Union of two boxes, either of which may be null."""
    ends = [F.least(F.col(f"{a}.{c}min"), F.col(f"{b}.{c}min")).alias(f"{c}min") for c in "xyz"]
    ends += [F.greatest(F.col(f"{a}.{c}max"), F.col(f"{b}.{c}max")).alias(f"{c}max") for c in "xyz"]
    both = F.struct(*ends).cast(BBOX_DDL)
    return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), both)


def boxes_upwards(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, box) of every node: the union of its own box and those of all nodes below it.

    ``boxes`` has (id, box), ``edges`` (id, child), both written tables. In a round
    every node sends its box to its parents, and to one shortcut further up: a node
    with a single parent points at an ancestor, twice as far away each round, so
    a chain of ten thousand takes some fifteen rounds. There is one row for each
    node; a union of boxes may repeat, so cycles and several ways up do no harm, and
    it ends when no box grows.
    """
    nodes = edges.select("id").union(edges.select(F.col("child").alias("id"))).distinct()
    single = edges.groupBy(F.col("child").alias("id")).agg(F.min("id").alias("up"), F.count(F.lit(1)).alias("_n"))
    state = nodes.join(boxes, "id", "left").join(single.where("_n = 1").drop("_n"), "id", "left")
    state = cut_lineage(state.select("id", "box", "up"))
    while True:
        sent = edges.join(state.where("box IS NOT NULL").select(F.col("id").alias("child"), "box"), "child").select("id", "box")
        sent = sent.union(state.where("box IS NOT NULL AND up IS NOT NULL").select(F.col("up").alias("id"), "box"))
        grown = sent.groupBy("id").agg(G.extent_agg(F.col("box")).alias("_more"))
        further = state.where("up IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("_up"))
        rows = state.join(grown, "id", "left").join(further, "up", "left")
        rows = rows.withColumn("_box", _wider("box", "_more"))
        state = cut_lineage(rows.select(
            "id", F.col("_box").alias("box"), F.coalesce("_up", "up").alias("up"), (~F.col("_box").eqNullSafe(F.col("box"))).alias("_grew")
        ))
        if state.where("_grew").isEmpty():
            break
        state = state.drop("_grew")
    inner = state.select("id", "box")
    return inner.union(boxes.select("id", "box").join(nodes, "id", "left_anti"))


def feature_envelopes(
    store: dict[str, DataFrame], ids: DataFrame | None = None, compute: bool = False, srid: int = 3879
) -> DataFrame:
    """Envelope per feature: (id, envelope).

    A stored envelope answers for its feature unless ``compute`` is set.
    Otherwise own geometries, template uses and contained features add up; boxes
    travel upwards. With ``ids`` only what those contain is looked at.
    """
    feature, prop = store["feature"], store["property"]
    stored = feature.select("id", G.st_bbox("envelope").alias("_stored"))
    if compute:
        stored = stored.withColumn("_stored", F.lit(None).cast(stored.schema["_stored"].dataType))
    own = store["geometry_data"].where(F.col("geometry").isNotNull() & F.col("feature_id").isNotNull()).select(
        F.col("feature_id").alias("id"), G.st_bbox("geometry").alias("_b")
    )
    used = implicit_envelopes(prop, store["implicit_geometry"], store["geometry_data"])
    used = used.select(F.col("feature_id").alias("id"), G.st_bbox("envelope").alias("_b"))
    direct = own.unionByName(used).where("_b is not null").groupBy("id").agg(G.extent_agg(F.col("_b")).alias("_own"))
    base = stored.join(direct, "id", "left").select("id", F.col("_stored").isNull().alias("open"), F.coalesce("_stored", "_own").alias("box"))
    base = cut_lineage(base)
    edges = containment(prop).select(F.col("parent").alias("id"), "child").distinct()
    edges = cut_lineage(edges.join(base.where("open").select("id"), "id", "left_semi"))
    roots = feature.select("id")
    if ids is not None:
        roots = roots.join(ids.select("id"), "id", "left_semi")
        below = descend(edges.select(F.col("id").alias("parent"), "child"), roots)
        edges = cut_lineage(edges.join(below, "id", "left_semi"))
    total = boxes_upwards(base.select("id", "box"), edges).select("id", F.col("box").alias("_all"))
    kept = feature.select("id", F.col("envelope").alias("_env"))
    out = roots.join(total, "id", "left").join(kept, "id")
    fresh = G.slanted_envelope(F.col("_all"), srid)
    return out.select("id", (fresh if compute else F.coalesce("_env", fresh)).alias("envelope"))


def write_back_envelopes(feature: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Feature table with the computed envelopes; features without a result row keep theirs."""
    new = envelopes.select("id", F.col("envelope").alias("_new"), F.lit(True).alias("_hit"))
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("envelope"))
    return feature.join(new, "id", "left").withColumn("envelope", value).select(*feature.columns)
