"""Material rules, appearance materials and the styled geometry layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions.scalars import hex_byte, number_text, one_or_null
from urbanframe.operators.filters import drop_geometry_type, exclude_classes

# Columns of a material rule file (fixed names, spelling as in the file format).
RULE_COLUMNS = (
    "namespace_of_classname", "classname", "namespace_of_property", "property_name",
    "column_name_of_property_value", "property_value", "emmisive_color",
    "pbr_metallic_roughness_base_color", "pbr_metallic_roughness_metallic_roughness",
    "pbr_specular_glossiness_diffuse_color", "pbr_specular_glossiness_specular_glossiness",
)
FALLBACK_CLASS = "anything_else"
# Fixed defaults of surfaces without a material.
DEFAULT_BASE = "#333333"
DEFAULT_ROUGHNESS = "#000000"
# Fixed codes of the geometry part tree: composite, triangulated and multi surface, solid; shell children are 6.
SURFACE_TYPES = (8, 9, 10, 11)
SHELL_TYPE = 6


def _pbr_json(emissive: Column, base: Column, rough: Column, diffuse: Column, gloss: Column) -> Column:
    """Material JSON: absent members are left out, an empty gloss object too."""
    shine = F.when(
        diffuse.isNotNull() | gloss.isNotNull(),
        F.struct(diffuse.alias("DiffuseColors"), gloss.alias("SpecularGlossiness")),
    )
    return F.to_json(
        F.struct(
            emissive.alias("EmissiveColors"),
            F.struct(base.alias("BaseColors"), rough.alias("MetallicRoughness")).alias("PbrMetallicRoughness"),
            shine.alias("SpecularGlossiness"),
        )
    )


def _rule_json(emissive: Column) -> Column:
    return _pbr_json(emissive, *[one_or_null(F.col(c)) for c in RULE_COLUMNS[7:]])


def material_by_class(rules: DataFrame) -> DataFrame:
    """Rules without a property value: (ns, class, material_data)."""
    return rules.where(F.col("property_value").isNull()).select(
        F.col("namespace_of_classname").alias("ns"), F.col("classname").alias("class"),
        _rule_json(one_or_null(F.col("emmisive_color"))).alias("material_data"),
    )


def material_by_property(rules: DataFrame) -> DataFrame:
    """All rules with their property condition; the emissive colour stays a scalar here."""
    return rules.select(*RULE_COLUMNS[:6], _rule_json(F.col("emmisive_color")).alias("material_data"))


def material_property_match(
    feature: DataFrame, prop: DataFrame, objectclass: DataFrame, namespace: DataFrame, rules: DataFrame
) -> DataFrame:
    """Features whose property value equals a rule's value as text.

    Properties meet the rules first, so only matching rows travel to the features.
    """
    ns = namespace.select(F.col("id").alias("namespace_id"), F.col("alias"))
    m = material_by_property(rules).where(F.col("property_value").isNotNull())
    p = prop.select("feature_id", "namespace_id", "name", "val_string", "val_int", "val_double").join(ns, "namespace_id")
    value = F.col("property_value")
    hit = p.join(
        m,
        (m["namespace_of_property"] == p["alias"])
        & (m["property_name"] == p["name"])
        & ((value == p["val_string"]) | (value == p["val_int"].cast("string")) | (value == number_text(p["val_double"]))),
    )
    oc = objectclass.select(F.col("id").alias("objectclass_id"), F.col("classname").alias("_class"), "namespace_id")
    oc = oc.join(ns.withColumnRenamed("alias", "_ns"), "namespace_id").drop("namespace_id")
    f = feature.select(F.col("id").alias("feature_id"), "objectid", "objectclass_id").join(oc, "objectclass_id")
    return (
        hit.join(f, "feature_id")
        .where((F.col("namespace_of_classname") == F.col("_ns")) & (F.col("classname") == F.col("_class")))
        .select("objectid", "alias", "name", "val_string", "val_int", "val_double", "material_data")
    )


PART_TREE = "struct<type:int,children:array<struct<type:int,objectId:string>>>"


def geometry_surfaces(geometry_data: DataFrame) -> DataFrame:
    """Surface ids of every geometry from its part tree."""
    tree = F.from_json("geometry_properties", PART_TREE)
    parts = geometry_data.select("id", "feature_id", tree.alias("t")).where(F.col("t.type").isin(*SURFACE_TYPES))
    return (
        parts.select("id", "feature_id", F.explode("t.children").alias("c"))
        .where(F.col("c.type") != SHELL_TYPE)
        .select("id", "feature_id", F.col("c.objectId").alias("surface"))
    )


def mapped_surfaces(mapping: DataFrame) -> DataFrame:
    """One row per surface id named in a material mapping."""
    return mapping.select(
        "surface_data_id", "texture_mapping", "world_to_texture_mapping", "georeferenced_texture_mapping",
        F.explode(F.json_object_keys("material_mapping")).alias("surface"),
    )


def surface_materials(geometry_data: DataFrame, mapping: DataFrame, surface_data: DataFrame) -> DataFrame:
    """Surfaces with their material row; textured surfaces are left out."""
    sd = surface_data.select(
        F.col("id").alias("surface_data_id"), "x3d_diffuse_color", "x3d_shininess", "x3d_ambient_intensity",
        "x3d_emissive_color", "x3d_specular_color",
    )
    rows = geometry_surfaces(geometry_data).join(mapped_surfaces(mapping), "surface", "left")
    # most surfaces have no material: only those that do are looked up
    rows = rows.where("surface_data_id is not null").join(sd, "surface_data_id", "left").unionByName(
        rows.where("surface_data_id is null"), allowMissingColumns=True
    )
    return rows.where(
        F.col("texture_mapping").isNull() & F.col("world_to_texture_mapping").isNull()
        & F.col("georeferenced_texture_mapping").isNull()
    )


def roughness_colour() -> Column:
    shine, ambient = F.col("x3d_shininess"), F.col("x3d_ambient_intensity")
    # Two channels, of which one may be missing; channel texts are not padded.
    known = F.col("x3d_diffuse_color").isNotNull() & F.coalesce(shine, ambient).isNotNull()
    red, green = (F.coalesce(hex_byte(c), F.lit("00")) for c in (shine, ambient))
    return F.when(known, F.concat(F.lit("#"), red, green, F.lit("00"))).otherwise(DEFAULT_ROUGHNESS)


def _values(col: Column) -> Column:
    """Sorted non-null values of a group, null when there is none."""
    got = F.array_sort(F.collect_list(col))
    return F.when(F.size(got) > 0, got)


def material_from_appearance(
    feature: DataFrame, geometry_data: DataFrame, mapping: DataFrame, surface_data: DataFrame, rules: DataFrame
) -> DataFrame:
    """Material JSON per feature from its stored appearance."""
    owners = feature.select(F.col("id").alias("feature_id"), "objectid")
    rows = surface_materials(geometry_data, mapping, surface_data).join(owners, "feature_id", "left")
    per = rows.groupBy("objectid").agg(
        _values(F.coalesce("x3d_diffuse_color", F.lit(DEFAULT_BASE))).alias("_base"),
        _values(roughness_colour()).alias("_rough"),
        _values(F.col("x3d_emissive_color")).alias("_emissive"),
        _values(F.col("x3d_specular_color")).alias("_gloss"),
    )
    fallback = rules.where(F.col("classname") == FALLBACK_CLASS).select(
        F.min(F.struct(F.col(RULE_COLUMNS[7]).alias("base"), F.col(RULE_COLUMNS[8]).alias("rough")))
    ).scalar()
    per = per.withColumn("_dflt", fallback).where(F.col("_dflt").isNotNull())
    base = F.coalesce("_base", F.array("_dflt.base"))
    rough = F.coalesce("_rough", F.array("_dflt.rough"))
    none = F.lit(None).cast("array<string>")
    return per.select("objectid", _pbr_json(F.col("_emissive"), base, rough, none, F.col("_gloss")).alias("material_data"))


NO_STYLE, BY_CLASS, BY_PROPERTY, EXISTING = "no-style", "objectclass-based", "property-based", "existing-appearances"
FALL_DOWN, RISE_UP = "fall-down", "rise-up"

# Which sources fill the material, first non-null wins.
_ORDER = {
    (NO_STYLE, FALL_DOWN): ("default",),
    (BY_CLASS, FALL_DOWN): ("class", "default"),
    (BY_PROPERTY, FALL_DOWN): ("property", "class"),
    (EXISTING, FALL_DOWN): ("appearance", "property", "class"),
    (BY_CLASS, RISE_UP): ("class", "property", "appearance"),
    (BY_PROPERTY, RISE_UP): ("property", "appearance"),
}


def geometry_with_class(geometry_data: DataFrame, feature: DataFrame, objectclass: DataFrame, namespace: DataFrame) -> DataFrame:
    """Geometry > feature > class > namespace, all left joins."""
    f = feature.select(F.col("id").alias("feature_id"), "objectid", "objectclass_id")
    oc = objectclass.select(F.col("id").alias("objectclass_id"), F.col("classname").alias("class"), "namespace_id")
    ns = namespace.select(F.col("id").alias("namespace_id"), F.col("alias").alias("ns"))
    return (
        geometry_data.select(F.col("id").alias("geometry_id"), F.col("geometry").alias("geom"), "feature_id")
        .join(f, "feature_id", "left")
        .join(oc, "objectclass_id", "left")
        .join(ns, "namespace_id", "left")
        .select("geometry_id", "geom", F.col("objectid").alias("id"), "class", "ns")
    )


def default_material(rules: DataFrame) -> Column:
    return (
        material_by_class(rules).where(F.col("ns").isNull() & (F.col("class") == FALLBACK_CLASS))
        .select(F.min("material_data")).scalar()
    )


def styled_geometries(
    store: dict[str, DataFrame], rules: DataFrame, mode: str = BY_CLASS, absence: str = FALL_DOWN,
    exclude: list[str] | None = None, only_class: str | None = None,
) -> DataFrame:
    """The layer to tile: geom, id, class, ns, material_data; one row per geometry."""
    if (mode, absence) not in _ORDER:
        raise ValueError(f"style mode {mode!r} cannot be combined with {absence!r}")
    rows = geometry_with_class(store["geometry_data"], store["feature"], store["objectclass"], store["namespace"])
    rows = drop_geometry_type(rows)
    if exclude:
        rows = exclude_classes(rows, exclude)
    if only_class:
        rows = rows.where(F.col("class") == only_class)
    sources = _ORDER[mode, absence]
    for s in sources:
        if s == "default":
            rows = rows.withColumn("_default", default_material(rules))
        elif s == "class":
            m = material_by_class(rules).groupBy("ns", "class").agg(F.min("material_data").alias("_class"))
            rows = rows.join(m, ["ns", "class"], "left")
        else:
            if s == "property":
                m = material_property_match(store["feature"], store["property"], store["objectclass"], store["namespace"], rules)
            else:
                m = material_from_appearance(
                    store["feature"], store["geometry_data"], store["surface_data_mapping"], store["surface_data"], rules
                )
            m = m.groupBy(F.col("objectid").alias("id")).agg(F.min("material_data").alias(f"_{s}"))
            rows = rows.join(m, "id", "left")
    return rows.select("geometry_id", "geom", "id", "class", "ns", F.coalesce(*[F.col(f"_{s}") for s in sources]).alias("material_data"))
