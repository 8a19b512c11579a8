"""Deletes and terminations on the store, as id sets and table rewrites.

An edit first grows the sets of affected ids to a fixpoint, then rewrites every
table once with anti joins. Input tables are never changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.operators.hierarchy import CONTAINS, property_subtree
from urbanframe.schema import data_tables
from urbanframe.session import any_size, cut_lineage

Store = dict[str, DataFrame]


def without(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose column is not among the ids."""
    return df.join(any_size(ids.select(F.col("id").alias(column))), column, "left_anti").select(*df.columns)


def among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(any_size(ids.select(F.col("id").alias(column))), column, "left_semi").select(*df.columns)


def orphans(candidates: DataFrame, referrers: DataFrame, column: str) -> DataFrame:
    """Candidate ids no referrer row points at any more."""
    return without(candidates.select("id").where("id is not null").distinct(), referrers.select(F.col(column).alias("id")))


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("long").alias("id")).where("id is not null").distinct()


def _none_of(store: Store) -> DataFrame:
    return store["feature"].select(F.col("id").cast("long")).where(F.lit(False))


def _nulled(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Set the column to null where it points at a deleted row. Rows without a value stay out of the join."""
    marked = gone.select(F.col("id").alias(column), F.lit(True).alias("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    pointing = df.where(F.col(column).isNotNull()).join(any_size(marked), column, "left").withColumn(column, kept).select(*df.columns)
    return pointing.unionByName(df.where(F.col(column).isNull()))


def apply_deletions(store: Store, gone: dict[str, DataFrame]) -> Store:
    """The store without the given ids; references follow the store's key rules.

    Rows that hang on a deleted geometry, template, appearance, address or
    surface data go with it; parents and owners become null.
    """
    none = _none_of(store)

    def g(table: str) -> DataFrame:
        return gone.get(table, none)

    out = dict(store)
    geometry = cut_lineage(g("geometry_data"))
    templates = cut_lineage(
        g("implicit_geometry").union(_ids(among(store["implicit_geometry"], geometry, "relative_geometry_id"), "id")).distinct()
    )
    appearances = cut_lineage(
        g("appearance").union(_ids(among(store["appearance"], templates, "implicit_geometry_id"), "id")).distinct()
    )
    props = store["property"]
    hanging = none
    for ids, col in (
        (geometry, "val_geometry_id"), (templates, "val_implicitgeom_id"),
        (appearances, "val_appearance_id"), (g("address"), "val_address_id"),
    ):
        hanging = hanging.union(_ids(among(props, ids, col), "id"))
    lost = cut_lineage(g("property").union(hanging).distinct())
    props = _nulled(without(props, lost), "parent_id", lost)
    out["property"] = _nulled(props, "val_feature_id", g("feature"))
    out["feature"] = without(store["feature"], g("feature"))
    out["geometry_data"] = _nulled(without(store["geometry_data"], geometry), "feature_id", g("feature"))
    out["implicit_geometry"] = without(store["implicit_geometry"], templates)
    out["appearance"] = _nulled(without(store["appearance"], appearances), "feature_id", g("feature"))
    out["address"] = without(store["address"], g("address"))
    links = without(store["appear_to_surface_data"], appearances, "appearance_id")
    out["appear_to_surface_data"] = without(links, g("surface_data"), "surface_data_id")
    out["surface_data"] = _nulled(without(store["surface_data"], g("surface_data")), "tex_image_id", g("tex_image"))
    out["tex_image"] = without(store["tex_image"], g("tex_image"))
    mapping = without(store["surface_data_mapping"], geometry, "geometry_data_id")
    out["surface_data_mapping"] = without(mapping, g("surface_data"), "surface_data_id")
    return out


# ---------------------------------------------------------------- id sets
def _merge(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = dict(a)
    for k, v in b.items():
        out[k] = out[k].union(v).distinct() if k in out else v
    return out


def surface_data_deletion(store: Store, ids: DataFrame) -> dict[str, DataFrame]:
    """Surface data and the textures nothing else uses."""
    rows = among(store["surface_data"], ids, "id")
    left = without(store["surface_data"], ids)
    return {"surface_data": _ids(rows, "id"), "tex_image": orphans(_ids(rows, "tex_image_id"), left, "tex_image_id")}


def appearance_deletion(store: Store, ids: DataFrame) -> dict[str, DataFrame]:
    """Appearances and the surface data left without any appearance."""
    links = among(store["appear_to_surface_data"], ids, "appearance_id")
    left = without(store["appear_to_surface_data"], ids, "appearance_id")
    bare = cut_lineage(orphans(_ids(links, "surface_data_id"), left, "surface_data_id"))
    gone = surface_data_deletion(store, bare)
    gone["appearance"] = _ids(among(store["appearance"], ids, "id"), "id")
    return gone


def geometry_deletion(store: Store, ids: DataFrame) -> dict[str, DataFrame]:
    return {"geometry_data": _ids(among(store["geometry_data"], ids, "id"), "id")}


def implicit_geometry_deletion(store: Store, ids: DataFrame) -> dict[str, DataFrame]:
    """Templates with their appearances and template geometry."""
    rows = among(store["implicit_geometry"], ids, "id")
    gone = {"implicit_geometry": _ids(rows, "id"), **geometry_deletion(store, _ids(rows, "relative_geometry_id"))}
    worn = cut_lineage(_ids(among(store["appearance"], ids, "implicit_geometry_id"), "id"))
    return _merge(gone, appearance_deletion(store, worn))


def _values_deletion(store: Store, dropped: DataFrame) -> dict[str, DataFrame]:
    """What deleted property rows owned: geometries, templates, appearances, addresses."""
    left = without(store["property"], dropped.select("id"))
    owned = dropped.where("owns")
    gone = geometry_deletion(store, _ids(owned, "val_geometry_id"))
    free = cut_lineage(orphans(_ids(owned, "val_implicitgeom_id"), left, "val_implicitgeom_id"))
    gone = _merge(gone, implicit_geometry_deletion(store, free))
    gone = _merge(gone, appearance_deletion(store, cut_lineage(_ids(owned, "val_appearance_id"))))
    address = _ids(among(store["address"], _ids(owned, "val_address_id"), "id"), "id")
    return _merge(gone, {"address": address})


_EDGE = (
    "id", "feature_id", "parent_id", "name", "namespace_id", "val_feature_id", "val_relation_type",
    "val_geometry_id", "val_implicitgeom_id", "val_appearance_id", "val_address_id",
)


def _nested(prop: DataFrame, ids: DataFrame) -> DataFrame:
    """The properties among the ids that have a parent."""
    return among(prop.select("id", "parent_id", "name", "namespace_id").where("parent_id is not null"), ids, "id")


def _named_as_parent(prop: DataFrame, nested: DataFrame) -> DataFrame:
    p = prop.select(F.col("id").alias("parent_id"), "name", "namespace_id")
    return nested.join(any_size(p), ["parent_id", "name", "namespace_id"]).select("id", "parent_id")


def same_named_parents(prop: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, parent_id) of properties whose parent has the same name and namespace."""
    return _named_as_parent(prop, _nested(prop, ids))


def _property_closure(prop: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Property ids removed with the given ones, and the ids pulled in by a same-named parent."""
    start = cut_lineage(_ids(ids, "id"))
    cascaded, reached, front = None, start, start
    while True:  # ends with the ids: reached ones are not followed again
        nested = cut_lineage(_nested(prop, front))
        alone = nested.isEmpty()
        # the names of all properties are looked at only if there are parents to look for
        up = nested.select("id", "parent_id") if alone else cut_lineage(_named_as_parent(prop, nested))
        if cascaded is None:
            cascaded = _ids(up, "id")
        if alone:
            break
        front = cut_lineage(without(_ids(up, "parent_id"), reached))
        if front.isEmpty():
            break
        reached = reached.union(front)
    return property_subtree(prop, reached.distinct()), cascaded


def _references(rows: DataFrame, sign: int) -> DataFrame:
    """(id, refs, loose): how many of the rows point at a feature, and how many of those by another than a containment."""
    loose = (F.coalesce("val_relation_type", F.lit(0)) == 0).cast("int")
    counted = rows.where("val_feature_id is not null").groupBy(F.col("val_feature_id").alias("id"))
    return counted.agg((F.count(F.lit(1)) * sign).alias("refs"), (F.sum(loose) * sign).alias("loose"))


def _cascade(store: Store, start: DataFrame, start_props: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Grow deleted features and property rows until nothing is new.

    A contained feature goes if nothing refers to it any more, or if a reference
    other than containment remains. References are kept as a ledger: when a
    feature is first touched, all that points at it; then what each round takes
    away. A round reads the rows of its own features and the ledger of the
    features these point at, nothing else.
    """
    prop = store["property"].select(*_EDGE)
    owned_rule = F.col("val_feature_id").isNull() | (F.col("val_relation_type") == CONTAINS)
    features = front = cut_lineage(_ids(start, "id"))
    dropped, ledger, known = None, None, None
    while True:
        new = among(prop, front, "feature_id").withColumn("owns", owned_rule)
        # rows elsewhere that point at the deleted features
        referring = without(_ids(among(prop, front, "val_feature_id"), "id"), new.select("id"))
        referring = cut_lineage(referring if dropped is None else without(referring, dropped))
        if not referring.isEmpty():
            closure, _ = _property_closure(prop, referring)
            pulled = among(prop, closure, "id").withColumn("owns", owned_rule)
            # a row that pointed at a deleted feature has lost that value by now
            pulled = pulled.join(any_size(referring.withColumn("_ref", F.lit(True))), "id", "left")
            pulled = pulled.withColumn("owns", F.col("owns") | F.coalesce("_ref", F.lit(False))).drop("_ref")
            new = new.unionByName(pulled)
        if dropped is None and start_props is not None:
            new = new.unionByName(among(prop, start_props, "id").withColumn("owns", owned_rule))
        new = cut_lineage(new.groupBy(*_EDGE).agg(F.max("owns").alias("owns")))
        fresh, gained = new, new.where("owns")
        if dropped is not None:
            fresh, gained = without(new, dropped), without(gained, dropped.where("owns"))
        inside = gained.where((F.col("val_relation_type") == CONTAINS) & F.col("val_feature_id").isNotNull())
        inside = inside.select(F.col("val_feature_id").alias("id")).distinct().withColumn("inside", F.lit(True))
        taken = cut_lineage(_references(fresh, -1).join(inside, "id", "full"))
        touched = taken.select("id")
        first = touched if known is None else without(touched, known)
        entries = cut_lineage(_references(among(prop, first, "val_feature_id"), 1).withColumn("inside", F.lit(None).cast("boolean")).unionByName(taken))
        dropped = new if dropped is None else dropped.unionByName(new)
        ledger = entries if ledger is None else ledger.unionByName(entries)
        known = touched if known is None else known.union(touched)
        left = among(ledger, touched, "id").groupBy("id").agg(F.sum("refs").alias("refs"), F.sum("loose").alias("loose"), F.max("inside").alias("inside"))
        free = left.where("inside AND (refs = 0 OR loose > 0)").select("id")
        front = cut_lineage(without(free, features))
        if front.isEmpty():
            return features, cut_lineage(dropped.groupBy(*_EDGE).agg(F.max("owns").alias("owns")))
        features = features.union(front)


# ---------------------------------------------------------------- operators
def delete_features(store: Store, ids: DataFrame) -> tuple[Store, DataFrame]:
    """Delete features with all they contain; returns the new store and the affected input ids."""
    ids = cut_lineage(_ids(ids, "id"))
    features, dropped = _cascade(store, ids, None)
    gone = _values_deletion(store, dropped)
    gone = _merge(gone, {"feature": among(features, store["feature"], "id"), "property": _ids(dropped, "id")})
    existing = among(ids, store["feature"].select("id"), "id")
    referred = among(ids, _ids(store["property"], "val_feature_id"), "id")
    return apply_deletions(store, gone), existing.union(referred).distinct()


def delete_properties(store: Store, ids: DataFrame) -> tuple[Store, DataFrame]:
    """Delete properties, their nested values and same-named parents."""
    ids = cut_lineage(_ids(ids, "id"))
    rows, cascaded = _property_closure(store["property"], ids)
    features, dropped = _cascade_from_properties(store, rows)
    gone = _merge(_values_deletion(store, dropped), {"feature": among(features, store["feature"], "id"), "property": _ids(dropped, "id")})
    back = intersect_then_union(_ids(dropped, "id"), ids, cascaded)
    return apply_deletions(store, gone), back


def _cascade_from_properties(store: Store, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(rows)
    prop = store["property"]
    inside = cut_lineage(_ids(among(prop, rows, "id").where(F.col("val_relation_type") == CONTAINS), "val_feature_id"))
    # only what points at features these rows contain
    held = _references(without(among(prop, inside, "val_feature_id"), rows), 1)
    first = inside.join(any_size(held), "id", "left").where("refs IS NULL OR loose > 0").select("id")
    return _cascade(store, first, rows)


def intersect_then_union(deleted: DataFrame, asked: DataFrame, cascaded: DataFrame) -> DataFrame:
    asked = any_size(asked.select("id").alias("asked"))
    both = deleted.select("id").alias("deleted").join(asked, F.col("deleted.id").eqNullSafe(F.col("asked.id")), "left_semi")
    return both.union(cascaded.select("id")).distinct()


def delete_simple(store: Store, table: str, ids: DataFrame) -> tuple[Store, DataFrame]:
    """Delete geometries, templates, appearances, surface data, textures or addresses by id."""
    sets = {
        "geometry_data": geometry_deletion, "implicit_geometry": implicit_geometry_deletion,
        "appearance": appearance_deletion, "surface_data": surface_data_deletion,
    }
    ids = cut_lineage(_ids(ids, "id"))
    gone = sets[table](store, ids) if table in sets else {table: _ids(among(store[table], ids, "id"), "id")}
    return apply_deletions(store, gone), _ids(among(store[table], ids, "id"), "id")


def delete_by_class(store: Store, classname: str) -> tuple[Store, DataFrame]:
    """Delete all features of one class."""
    oc = store["objectclass"].where(F.col("classname") == classname).select(F.col("id").alias("objectclass_id"))
    ids = store["feature"].join(oc, "objectclass_id", "left_semi").select("id")
    return delete_features(store, ids)


def cleanup_store(store: Store) -> Store:
    """Empty all data tables, keep the dictionaries."""
    data = set(data_tables())
    return {n: df.limit(0) if n in data else df for n, df in store.items()}


# ---------------------------------------------------------------- termination
def without_active_parent(candidates: DataFrame, prop: DataFrame, feature: DataFrame) -> DataFrame:
    """Ids that no active feature contains. Only containments of the candidates and their parents are looked at."""
    contained = prop.where(F.col("val_relation_type") == CONTAINS).select("feature_id", "val_feature_id")
    held = among(contained, candidates, "val_feature_id")
    parents = among(feature, held.select(F.col("feature_id").alias("id")).where("id is not null").distinct(), "id")
    active = parents.where(F.col("termination_date").isNull()).select("id")
    return without(candidates, _ids(among(held, active, "feature_id"), "val_feature_id"))


def metadata_timestamp(metadata: dict, key: str, now: Column) -> Column:
    """A date from the metadata, now where it is absent or unreadable."""
    return F.coalesce(F.try_to_timestamp(F.lit(metadata.get(key)).cast("string")), now)


def terminate_features(
    store: Store, ids: DataFrame, metadata: dict | None = None, cascade: bool = True,
    now: Column | None = None, user: str = "spark",
) -> tuple[Store, DataFrame]:
    """Soft delete; contained features follow once no active feature contains them."""
    metadata = metadata or {}
    now = F.current_timestamp() if now is None else now
    feature, prop = store["feature"], store["property"]
    asked = cut_lineage(among(_ids(ids, "id"), feature.select("id"), "id"))
    done, front = asked, asked
    while cascade:
        children = _ids(among(prop, front, "feature_id").where(F.col("val_relation_type") == CONTAINS), "val_feature_id")
        children = cut_lineage(without(children, done))
        if children.isEmpty():
            break
        contained = prop.where(F.col("val_relation_type") == CONTAINS).select("feature_id", "val_feature_id")
        # parents ended in this edit hold nothing
        others = without(among(contained, children, "val_feature_id"), done, "feature_id").withColumn("val_relation_type", F.lit(CONTAINS))
        free = without_active_parent(children, others, feature)
        front = cut_lineage(among(free, feature.select("id"), "id"))
        if front.isEmpty():
            break
        done = done.union(front)
    hit = F.col("_hit").isNotNull()

    def text(key: str, default: Column) -> Column:
        return F.coalesce(F.lit(metadata.get(key)).cast("string"), default)

    changes = {
        "termination_date": metadata_timestamp(metadata, "termination_date", now),
        "last_modification_date": metadata_timestamp(metadata, "last_modification_date", now),
        "reason_for_update": text("reason_for_update", F.col("reason_for_update")),
        "updating_person": text("updating_person", F.lit(user)),
        "lineage": text("lineage", F.col("lineage")),
    }
    marked = feature.join(any_size(done.withColumn("_hit", F.lit(True))), "id", "left")
    new = marked.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})
    return {**store, "feature": new.select(*feature.columns)}, asked
