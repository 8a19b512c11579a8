"""A catalogue of layers: what each is built from, its saved versions, and the rebuild of what depends on it.

A saved layer is a view over a version table; its properties name that table and
the version of every input it was built from. Saving writes a new version table
and then points the view at it, so readers see the old layer or the new one, never
half of it; the version before stays for readers that began with it. What an input's
replacement makes stale can be told from the properties alone, also in a later
session on the same metastore.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLE, _BEFORE, _INPUT, _GIVEN = "layer.table", "layer.before", "layer.input.", "given"


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def layer_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """Version table and input versions of a saved layer; empty if there is none."""
    if not spark.catalog.tableExists(name):
        return {}
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect() if r.key.startswith("layer.")}


def save_layer(df: DataFrame, name: str, inputs: dict[str, str] | None = None) -> DataFrame:
    """Replace a materialised layer: write a new version, point the layer at it, drop the version before the last."""
    spark = df.sparkSession
    old = layer_properties(spark, name)
    if not old and spark.catalog.tableExists(name):
        raise ValueError(f"{name} exists and is no layer")
    version = f"{name}__{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").saveAsTable(version)
    properties = {_TABLE: version, _BEFORE: old.get(_TABLE, ""), **{_INPUT + k: v for k, v in (inputs or {}).items()}}
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ({listed}) AS SELECT * FROM {_quoted(version)}")
    if old.get(_BEFORE):
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(old[_BEFORE])}")
    return spark.table(name)


def drop_layer(spark: SparkSession, name: str) -> None:
    old = layer_properties(spark, name)
    if old:
        spark.sql(f"DROP VIEW IF EXISTS {_quoted(name)}")
        for table in filter(None, (old.get(_TABLE), old.get(_BEFORE))):
            spark.sql(f"DROP TABLE IF EXISTS {_quoted(table)}")


class Catalogue:
    """Layers of one schema with their builders.

    ``build`` gets the frames of the inputs, in the order they are named. A plain
    layer is saved; one with ``view=True`` is computed from its inputs when read.
    """

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self._layers: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], bool]] = {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(schema)}")

    def define(self, name: str, build: Callable[..., DataFrame], inputs: Iterable[str] = (), view: bool = False) -> None:
        """Inputs must be defined first, so the layers always form an acyclic graph."""
        inputs = tuple(inputs)
        unknown = [i for i in inputs if i not in self._layers]
        if unknown:
            raise LookupError(f"layer {name}: define its inputs first: {', '.join(unknown)}")
        self._layers[name] = (build, inputs, view)

    @property
    def names(self) -> list[str]:
        return list(self._layers)

    def inputs(self, name: str) -> tuple[str, ...]:
        return self._layers[name][1]

    def dependants(self, name: str) -> list[str]:
        """All layers built from this one, directly or not, in build order."""
        reached = {name}
        for other in self._layers:  # definition order is a build order
            if reached & set(self.inputs(other)):
                reached.add(other)
        return [n for n in self._layers if n in reached and n != name]

    def path(self, name: str) -> str:
        return f"{self.schema}.{name}"

    def _state(self, names: Iterable[str] | None = None) -> dict[str, dict[str, str]]:
        """Properties of the saved layers among ``names`` and their inputs, read once for a whole decision."""
        wanted = self._with_inputs(names)
        return {n: layer_properties(self.spark, self.path(n)) for n in self._layers if n in wanted and not self._layers[n][2]}

    def _with_inputs(self, names: Iterable[str] | None) -> set[str]:
        wanted = set(self._layers if names is None else names)
        for name in reversed(self._layers):
            if name in wanted:
                wanted |= set(self.inputs(name))
        return wanted

    def _version(self, name: str, state: dict) -> str | None:
        """Version table of a saved layer; of a view, the versions of its inputs."""
        if self._layers[name][2]:
            below = [self._version(i, state) for i in self.inputs(name)]
            return None if None in below else "+".join(below)
        return state[name].get(_TABLE)

    def _stale(self, name: str, state: dict) -> bool:
        _, inputs, view = self._layers[name]
        if view:
            return any(self._stale(i, state) for i in inputs)
        now = state[name]
        used = [i for i in inputs if now.get(_INPUT + i) != _GIVEN]
        return not now or any(self._stale(i, state) or now.get(_INPUT + i) != self._version(i, state) for i in used)

    def version(self, name: str) -> str | None:
        return self._version(name, self._state([name]))

    def stale(self, name: str) -> bool:
        """Not saved, saved from other versions of its inputs than there are now, or built on a stale input."""
        return self._stale(name, self._state([name]))

    def fresh(self, name: str) -> DataFrame:
        """The layer computed from its saved inputs; nothing is saved for the layer itself."""
        build, inputs, _ = self._layers[name]
        if inputs:
            self.build(*inputs)
        return build(*[self._read(i) for i in inputs])

    def table(self, name: str) -> DataFrame:
        """The layer as saved, after saving it and whatever it needs where missing or stale."""
        self.build(name)
        return self._read(name)

    def build(self, *names: str) -> list[str]:
        """Save the named layers (all, if none is named) and their inputs in order, as far as stale; what was saved."""
        wanted, done = self._with_inputs(names or None), []
        state = self._state(wanted)
        for name, (build, inputs, view) in self._layers.items():
            if name in wanted and not view and self._stale(name, state):
                self._save(name, build(*[self._read(i) for i in inputs]), state)
                done.append(name)
        return done

    def replace(self, name: str, df: DataFrame, given: bool = True) -> list[str]:
        """Put ``df`` in place of a layer and rebuild the saved layers that depend on it; their names.

        A given frame stands by itself: later changes of the layer's inputs leave it alone.
        """
        if self._layers[name][2]:
            raise ValueError(f"{name} is computed from its inputs; replace those")
        saved = [n for n in self.dependants(name) if layer_properties(self.spark, self.path(n))]
        state = self._state([name])
        inputs = {i: _GIVEN if given else self._version(i, state) for i in self.inputs(name)}
        save_layer(df, self.path(name), inputs)
        return self.build(*saved) if saved else []

    def refresh(self, name: str) -> list[str]:
        """Compute a layer again from its inputs, then the saved layers that depend on it; their names."""
        return self.replace(name, self.fresh(name), given=False)

    def drop(self, name: str) -> list[str]:
        """Drop a layer and all saved layers that depend on it; their names."""
        gone = [n for n in [name, *self.dependants(name)] if layer_properties(self.spark, self.path(n))]
        for n in gone:
            drop_layer(self.spark, self.path(n))
        return gone

    def require(self, name: str, columns: Iterable[str] = ()) -> DataFrame:
        """The saved layer; fails with its name if it is missing, lacks a column or is empty."""
        if not layer_properties(self.spark, self.path(name)):
            raise LookupError(f"layer {name} is not there; build it first")
        df = self.spark.table(self.path(name))
        lacking = [c for c in columns if c not in df.columns]
        if lacking:
            raise LookupError(f"layer {name} lacks the columns {', '.join(lacking)}")
        if df.isEmpty():
            raise LookupError(f"layer {name} is empty")
        return df

    def row_counts(self, names: Iterable[str] | None = None) -> DataFrame:
        """(layer, rows) of the named layers (all, if none are named)."""
        out, names = None, list(names or self._layers)
        self.build(*names)
        for name in names:
            part = self._read(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("layer"), "rows")
            out = part if out is None else out.unionByName(part)
        return out

    def _read(self, name: str) -> DataFrame:
        build, inputs, view = self._layers[name]
        return build(*[self._read(i) for i in inputs]) if view else self.spark.table(self.path(name))

    def _save(self, name: str, df: DataFrame, state: dict) -> None:
        save_layer(df, self.path(name), {i: self._version(i, state) for i in self.inputs(name)})
        state[name] = layer_properties(self.spark, self.path(name))
