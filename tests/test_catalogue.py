"""Layers: build order, swap, rebuild of dependants."""

import uuid

import pytest
from pyspark.sql import functions as F

from urbanframe.sources.catalogue import Catalogue, layer_properties, save_layer


@pytest.fixture
def layers(spark):
    c = Catalogue(spark, f"c_{uuid.uuid4().hex[:8]}")
    built = []

    def noted(name, fn):
        def build(*inputs):
            built.append(name)
            return fn(*inputs)

        return build

    c.define("base", noted("base", lambda: spark.range(10)))
    c.define("even", noted("even", lambda b: b.where("id % 2 = 0")), ["base"])
    c.define("late", noted("late", lambda e: e.where("id > 4")), ["even"], view=True)
    c.define("sums", noted("sums", lambda b, l: b.agg(F.sum("id").alias("s")).crossJoin(l.agg(F.count(F.lit(1)).alias("n")))), ["base", "late"])
    c.define("apart", noted("apart", lambda: spark.range(3)))
    return c, built


def test_builds_only_what_is_needed(layers):
    c, built = layers
    assert c.table("sums").first() == (45, 2)
    assert [n for n in built if n != "late"] == ["base", "even", "sums"] and layer_properties(c.spark, c.path("apart")) == {}
    built.clear()
    assert c.build() == ["apart"] and c.build() == []
    assert not any(c.stale(n) for n in c.names)
    assert c.dependants("base") == ["even", "late", "sums"] and c.dependants("sums") == []


def test_replacing_a_base_rebuilds_its_dependants(layers):
    c, built = layers
    c.build()
    built.clear()
    assert c.replace("base", c.spark.range(20)) == ["even", "sums"]
    assert c.table("sums").first() == (190, 7) and "base" not in built and "apart" not in built
    # an unsaved dependant is left unsaved
    c.drop("sums")
    assert c.replace("base", c.spark.range(4)) == ["even"] and layer_properties(c.spark, c.path("sums")) == {}


def test_a_given_layer_stands_by_itself(layers):
    c, _ = layers
    c.build()
    assert c.replace("even", c.spark.range(6)) == ["sums"]
    assert c.replace("base", c.spark.range(100)) == ["sums"]
    assert c.table("even").count() == 6 and c.table("sums").first()["n"] == 1
    assert c.refresh("even") == ["sums"] and c.table("even").count() == 50


def test_readers_of_the_version_before(layers):
    c, _ = layers
    before = c.table("base")
    first = layer_properties(c.spark, c.path("base"))["layer.table"]
    c.replace("base", c.spark.range(3))
    assert before.count() == 10 and c.table("base").count() == 3
    c.replace("base", c.spark.range(4))
    assert not c.spark.catalog.tableExists(first)


def test_drop_takes_dependants(layers):
    c, _ = layers
    c.build()
    assert c.drop("even") == ["even", "sums"]
    assert c.table("base").count() == 10 and c.stale("even")


def test_state_is_in_the_metastore(layers):
    c, _ = layers
    c.build()
    other = Catalogue(c.spark, c.schema)
    other.define("base", lambda: c.spark.range(1))
    other.define("even", lambda b: b, ["base"])
    assert other.build() == [] and other.table("even").count() == 5


def test_preconditions(layers):
    c, _ = layers
    with pytest.raises(LookupError, match="base"):
        c.require("base")
    c.build("base")
    assert c.require("base", ["id"]).count() == 10
    with pytest.raises(LookupError, match="geom"):
        c.require("base", ["geom"])
    c.replace("base", c.spark.range(0))
    with pytest.raises(LookupError, match="empty"):
        c.require("base")
    with pytest.raises(LookupError, match="first"):
        c.define("odd", lambda x: x, ["unknown"])
    with pytest.raises(ValueError):
        c.replace("late", c.spark.range(1))


def test_layers_keep_foreign_tables(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    spark.range(2).write.saveAsTable(name)
    with pytest.raises(ValueError):
        save_layer(spark.range(1), name)
