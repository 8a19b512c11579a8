"""Ids, ranks, dissolving, hierarchies, edits, materials, projection, sources."""

import math
import random
import re
import time
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from urbanframe.functions import geometry as G
from urbanframe.functions import kernels as K
from urbanframe.functions import projection as P
from urbanframe.functions.scalars import estimated_floors, hex_byte, number_text, round_numeric
from urbanframe.operators import advice, envelopes, features, hierarchy, materials, store_edit, tiles
from urbanframe.operators import dissolve as D
from urbanframe.operators.dissolve import covered_area, dissolve
from urbanframe.operators.ids import dense_id, rank_in_group
from urbanframe.plans import shadow
from urbanframe.registry import city, styling
from urbanframe.schema import BBOX_DDL
from urbanframe.session import cut_lineage
from urbanframe.sources import tables, vector

from conftest import SF


def test_dense_id(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = [tuple(r) for r in dense_id(df, ["v"], "gid").collect()]
    assert sorted(got) == [(i + 1, i) for i in range(1000)]


def test_tiles_keep_rows_of_repeated_keys(spark):
    rows = spark.range(10).select((F.col("id") % 3).alias("id"), G.st_rectangle(
        F.col("id") * 1.0, F.lit(0.0), F.col("id") + 1.0, F.lit(1.0)).alias("geom"))
    assert tiles.quadtree_tiles(rows, 2).count() == 10


def test_lines_of_a_collection(spark, tmp_path):
    path = str(tmp_path / "layer.json")
    square = '{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}'
    lines = [
        '{"type":"FeatureCollection","features":[',
        f'{{"type":"Feature","properties":{{"ID":1}},"geometry":{square}}}',
        f',{{"geometry":{square},"type": "Feature","properties":{{"ID":2}}}}',
        f',{{"properties":{{"ID":3}},"type" : "Feature","geometry":{square}}}', "]}",
    ]
    with open(path, "w") as f:
        f.write("\n".join(lines))
    got = vector.read_feature_collection(spark, path, "ID bigint", srid=3879, target=None, by_line=True)
    assert sorted(r.id for r in got.select("id").collect()) == [1, 2, 3]


def test_multi_kinds_stay_in_geojson(spark):
    texts = [
        '{"type":"MultiLineString","coordinates":[[[0.0,0.0],[1.0,1.0]],[[2.0,2.0],[3.0,3.0]]]}',
        '{"type":"MultiPoint","coordinates":[[0.0,0.0],[1.0,1.0]]}',
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", vector.to_geojson(vector.geojson_geometry(F.col("t"), 3879)).alias("back")).collect()
    assert all(r.back == r.t for r in got)


def test_holes_of_surfaces(spark, tmp_path):
    ring = lambda a, b: f"{a} {a} 0 {b} {a} 0 {b} {b} 0 {a} {b} 0 {a} {a} 0"
    xml = (
        '<m><bldg:Building gml:id="B1"><bldg:boundedBy><bldg:GroundSurface gml:id="G1"><bldg:lod2MultiSurface><gml:MultiSurface>'
        '<gml:surfaceMember><gml:Polygon gml:id="p"><gml:exterior><gml:LinearRing><gml:posList>' + ring(0, 10) + "</gml:posList>"
        "</gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList>" + ring(2, 8) + "</gml:posList></gml:LinearRing>"
        "</gml:interior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:GroundSurface>"
        "</bldg:boundedBy></bldg:Building></m>"
    )
    path = tmp_path / "city.xml"
    path.write_text(xml)
    got = vector.read_citygml(spark, str(path))["geometry_data"]
    assert got.select(G.st_area("geometry")).first()[0] == 64.0


def _gml(*members):
    names = 'xmlns:core="c" xmlns:bldg="b" xmlns:gml="g" xmlns:dem="d" xmlns:veg="v" xmlns:xlink="x"'
    return f"<core:CityModel {names}>" + "".join(f"<core:cityObjectMember>{m}</core:cityObjectMember>" for m in members) + "</core:CityModel>"


def _square(x, size, z=0, holes=()):
    ring = lambda a, b: f"<gml:LinearRing><gml:posList>{a} {a} {z} {b} {a} {z} {b} {b} {z} {a} {b} {z} {a} {a} {z}</gml:posList></gml:LinearRing>"
    inner = "".join(f"<gml:interior>{ring(a, b)}</gml:interior>" for a, b in holes)
    return f"<gml:surfaceMember><gml:Polygon><gml:exterior>{ring(x, x + size)}</gml:exterior>{inner}</gml:Polygon></gml:surfaceMember>"


def _shell(lod, *squares):
    return f"<bldg:lod{lod}MultiSurface><gml:MultiSurface>{''.join(squares)}</gml:MultiSurface></bldg:lod{lod}MultiSurface>"


def _solid(lod, *squares):
    inner = f"<gml:CompositeSurface>{''.join(squares)}</gml:CompositeSurface>"
    return f"<bldg:lod{lod}Solid><gml:Solid><gml:exterior>{inner}</gml:exterior></gml:Solid></bldg:lod{lod}Solid>"


def _city_text():
    bound = lambda tag, key, body: f'<bldg:boundedBy><bldg:{tag} gml:id="{key}">{body}</bldg:{tag}></bldg:boundedBy>'
    tile = '<gml:surfaceMember xlink:href="#elsewhere"/>'
    part = f'<bldg:consistsOfBuildingPart><bldg:BuildingPart gml:id="P2">{bound("RoofSurface", "R2", _shell(3, _square(30, 3, 9)))}</bldg:BuildingPart></bldg:consistsOfBuildingPart>'
    house = (
        f'<bldg:Building gml:id="B1"><bldg:measuredHeight>12.5</bldg:measuredHeight>{_solid(1, _square(0, 10), _square(0, 10, 12))}{_solid(2, tile)}'
        + bound("GroundSurface", "G1", _shell(2, _square(0, 10, 0, [(2, 4), (6, 7)])))
        + bound("OuterCeilingSurface", "", _shell(4, _square(1, 2))).replace(' gml:id=""', "")
        + f'<bldg:consistsOfBuildingPart><bldg:BuildingPart gml:id="P1">{_solid(2, _square(20, 5, 1))}{part}</bldg:BuildingPart></bldg:consistsOfBuildingPart></bldg:Building>'
    )
    triangle = lambda x: f"<gml:Triangle><gml:exterior><gml:LinearRing><gml:posList>{x} 0 1 {x + 2} 0 1 {x} 2 1 {x} 0 1</gml:posList></gml:LinearRing></gml:exterior></gml:Triangle>"
    patches = "<gml:TriangulatedSurface><gml:trianglePatches>" + "".join(map(triangle, range(0, 40, 2))) + "</gml:trianglePatches></gml:TriangulatedSurface>"
    relief = (
        '<dem:ReliefFeature gml:id="T1"><dem:lod>1</dem:lod><dem:reliefComponent><dem:TINRelief gml:id="T2"><dem:lod>1</dem:lod>'
        f"<dem:tin>{patches}</dem:tin></dem:TINRelief></dem:reliefComponent></dem:ReliefFeature>"
    )
    return house, relief


def test_members_of_all_kinds(spark, tmp_path):
    path = tmp_path / "city.gml"
    path.write_text(_gml(*_city_text(), '<bldg:Building gml:id="B2"/>'))
    got = vector.read_citygml(spark, str(path))
    features = {r.objectid: r for r in got["feature"].withColumn("box", G.st_bbox("envelope")).collect()}
    assert {k: r.classname for k, r in features.items()} == {
        "B1": "Building", "B2": "Building", "P1": "BuildingPart", "P2": "BuildingPart", "G1": "GroundSurface", "R2": "RoofSurface",
        "B1_OuterCeilingSurface_1": "OuterCeilingSurface", "T1": "ReliefFeature", "T2": "TINRelief",
    }
    box = features["B1"].box  # with its parts' parts
    assert (box.xmin, box.xmax, box.zmax) == (0.0, 33.0, 12.0) and features["B2"].box is None and features["T1"].box.xmax == 40.0
    names = {r.id: k for k, r in features.items()}
    shapes = got["geometry_data"].select("id", "feature_id", G.st_area("geometry").alias("area"), "geometry.kind").collect()
    drawn = got["property"].where("val_geometry_id IS NOT NULL").collect()
    by_id = {r.id: r for r in shapes}
    assert len(by_id) == len(shapes) == len(drawn)
    held = sorted((names[r.feature_id], r["name"], r.val_lod, by_id[r.val_geometry_id].area) for r in drawn if r["name"] != "tin")
    assert held == [
        ("B1", "lod1Solid", "1", 200.0), ("B1_OuterCeilingSurface_1", "lod4MultiSurface", "4", 4.0), ("G1", "lod2MultiSurface", "2", 95.0),
        ("P1", "lod2Solid", "2", 25.0), ("R2", "lod3MultiSurface", "3", 9.0),
    ]
    tin = [by_id[r.val_geometry_id] for r in drawn if r["name"] == "tin"]
    assert len(tin) == 20 and {(names[r.feature_id], r.kind, r.area) for r in tin} == {("T2", "Triangle", 2.0)}
    links = {(names[r.feature_id], r["name"], names[r.val_feature_id]) for r in got["property"].where("val_feature_id IS NOT NULL").collect()}
    assert links == {
        ("B1", "boundary", "G1"), ("B1", "boundary", "B1_OuterCeilingSurface_1"), ("B1", "buildingPart", "P1"), ("P1", "buildingPart", "P2"),
        ("P2", "boundary", "R2"), ("T1", "reliefComponent", "T2"),
    }
    assert [(names[r.feature_id], r.val_double) for r in got["property"].where("name = 'height'").collect()] == [("B1", 12.5)]


def test_one_large_member_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "city.gml"
    house = lambda i: f'<bldg:Building gml:id="B{i}"><bldg:measuredHeight>{i}</bldg:measuredHeight>{_shell(2, _square(i, 2))}</bldg:Building>\n<!-- {i} -->'
    path.write_text("<!-- head -->\n" + _gml(*map(house, range(400))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        doc = vector._tagged(spark, str(path), "core:cityObjectMember", vector.T.StructType.fromDDL(vector.CITYGML_MEMBER_DDL))
        assert doc.rdd.getNumPartitions() > 4
        ids = doc.select(F.col("`bldg:Building`")["_gml:id"].alias("i")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.i for r in ids) == sorted(f"B{i}" for i in range(400))


@pytest.mark.parametrize("odd", [
    "<!-- <core:cityObjectMember><bldg:Building gml:id='X'/></core:cityObjectMember> -->", "<![CDATA[<core:cityObjectMember>]]>", '<core:cityObjectMember xlink:href="#B1"/>',
])
def test_tags_that_do_not_open_a_member(spark, tmp_path, odd):
    path = tmp_path / "city.gml"
    path.write_text(_gml('<bldg:Building gml:id="B1"/>', '<bldg:Building gml:id="B2"/>').replace("</core:CityModel>", f"{odd}</core:CityModel>"))
    got = vector.read_citygml(spark, str(path))
    assert sorted(r.objectid for r in got["feature"].collect()) == ["B1", "B2"]


def test_unknown_members_fail_or_are_listed(spark, tmp_path):
    path = tmp_path / "city.gml"
    path.write_text(_gml(_city_text()[0], '<veg:PlantCover gml:id="V1"><veg:height>3</veg:height></veg:PlantCover>'))
    with pytest.raises(Exception, match="not read"):
        vector.read_citygml(spark, str(path))["feature"].collect()
    got = vector.read_citygml(spark, str(path), unknown="list")
    assert got["feature"].where("classname = 'Building'").count() == 1
    assert ["<veg:height>3" in r.element for r in got["unread"].collect()] == [True]


def test_feature_lines_with_any_white_space(spark, tmp_path):
    square = '{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}'
    feature = lambda i: f'{{"type": "Feature", "properties": {{"ID": {i}}}, "geometry": {square}}}'

    def read(name, *lines):
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(lines))
        return sorted(r.id for r in vector.read_feature_collection(spark, str(path), "ID bigint", srid=3879, target=None, by_line=True).select("id").collect())

    head = ["{", '"type": "FeatureCollection",', '"name": "x",', '"crs": { "type": "name" },', '"features": [']
    assert read("tabs", *head, "\t" + feature(1) + ",", "\r\t " + feature(2) + " \t,", feature(3), "]", "}") == [1, 2, 3]
    assert read("head", '{"type":"FeatureCollection","features":[', feature(4) + ",", feature(5), "]}") == [4, 5]
    for name, bad in (("cut", '{"type": "Feature", "properties": {"ID": 7'), ("prose", "not a feature"), ("pretty", '"type": "Feature",'), ("both", '{"type":"FeatureCollection","features":[' + feature(1))):
        with pytest.raises(Exception, match="no feature"):
            read(name, *head, feature(1) + ",", bad, "]", "}")


def test_collections_both_ways(spark):
    point, line = '{"type":"Point","coordinates":[1.0,2.0]}', '{"type":"LineString","coordinates":[[0.0,0.0],[3.0,4.0]]}'
    poly = '{"type":"Polygon","coordinates":[[[0.0,0.0],[2.0,0.0],[2.0,2.0],[0.0,0.0]]]}'
    nested = f'{{"type":"GeometryCollection","geometries":[{point},{{"type":"GeometryCollection","geometries":[{line},{poly}]}}]}}'
    texts = [(1, f'{{"type":"GeometryCollection","geometries":[{point},{point}]}}'), (2, nested), (3, None), (4, f'{{"type":"GeometryCollection","geometries":[{poly},{poly}]}}'), (5, "null")]
    df = spark.createDataFrame(texts, "id long, t string").select("id", vector.geojson_geometry(F.col("t"), 4326).alias("g"))
    got = {r.id: r for r in df.select("id", G.st_npoints("g").alias("n"), "g.kind", vector.to_geojson("g").alias("t")).collect()}
    assert (got[1].n, got[1].kind, got[1].t) == (2, "GeometryCollection", texts[0][1])
    assert got[2].n == 7 and got[2].t == f'{{"type":"GeometryCollection","geometries":[{point},{line},{poly}]}}'
    assert got[3].kind is None and got[5].kind is None and '"MultiPolygon"' in got[4].t
    with pytest.raises(Exception, match="no geometry"):
        spark.createDataFrame([('{"type":"Circle"}',)], "t string").select(vector.geojson_geometry(F.col("t"), 4326).alias("g")).collect()


def test_lines_have_no_area(spark):
    ring = F.array(*[G.make_point(x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))])
    df = spark.range(1).select(G.st_makeline(ring).alias("l"), G.st_makepolygon(ring).alias("p"))
    assert tuple(df.select(G.st_area("l"), G.st_area("p"), F.size(G.polygons_only("l")["parts"]), F.size(G.polygons_only("p")["parts"])).first()) == (0.0, 0.5, 0, 1)


def test_one_rounding(spark):
    values = [0.4999996, 0.5, -0.5, 2.675, 1.005, -1.005, 37.724999999999994, 1e14, 123456789012345.67, 1e-9, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [tuple(r) for r in df.select(round_numeric("v", 0), round_numeric("v", 2)).collect()]
    exact = lambda v, n: None if v is None else float(Decimal(f"{v:.14e}").quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))
    assert got == [(exact(v, 0), exact(v, 2)) for v in values]


def test_rank_in_group(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 50).alias("g"), F.col("id").alias("v"))
    a = {tuple(r) for r in rank_in_group(df, "g", [F.desc("v")], "r").select("g", "v", "r").collect()}
    own = Window.partitionBy("g").orderBy(F.desc("v"))
    b = {tuple(r) for r in df.withColumn("r", F.row_number().over(own)).select("g", "v", "r").collect()}
    assert a == b and len(a) == 900


def _squares(spark, n=400):
    df = spark.range(n).withColumn("k", F.when(F.col("id") < n * 3 / 4, 0).otherwise(1))
    x, y = (F.col("id") * 37 % 30).cast("double"), (F.col("id") * 11 % 20).cast("double")
    return df.select("k", "id", G.st_rectangle(x, y, x + 3, y + 2).alias("geom"))


def _kernel_area(df):
    """Independent way: the whole group in one numpy overlay."""
    return {r[0]: r[1] for r in df.groupBy("k").agg(G.collect_parts("geom").alias("g")).select("k", K.st_covered_area("g")).collect()}


@pytest.mark.parametrize("crowd", [2, 8, 1000])
def test_hot_groups_dissolve_to_the_same_area(spark, crowd):
    df = _squares(spark)
    plain = _kernel_area(df)
    swept = {r[0]: r[1] for r in covered_area(df, ["k"], "geom", crowd).collect()}
    assert plain.keys() == swept.keys() and all(math.isclose(plain[k], swept[k]) for k in plain)
    merged = {r[0]: r[1] for r in dissolve(df, ["k"], "geom", "id", crowd).select("k", G.st_area("geom")).collect()}
    assert all(math.isclose(plain[k], merged[k]) for k in plain)


def _shapes(spark, n, seed):
    """Triangles, stars with a hole and sheared boxes that cross each other; a third of all in one group."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, s = rnd.uniform(0, 40), rnd.uniform(0, 40), rnd.choice([1, 3, 12])
        turn = lambda a, r: (x + r * math.cos(a), y + r * math.sin(a), 0.0)  # noqa: E731, B023
        corners = rnd.choice([3, 4, 7])
        shell = [turn(2 * math.pi * j / corners + i, s * (0.5 + rnd.random())) for j in range(corners)]
        rings = [shell + shell[:1]]
        if corners == 7:
            hole = [turn(2 * math.pi * j / 3, s * 0.2) for j in range(3)]
            rings.append(hole + hole[:1])
        rows.append((0 if i % 3 else i % 5, i, [rings]))
    parts = "array<array<array<struct<x: double, y: double, z: double>>>>"
    df = spark.createDataFrame(rows, f"k int, id int, parts {parts}")
    return df.select("k", "id", G.geometry("Polygon", F.col("parts"), 3879).alias("geom"))


@pytest.mark.parametrize("crowd", [3, 20])
def test_swept_area_of_crossing_shapes(spark, crowd):
    df = _shapes(spark, 150, 5)
    plain = _kernel_area(df)
    swept = {r[0]: r[1] for r in covered_area(df, ["k"], "geom", crowd).collect()}
    assert plain.keys() == swept.keys()
    for k in plain:
        assert math.isclose(plain[k], swept[k], rel_tol=1e-9), k


def test_swept_area_of_odd_groups(spark):
    df = _squares(spark, 40)
    # copies of one shape in one place, a null group, groups without area
    stack = df.select(F.when(F.col("k") == 0, F.lit(7)).alias("k"), "id", G.st_rectangle(0, 0, 2, 5).alias("geom"))
    empty = df.select(F.lit(9).alias("k"), "id", F.lit(None).cast(df.schema["geom"].dataType).alias("geom"))
    lines = df.select(F.lit(10).alias("k"), "id", G.st_makeline(F.array(G.make_point(0, 0), G.make_point(4, 4))).alias("geom"))
    got = {r[0]: r[1] for r in covered_area(stack.union(empty).union(lines), ["k"], "geom", 4).collect()}
    assert got == {7: 10.0, None: 10.0, 9: 0.0, 10: 0.0}


def test_a_hot_group_spreads_over_cells(spark):
    n = 20_000
    df = spark.range(n).select(
        F.lit(1).alias("k"), "id", G.st_rectangle(F.rand(1) * 500, F.rand(2) * 500, F.lit(0.0), F.lit(0.0)).alias("geom")
    )
    x, y = F.pmod(F.xxhash64("id"), F.lit(50_000)) / 100, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50_000)) / 100
    df = df.select("k", "id", G.st_rectangle(x, y, x + 2, y + 2).alias("geom"))
    _, rest = D._settled(D._pieces(df, ["k"], "geom"), D.CROWD)
    sizes = [r["count"] for r in rest.groupBy(*D._PLACE).count().collect()]
    assert max(sizes) <= D.CROWD and len(sizes) > 500
    swept = covered_area(df, ["k"], "geom").first()["covered_area"]
    assert math.isclose(swept, _kernel_area(df)[1], rel_tol=1e-9)


def test_hierarchy_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert {r[0] for r in hierarchy.descend(edges, roots).collect()} == {1, 2, 3}


def _tiny_store(spark):
    st = city.store(spark, SF)
    f = spark.createDataFrame([(1, 901), (2, 902), (3, 905), (4, 901)], "id long, objectclass_id int")
    p = spark.createDataFrame(
        [(10, 1, 2, 1), (11, 2, 3, 1), (12, 3, 1, 1), (13, 4, 3, 0)], "id long, feature_id long, val_feature_id long, val_relation_type int"
    )
    return {**{k: v.limit(0) if k in ("geometry_data", "implicit_geometry", "appearance", "appear_to_surface_data", "surface_data", "surface_data_mapping", "tex_image", "address") else v for k, v in st.items()},
            "feature": city._conform(f, "feature"), "property": city._conform(p, "property")}


def test_delete_follows_a_cycle_and_plain_references(spark):
    after, ids = store_edit.delete_features(_tiny_store(spark), spark.createDataFrame([(1,)], "id long"))
    assert {r.id for r in after["feature"].select("id").collect()} == {4}
    assert {r.id for r in after["property"].select("id").collect()} == set()
    assert {r.id for r in ids.collect()} == {1}


def test_terminate_waits_for_active_parents(spark):
    st = _tiny_store(spark)
    p = spark.createDataFrame([(10, 1, 3, 1), (11, 4, 3, 1), (12, 1, 2, 1)], "id long, feature_id long, val_feature_id long, val_relation_type int")
    st["property"] = city._conform(p, "property")
    after, ids = store_edit.terminate_features(st, spark.createDataFrame([(1,), (99,)], "id long"), {"reason_for_update": "x"})
    assert {r.id for r in after["feature"].where("termination_date is not null").collect()} == {1, 2}
    assert {r.id for r in ids.collect()} == {1}
    alone, _ = store_edit.terminate_features(st, spark.createDataFrame([(1,)], "id long"), cascade=False)
    assert alone["feature"].where("termination_date is not null").count() == 1


def _linked(spark, boxes, pairs):
    rows = [(i, None if b is None else (float(b), 0.0, 0.0, float(b) + 1, 1.0, 1.0)) for i, b in boxes.items()]
    df = spark.createDataFrame(rows, "id long, box struct<xmin: double, ymin: double, zmin: double, xmax: double, ymax: double, zmax: double>")
    edges = spark.createDataFrame(pairs, "id long, child long")
    return cut_lineage(df.withColumn("box", F.col("box").cast(BBOX_DDL))), cut_lineage(edges)


def _reach(pairs):
    below = {}
    for a, b in pairs:
        below.setdefault(a, []).append(b)

    def of(node):
        seen, todo = {node}, [node]
        while todo:
            for c in below.get(todo.pop(), []):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    return of


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boxes_travel_through_cycles_and_shared_parts(spark, seed):
    rnd = random.Random(seed)
    n = 60
    boxes = {i: rnd.choice([None, rnd.randint(-50, 50)]) for i in range(n)}
    pairs = list({(rnd.randrange(n), rnd.randrange(n)) for _ in range(50)} | {(i, i + 1) for i in range(30, 45)} | {(45, 30)})
    of = _reach(pairs)
    got = {r["id"]: r["box"] for r in envelopes.boxes_upwards(*_linked(spark, boxes, pairs)).collect()}
    assert got.keys() == boxes.keys()
    for i in boxes:
        here = [boxes[j] for j in of(i) if boxes[j] is not None]
        assert (got[i] is None) == (not here)
        assert not here or (got[i]["xmin"], got[i]["xmax"]) == (min(here), max(here) + 1)


def test_boxes_travel_up_a_long_chain(spark):
    n = 10_000
    boxes = {i: 7 * i % 1000 if i < n - 1 else -5000 for i in range(n)}
    t = time.time()
    got = envelopes.boxes_upwards(*_linked(spark, boxes, [(i, i + 1) for i in range(n - 1)]))
    assert got.count() == n and got.where("box.xmin = -5000").count() == n
    assert time.time() - t < 120


@pytest.mark.parametrize("seed", [1, 2])
def test_delete_rounds_against_a_plain_loop(spark, seed):
    """Features in chains, shared and loose; the ledger must give what counting everything again gives."""
    rnd = random.Random(seed)
    n = 30
    rows, made = [], set()
    for i in range(100, 170):
        a, b = rnd.randrange(1, n), rnd.randrange(1, n)
        if a != b and (a, b) not in made:
            made.add((a, b))
            rows.append((i, a, b, rnd.choice([1, 1, 1, 0])))
    st = _tiny_store(spark)
    f = spark.createDataFrame([(i, 901) for i in range(1, n)], "id long, objectclass_id int")
    p = spark.createDataFrame([(*r, f"name{r[0]}") for r in rows], "id long, feature_id long, val_feature_id long, val_relation_type int, name string")
    st = {**st, "feature": city._conform(f, "feature"), "property": city._conform(p, "property")}
    start = {1, 2, 3}
    features, gone = set(start), set()
    while True:
        for i, a, b, rel in rows:
            if a in features or b in features:
                gone.add(i)
        inside = {b for i, a, b, rel in rows if i in gone and rel == 1 and b not in features}
        # a row that only points at a deleted feature does not own its value unless it is a containment of its own
        free = set()
        for c in inside:
            rest = [rel for i, a, b, rel in rows if b == c and i not in gone]
            if not rest or 0 in rest:
                free.add(c)
        if not free:
            break
        features |= free
    after, _ = store_edit.delete_features(st, spark.createDataFrame([(i,) for i in start], "id long"))
    assert {r.id for r in after["feature"].select("id").collect()} == set(range(1, n)) - features
    assert {r.id for r in after["property"].select("id").collect()} == {r[0] for r in rows} - gone


def test_matrix_must_have_twelve_values(spark):
    df = spark.createDataFrame([("[1,2,3]",)], "m string")
    with pytest.raises(Exception, match="Invalid transformation matrix"):
        df.select(envelopes.parse_matrix(F.col("m"))).collect()


def test_projection(spark):
    # published corner of a layer and its metric position
    df = spark.createDataFrame([(24.941805, 60.153217), (24.963729, 60.168045)], "lon double, lat double")
    g = df.select(G.st_point(F.col("lon"), F.col("lat"), srid=4326).alias("g")).select("g", P.st_transform("g", 3879).alias("m"))
    back = g.select(G.st_x("m"), G.st_y("m"), G.st_x(P.st_transform("m", 4326)) - G.st_x("g"), G.st_y(P.st_transform("m", 4326)) - G.st_y("g")).collect()
    assert abs(back[0][0] - 25496767.7) < 0.1 and abs(back[0][1] - 6671144.7) < 0.1
    assert abs(back[1][0] - 25497986.4) < 0.1 and abs(back[1][1] - 6672795.9) < 0.1
    assert all(abs(r[2]) < 1e-8 and abs(r[3]) < 1e-8 for r in back)
    with pytest.raises(ValueError):
        P.st_transform("g", 3857)


def test_rejected_styles(spark):
    for mode in (materials.NO_STYLE, materials.EXISTING):
        with pytest.raises(ValueError):
            materials.styled_geometries(city.store(spark, SF), styling.rules(spark), mode, materials.RISE_UP)


def test_tiles_respect_the_cap_and_lose_nothing(spark):
    layer = city.class_geometries(spark, SF)
    t = tiles.quadtree_tiles(layer, 20)
    assert t.count() == layer.count() == t.select("id").distinct().count()
    assert t.groupBy("level", "x", "y").count().agg(F.max("count")).first()[0] <= 20
    deep = tiles.quadtree_tiles(layer, 3, max_level=2)
    assert deep.count() == layer.count() and deep.agg(F.max("level")).first()[0] == 2
    doc = tiles.tileset_manifest(layer.withColumn("geom", G.st_translate("geom", 25490000.0, 6670000.0)), t).first()[0]
    assert '"subdivisionScheme":"QUADTREE"' in doc and '"subtreeLevels":4' in doc


def _dots(spark, rows):
    df = spark.createDataFrame(rows, "id long, x double, y double, s double, class string")
    return df.select("id", "class", G.st_rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s")).alias("geom"))


def test_tiles_of_a_class_are_not_put_into_one_task(spark, monkeypatch):
    x = F.col("id") % 30
    layer = spark.range(200).select(
        "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("class"), G.st_rectangle(x, F.col("id"), x + 1, F.col("id") + 2).alias("geom")
    )
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(tiles, "cut_lineage", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond it
    try:
        placed = tiles.separate_tilesets(layer, {"a": 3, "b": 5})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert placed.count() == 200
    assert not [p for p in plans if re.search(r"SortMergeJoin \[class#\d+\]", p)]


def test_tiles_go_as_deep_as_it_takes(spark):
    """A crowded spot far below level 10 and features of one centre beyond the cap."""
    rnd = random.Random(3)
    rows = [(i, rnd.random() * 1e5, rnd.random() * 1e5, 1.0, "a") for i in range(60)]
    rows += [(100 + i, 5e4 + rnd.random(), 5e4 + rnd.random(), 1.0, "a") for i in range(60)]
    rows += [(200 + i, 7e4, 7e4, 1.0, "a") for i in range(30)]
    got = tiles.quadtree_tiles(_dots(spark, rows), 4).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows) and max(r.level for r in got) > 10
    held = {}
    for r in got:
        held.setdefault((r.level, r.x, r.y), []).append(r.id)
    over = [ids for ids in held.values() if len(ids) > 4]
    assert len(over) == 1 and all(i >= 200 for i in over[0])


def test_cut_values_pick_the_largest(spark):
    """Against a plain level-by-level ranking, with many equal areas."""
    rnd = random.Random(4)
    rows = [(i, float(rnd.randrange(100_000)), float(rnd.randrange(100_000)), float(rnd.choice([1, 1, 1, 2, 3])), "a") for i in range(500)]
    got = {(r.id, r.level, r.x, r.y) for r in tiles.quadtree_tiles(_dots(spark, rows), 7).collect()}
    centre = {i: (x + s / 2, y + s / 2, -s * s) for i, x, y, s, _ in rows}
    x0, y0 = min(c[0] for c in centre.values()), min(c[1] for c in centre.values())
    side = max(max(c[0] for c in centre.values()) - x0, max(c[1] for c in centre.values()) - y0)
    want, rest, level = set(), set(centre), 0
    while rest:
        tiles_ = {}
        for i in rest:
            x, y, area = centre[i]
            at = tuple(min(int((v - o) / side * 2**level), 2**level - 1) for v, o in ((x, x0), (y, y0)))
            tiles_.setdefault(at, []).append((round(area, 9), i))
        for at, own in tiles_.items():
            for _, i in sorted(own)[:7]:
                want.add((i, level, *at))
                rest.discard(i)
        level += 1
    assert got == want


def test_one_class_of_the_content_is_replaced(spark, tmp_path):
    path = str(tmp_path / "content")
    layer = _dots(spark, [(i % 40, float(i), float(i % 7), 1.0, "ab"[i % 2]) for i in range(120)])
    tiles.write_tile_content(tiles.tile_content(layer, {"a": 3, "b": 5}), path)
    before = tiles.read_tile_content(spark, path, ["b"]).select("id", "level", "x", "y").collect()
    assert tiles.read_tile_content(spark, path).count() == 120 and len(before) == 60
    deep = tiles.read_tile_content(spark, path, ["a"]).agg(F.max("level")).first()[0]
    tiles.write_tile_content(tiles.tile_content(layer.where("id < 10"), {"a": 50}), path)
    after = tiles.read_tile_content(spark, path, ["a"])
    assert deep > 0 and after.agg(F.max("level")).first()[0] == 0 and after.count() == layer.where("class = 'a' AND id < 10").count()
    assert sorted(before) == sorted(tiles.read_tile_content(spark, path, ["b"]).select("id", "level", "x", "y").collect())
    assert tiles.read_tile_content(spark, path, ["a"], level=0).count() == after.count()


def test_rounding_and_text(spark):
    df = spark.createDataFrame([(2.5, 1.005, 8.0)], "a double, b double, h double")
    r = df.select(round_numeric("a", 0), round_numeric("b", 2), estimated_floors(F.col("h")), number_text(F.col("a")), number_text(F.col("h")), hex_byte(F.lit(1.0)), hex_byte(F.lit(0.01))).first()
    assert tuple(r) == (3.0, 1.01, 3, "2.5", "8", "100", "3")


def test_null_class_is_dropped_by_exclusion(spark):
    from urbanframe.operators.filters import exclude_classes

    df = spark.createDataFrame([("A",), ("B",), (None,)], "class string")
    assert [r[0] for r in exclude_classes(df, ["A"]).collect()] == ["B"]


def test_update_ignores_unknown_condition(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, v int")
    up = features.update_features(df, F.col("v") > 1, {"v": F.lit(0)})
    assert {tuple(r) for r in up.collect()} == {(1, None), (2, 0)}
    assert features.delete_features_where(df, F.col("v") > 1).count() == 1


def test_geojson_kinds(spark):
    texts = [
        '{"type":"Point","coordinates":[1,2]}', '{"type":"LineString","coordinates":[[0,0],[1,1]]}',
        '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}',
        '{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,6],[5,5]]]]}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(vector.geojson_geometry(F.col("t"), 3879).alias("g"))
    got = [tuple(r) for r in df.select(G.st_geometrytype("g"), G.st_npoints("g"), G.st_area("g")).collect()]
    assert got == [("Point", 1, 0.0), ("LineString", 2, 0.0), ("Polygon", 10, 15.0), ("MultiPolygon", 10, 5.0)]


def test_custom_rule_file_wins(spark, tmp_path):
    head = ",".join(materials.RULE_COLUMNS)
    (tmp_path / "a.csv").write_text(head + "\n,anything_else,,,,,,#ffff00ff,#000000,,\n")
    (tmp_path / "b.csv").write_text(head + "\nbldg,Building,,,,,,#111111ff,,,\nbldg,Door,,,,,,#222222ff,,,\n")
    assert vector.read_material_rules(spark, str(tmp_path / "a.csv")).count() == 1
    custom = vector.read_material_rules(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert {(r.id, r.classname, r.property_value) for r in custom.collect()} == {(1, "Building", None), (2, "Door", None)}


def test_layer_is_replaced(spark):
    for n in (5, 3):
        assert tables.save_layer(spark.range(n), "replaced_layer").count() == n


def test_recommendation_variants(spark):
    st = city.store(spark, SF)
    all_ = advice.max_features_unrounded(st["geometry_data"]).first()
    assert all_.max_features_per_tile == 2000
    top = advice.max_features_unrounded(st["geometry_data"], st["feature"], st["objectclass"]).first()
    assert top.avg_vertice_number is None  # no top-level feature owns a geometry here


def _joins(df):
    """The plan as Spark would run it, as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def _nested_properties(spark):
    """Properties in a wide written table: every third row hangs on the one before, with the same name."""
    return cut_lineage(city._conform(spark.range(0, 3000).selectExpr(
        "id", "CASE WHEN id % 3 = 1 THEN id - 1 END AS parent_id", "concat('n', id div 3) AS name", "1 AS namespace_id"
    ), "property"))


def test_property_joins_broadcast_nothing(spark):
    prop = _nested_properties(spark)
    every = prop.select("id")
    parents = store_edit.same_named_parents(prop, every)
    assert "Broadcast" not in _joins(parents)
    assert sorted(map(tuple, parents.collect())) == [(i, i - 1) for i in range(1, 3000, 3)]
    below = hierarchy.property_subtree(prop, prop.where("id % 3 = 0").select("id"))
    assert sorted(r.id for r in below.collect()) == [i for i in range(3000) if i % 3 != 2]
    assert "Broadcast" not in _joins(store_edit.without(prop, every)) + _joins(store_edit.among(prop, every, "id"))


def test_deleted_and_asked_ids_broadcast_nothing(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    other = spark.createDataFrame([(2,), (None,), (7,)], "id long")
    got = store_edit.intersect_then_union(ids, other, spark.createDataFrame([(9,), (2,)], "id long"))
    assert "Broadcast" not in _joins(got)
    assert sorted((r.id for r in got.collect()), key=str) == [2, 9, None]
    prop = _nested_properties(spark)
    store = {n: spark.createDataFrame([], tables.table_schema(n)) for n in city.STORE_TABLES}
    left, back = store_edit.delete_properties({**store, "property": prop}, prop.where("id % 3 = 1").select("id"))
    assert "Broadcast" not in _joins(back) + _joins(left["property"])
    assert sorted(r.id for r in left["property"].select("id").collect()) == list(range(2, 3000, 3))
    assert sorted(r.id for r in back.collect()) == list(range(1, 3000, 3))


def test_documents_are_read_by_line_where_they_can(spark, tmp_path):
    one = '{"type":"Feature","geometry":{"type":"Point","coordinates":[%d, 2.5]},"properties":{"ID":%d,"NAME":"a ] } , %d"}}'
    rows = [one % (i, i, i) for i in range(5)]
    texts = {
        "framed": '{"type":"FeatureCollection","features":[\n' + "\n,".join(rows) + "\n]}\n",
        "apart": '{\n"type": "FeatureCollection",\n"name": "x",\n"features": [\n' + ",\n".join(rows) + "\n]\n}\n",
        "one line": '{"type":"FeatureCollection","features":[' + ",".join(rows) + "]}",
        "two a line": '{"type":"FeatureCollection","features":[\n' + ",".join(rows[:2]) + ",\n" + ",\n".join(rows[2:]) + "\n]}",
        "other array": '{"type":"FeatureCollection","old":[\n' + rows[0] + '\n],"features":[\n' + ",\n".join(rows) + "\n]}",
        "other inside": '{"type":"FeatureCollection","features":[\n' + ",\n".join(rows) + '],"old":[' + rows[0] + "\n]}",
        "pretty": '{"type":"FeatureCollection",\n"features":[\n' + ",\n".join(rows).replace('"properties"', '\n"properties"') + "\n]}",
    }
    split = []
    for name, text in texts.items():
        path = tmp_path / name.replace(" ", "_")
        path.write_text(text)
        got = vector.read_feature_collection(spark, str(path), "ID bigint, NAME string", srid=3879, target=None)
        assert sorted((r.id, r.name, r.x) for r in got.select("id", "name", F.col("bbox.xmin").alias("x")).collect()) == [
            (i, f"a ] }} , {i}", float(i)) for i in range(5)
        ], name
        if "Scan json" not in _joins(got) and "FileScan json" not in _joins(got):
            split.append(name)
    assert split == ["framed", "apart"]


def test_a_table_in_one_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    parcels = city.relation(spark, str(tmp_path), "parcels")
    assert parcels.rdd.getNumPartitions() == 8
    assert parcels.count() == parcels.distinct().count() == 20_000


def test_rounding_agrees_with_written_digits_near_halves_and_for_large_or_odd_values(spark):
    rows = spark.range(4000).select(F.explode(F.array(
        (F.col("id") * 2 + 1) / 2000.0, (F.col("id") - 2000) / 8.0, (F.col("id") * 2 + 1) / 200.0 * (1 + (F.rand(3) - 0.5) * 4e-15),
        (F.rand(4) - 0.5) * F.pow(F.lit(10.0), F.rand(5) * 24 - 4),
    )).alias("v"))
    odd = [float("nan"), float("inf"), -float("inf"), None, -0.0, 1e-300, 0.005, -0.005, 1.005, 0.12499999999999999, 999999.995, 99999999.5, 1e19, 1e25]
    rows = rows.union(spark.createDataFrame([(v,) for v in odd], "v double"))
    for digits in (0, 2, 4):
        written = F.round(F.format_string("%.14e", "v").try_cast("decimal(38,18)"), digits).cast("double")
        assert rows.where(~round_numeric("v", digits).eqNullSafe(written)).count() == 0


def test_boxes_are_compiled_without_lambdas(spark):
    df = spark.range(3).select(G.st_rectangle(F.col("id").cast("double"), 1.0, 9.0, 4.0, 2.0).alias("geom"))
    box = df.select(G.st_bbox("geom").alias("b"))
    assert "lambda" not in box._jdf.queryExecution().analyzed().toString()
    assert [tuple(r.b) for r in box.collect()] == [(float(i), 1.0, 2.0, 9.0, 4.0, 2.0) for i in range(3)]


def test_parts_are_dealt_and_written_once_for_all_that_reads_buildings(spark, tmp_path, monkeypatch):
    rows = [*[(k, f"type {k % 3}", k % 50) for k in [*range(40), 7]], (None, None, None)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    dealt = []
    monkeypatch.setattr(city, "spread", lambda df: dealt.append(df) or df.repartition(3))
    got = city.relation(spark, str(tmp_path), "properties")
    city.relation(spark, str(tmp_path), "addresses")
    assert len(dealt) == 1 and "RoundRobin" not in got._jdf.queryExecution().toString()
    plain = spark.sql(city.RELATIONS["buildings"], part=city.table(spark, str(tmp_path), "part"))
    now = city.relation(spark, str(tmp_path), "buildings")
    assert sorted(map(str, now.collect())) == sorted(map(str, plain.collect()))


def test_shadows_go_through_cells_as_boxes_only(spark, monkeypatch):
    rect = lambda x0, y0, x1, y1: G.st_rectangle(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])
    base = spark.createDataFrame([(1, 12.0), (2, 30.0), (2, 30.0), (None, 20.0)], "gid long, height_m double").select(
        "gid", F.lit("B").alias("building_gml_id"), "height_m", F.lit("alto").alias("height_category"), rect(0, 0, 10, 10).alias("geom"),
    ).withColumn("bbox", G.st_bbox("geom"))
    greens = spark.createDataFrame([(7, 20.0), (8, 60.0)], "id long, y double").select("id", G.st_rectangle(F.lit(0.0), F.col("y"), F.lit(40.0), F.col("y") + 9).alias("geom"))
    joined, join = [], shadow.bbox_join
    monkeypatch.setattr(shadow, "bbox_join", lambda a, *rest: joined.append(a.columns) or join(a, *rest))
    got = shadow.shadow_on_green(base, greens.withColumn("bbox", G.st_bbox("geom"))).collect()
    assert joined == [["_row", "_sbox"]]
    # rows with the same number or none each cast their own shadow
    assert sorted((r.building_gid or 0, r.green_id, r.shadow_on_green_m2) for r in got) == sorted((g, n, 90.0) for g in (1, 2, 2, 0) for n in (7, 8))


def test_names_of_all_properties_are_read_only_for_properties_with_a_parent(spark, monkeypatch):
    prop = spark.createDataFrame([(1, None, "a", 1), (2, 1, "a", 1), (3, None, "b", 1), (4, 3, "c", 1), (2, 1, "a", 1)], "id long, parent_id long, name string, namespace_id int")
    looked, named = [], store_edit._named_as_parent
    monkeypatch.setattr(store_edit, "_named_as_parent", lambda *a: looked.append(1) or named(*a))

    def closure(*ids):
        rows, cascaded = store_edit._property_closure(prop, spark.createDataFrame([(i,) for i in ids], "id long"))
        return sorted(r.id for r in rows.distinct().collect()), sorted(r.id for r in cascaded.collect())

    assert closure(3) == ([3, 4], []) and not looked
    assert closure(2) == ([1, 2], [2]) and len(looked) == 1
    assert closure(4) == ([4], [])
