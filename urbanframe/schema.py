"""Fixed schemas of the city store tables and of the geometry column type.

A geometry is one struct: srid, kind and parts > rings > points. The same type
holds points, lines, polygons and 3D surfaces, survives shuffles and Parquet,
and lets measures be plain column expressions. Rings are closed (first point
repeated at the end); inside a part the first ring is the shell, the others
are holes.
"""

from __future__ import annotations

from pyspark.sql import types as T

POINT_DDL = "struct<x:double,y:double,z:double>"
PARTS_DDL = f"array<array<array<{POINT_DDL}>>>"
GEOMETRY_DDL = f"struct<srid:int,kind:string,parts:{PARTS_DDL}>"
BBOX_DDL = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"

WGS84 = 4326
METRIC = 3879

_G = GEOMETRY_DDL

# Table layouts of the city store (fixed column names and types).
_TABLE_DDL = {
    "address": "id long, objectid string, identifier string, identifier_codespace string, "
    "street string, house_number string, po_box string, zip_code string, city string, "
    "state string, country string, free_text string, "
    f"multi_point {_G}, content string, content_mime_type string",
    "ade": "id int, name string, description string, version string",
    "appear_to_surface_data": "id long, appearance_id long, surface_data_id long",
    "appearance": "id long, objectid string, identifier string, identifier_codespace string, "
    "theme string, is_global int, feature_id long, implicit_geometry_id long",
    "codelist": "id long, codelist_type string, url string, mime_type string",
    "codelist_entry": "id long, codelist_id long, code string, definition string",
    "database_srs": "srid int, srs_name string",
    "datatype": "id int, supertype_id int, typename string, is_abstract int, ade_id int, "
    "namespace_id int, schema string",
    "feature": "id long, objectclass_id int, objectid string, identifier string, "
    f"identifier_codespace string, envelope {_G}, last_modification_date timestamp, "
    "updating_person string, reason_for_update string, lineage string, "
    "creation_date timestamp, termination_date timestamp, valid_from timestamp, valid_to timestamp",
    "geometry_data": f"id long, geometry {_G}, implicit_geometry {_G}, "
    "geometry_properties string, feature_id long",
    "implicit_geometry": "id long, objectid string, mime_type string, mime_type_codespace string, "
    "reference_to_library string, library_object binary, relative_geometry_id long",
    "namespace": "id int, alias string, namespace string, ade_id int",
    "objectclass": "id int, superclass_id int, classname string, is_abstract int, "
    "is_toplevel int, ade_id int, namespace_id int, schema string",
    "property": "id long, feature_id long, parent_id long, datatype_id int, namespace_id int, "
    "name string, val_int long, val_double double, val_string string, val_timestamp timestamp, "
    "val_uri string, val_codespace string, val_uom string, val_array string, val_lod string, "
    f"val_geometry_id long, val_implicitgeom_id long, val_implicitgeom_refpoint {_G}, "
    "val_appearance_id long, val_address_id long, val_feature_id long, val_relation_type int, "
    "val_content string, val_content_mime_type string",
    "surface_data": "id long, objectid string, identifier string, identifier_codespace string, "
    "is_front int, objectclass_id int, x3d_shininess double, x3d_transparency double, "
    "x3d_ambient_intensity double, x3d_specular_color string, x3d_diffuse_color string, "
    "x3d_emissive_color string, x3d_is_smooth int, tex_image_id long, tex_texture_type string, "
    f"tex_wrap_mode string, tex_border_color string, gt_orientation string, gt_reference_point {_G}",
    "surface_data_mapping": "surface_data_id long, geometry_data_id long, material_mapping string, "
    "texture_mapping string, world_to_texture_mapping string, georeferenced_texture_mapping string",
    "tex_image": "id long, image_uri string, image_data binary, mime_type string, "
    "mime_type_codespace string",
}

# Tables that survive a store cleanup (fixed list).
DICTIONARY_TABLES = (
    "ade", "datatype", "database_srs", "codelist", "codelist_entry", "namespace", "objectclass",
)

FEATURE_CHANGELOG_DDL = (
    "feature_id long, objectclass_id int, objectid string, identifier string, "
    f"identifier_codespace string, envelope {_G}, transaction_type string, "
    "transaction_date timestamp, db_user string, reason_for_update string"
)


def table_names() -> list[str]:
    return sorted(_TABLE_DDL)


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_TABLE_DDL[name])


def data_tables() -> list[str]:
    return [t for t in table_names() if t not in DICTIONARY_TABLES]
