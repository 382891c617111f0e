"""Makes container files as other programs write them."""

import sqlite3
import struct


def wkb(kind, shape, order="<", z=False, extended=False):
    """A geometry of nested lists of (x, y), with a Z of 7 if wanted."""
    code = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}[kind]
    full = code | (0x80000000 if extended else 0) if z and extended else code + (1000 if z else 0)
    head = (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", full | (0x20000000 if extended else 0)) + (struct.pack(order + "I", 4674) if extended else b"")
    pt = lambda p: struct.pack(order + ("ddd" if z else "dd"), *p[:2], *([7.0] if z else []))
    ring = lambda r: struct.pack(order + "I", len(r)) + b"".join(map(pt, r))
    if kind == "Point":
        return head + pt(shape)
    if kind == "LineString":
        return head + ring(shape)
    if kind == "Polygon":
        return head + struct.pack(order + "I", len(shape)) + b"".join(map(ring, shape))
    return head + struct.pack(order + "I", len(shape)) + b"".join(wkb(kind.removeprefix("Multi"), s, order, z) for s in shape)


def blob(raw, srs=4674, envelope=0):
    """A geometry with the container's header."""
    return b"GP\x00" + bytes([1 | envelope << 1]) + struct.pack("<i", srs) + b"\x00" * (0, 32, 48, 48, 64)[envelope] + raw


def write_container(path, layers, epsg=None):
    """layers: name to (fields, rows, column of the geometry); rows end with the geometry's bytes."""
    con = sqlite3.connect(path)
    con.execute("create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text)")
    con.execute("create table gpkg_contents (table_name text primary key, data_type text, srs_id integer)")
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint)")
    for i, code in enumerate(sorted({4674, *(epsg or {}).values()})):
        con.execute("insert into gpkg_spatial_ref_sys values (?, ?, 'epsg', ?, '')", (str(code), 100 + i, code))
    srs = dict(con.execute("select organization_coordsys_id, srs_id from gpkg_spatial_ref_sys"))
    for name, (fields, rows, geometry) in layers.items():
        con.execute(f'create table "{name}" (fid integer primary key, {", ".join(f"{f} {kind}" for f, kind in fields)}, "{geometry}" blob)')
        con.executemany(f'insert into "{name}" values ({", ".join("?" * (len(fields) + 2))})', rows)
        code = srs[(epsg or {}).get(name, 4674)]
        con.execute("insert into gpkg_contents values (?, 'features', ?)", (name, code))
        con.execute("insert into gpkg_geometry_columns values (?, ?, 'GEOMETRY', ?, 0, 0)", (name, geometry, code))
    con.execute("insert into gpkg_contents values ('notes', 'attributes', null)")
    con.commit()
    con.close()
