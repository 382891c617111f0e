"""Lands tables as the files that utilities deliver, so that the jobs can be run on data that Spark has: containers of a
bounded number of rows, each made in a task and written by Spark."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrain.sources.staging import staging_path

#: Rows of a container.
CONTAINER_ROWS = 20_000


def _container(rows: pa.Table, epsg: Mapping[str, int], columns: Mapping[str, list[str]]) -> bytes:
    """A container with the layers of rows (layer, values of its columns, geometry)."""
    con = sqlite3.connect(":memory:")
    con.execute("create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text)")
    con.execute("create table gpkg_contents (table_name text primary key, data_type text, srs_id integer)")
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint)")
    for layer in pc.unique(rows["layer"]).to_pylist():
        own, code, names = rows.filter(pc.equal(rows["layer"], layer)), epsg.get(layer, 4674), columns[layer]
        con.execute("insert or ignore into gpkg_spatial_ref_sys values ('', ?, 'EPSG', ?, '')", (code, code))
        con.execute("insert into gpkg_contents values (?, 'features', ?)", (layer, code))
        con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, code))
        con.execute(f'create table "{layer}" (fid integer primary key, {", ".join(f"{n} text" for n in names)}, geom blob)')
        head = b"GP\x00\x01" + code.to_bytes(4, "little")
        con.executemany(f'insert into "{layer}" values (null{", ?" * (len(names) + 1)})', ((*v, None if g is None else head + g) for v, g in zip(own["values"].to_pylist(), own["geometry"].to_pylist(), strict=True)))
    con.commit()
    return con.serialize()


def write_containers(layers: Mapping[str, DataFrame], path: str, epsg: Mapping[str, int] | None = None) -> None:
    """layers (name to fields and a binary column geometry) as NAME.gpkg files below path."""
    spark, of, out = next(iter(layers.values())).sparkSession, dict(epsg or {}), None
    columns = {name: [c for c in df.columns if c != "geometry"] for name, df in layers.items()}
    for name, df in layers.items():
        values = F.array(*(F.col(c).cast("string") for c in columns[name]))
        rows = df.select(F.lit(name).alias("layer"), values.alias("values"), "geometry")
        out = rows if out is None else out.unionByName(rows)
    n = 1 + out.count() // CONTAINER_ROWS
    part = F.pmod(F.xxhash64("layer", "values"), F.lit(n)).cast("int").alias("part")

    def make(rows: pa.Table) -> pa.Table:
        return pa.table({"content": pa.array([_container(rows, of, columns)], pa.binary())})

    made = out.withColumn("part", part).groupBy("part").applyInArrow(make, "content binary")
    staged = staging_path(spark, "containers-made")
    made.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(staged)  # a line break at the end does no harm
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(path))
    for file in fs.listStatus(at(staged)):
        if file.getPath().getName().startswith("part-") and file.getLen():
            fs.rename(file.getPath(), at(f"{path}/{uuid.uuid4().hex}.gpkg"))
