"""GeoParquet layers: geometry column and CRS of each file from its footer, few scans, and a writer."""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crs import known_codes
from ..model import GEOMETRY
from ..operators.prepare import prepare, without_geometry
from ..operators.union import stack
from .readers import NOT_PARQUET, layer_listing, located, open_path

PLANS = "name string, columns string, primary_column string, crs string, error string"
#: Names of EPSG:4326 that need no projection.
PLAIN = ("", "OGC:CRS84", "EPSG:4326")


def spark_schema(file) -> str:
    """The schema Spark reads a parquet file with, as JSON; empty if only Spark can tell.

    Files that Spark wrote carry it. Otherwise it follows from the Arrow types; times in the old
    96-bit form are points in time, which their Arrow type doesn't say.
    """
    from pyarrow import parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    footer = pq.read_metadata(file)
    own = (footer.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if own:
        return own.decode()
    old = {footer.schema.column(k).path for k in range(len(footer.schema)) if footer.schema.column(k).physical_type == "INT96"}
    try:
        found = from_arrow_schema(footer.schema.to_arrow_schema().remove_metadata())
    except Exception:  # a type that Spark has no name for, which its reader may still read
        return ""
    fields = [T.StructField(f.name, T.TimestampType()) if f.name in old else f for f in found.fields]
    return T.StructType(fields).json()


def file_plans(spark: SparkSession, path) -> DataFrame:
    """``PLANS``: schema, geometry column and CRS of each parquet file, from the footers.

    A file without geometry has a null ``primary_column``; a CRS is null where the footer names none,
    ``unknown`` without an authority and code.
    """

    def plans(batches):
        from pyarrow import parquet as pq

        for batch in batches:
            rows = []
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict.fromkeys(["columns", "primary_column", "crs", "error"])
                try:
                    system, inner = open_path(name)
                    with system.open_input_file(inner) as file:
                        if not size or file.read_at(4, size - 4) != b"PAR1":
                            row["error"] = NOT_PARQUET
                        else:
                            row["columns"] = spark_schema(file)
                            meta = json.loads((pq.read_metadata(file).metadata or {}).get(b"geo", b"{}"))
                            row["primary_column"] = meta.get("primary_column")
                            about = (meta.get("columns") or {}).get(row["primary_column"], {})
                            row["crs"] = _crs_name(about.get("crs"))
                except (OSError, ValueError, KeyError, pa.ArrowInvalid) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append({"name": name, **row})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(c.split()[0], pa.string()) for c in PLANS.split(", ")])
    files = layer_listing(spark, path).select("name", "size")
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    return files.repartition(tasks, "name").mapInArrow(plans, PLANS)


def _crs_name(crs) -> str | None:
    if not isinstance(crs, dict):
        return crs
    ident = crs.get("id") or {}
    return f"{ident['authority']}:{ident['code']}" if {"authority", "code"} <= ident.keys() else "unknown"


def type_classes(schemas: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Schemas that one scan can read together: no column has two types among those of a class.

    Each class comes with the schema of all its columns; files that lack one read it as null.
    """
    classes: list[tuple[dict, list[str]]] = []
    for text in sorted(schemas):
        fields = {f.name.lower(): f for f in T.StructType.fromJson(json.loads(text)).fields}
        for held, members in classes:
            if all(held[n].dataType == f.dataType and held[n].name == f.name for n, f in fields.items() if n in held):
                held.update({n: f for n, f in fields.items() if n not in held})
                members.append(text)
                break
        else:
            classes.append((fields, [text]))
    return [
        (T.StructType([T.StructField(f.name, f.dataType) for f in held.values()]), members)
        for held, members in classes
    ]


def _projection(crs: str | None) -> str | None:
    """The code to project from, or None for none."""
    if crs is None or crs.upper() in PLAIN:
        return None
    code = crs.upper().removeprefix("EPSG:")
    if code not in {str(c) for c in known_codes()}:
        raise ValueError(f"No projection from {crs!r}")
    return code


def read_geoparquet(spark: SparkSession, path) -> DataFrame:
    """A folder of parquet files as one prepared layer, each file by its own footer.

    The geometry is the footer's primary column, area is taken in the file's CRS, bounds and geometry
    are in EPSG:4326; files without geometry are rows without it. Files are planned by geometry
    column and CRS, and within these by type class (``type_classes``), so the number of scans follows
    the CRSs and conflicting types, not the schemas. Files that are no parquet are passed over; a
    damaged footer, or a CRS that can't be projected, is an error that names it.
    """
    plans = file_plans(spark, path).groupBy("columns", "primary_column", "crs", "error").agg(
        F.collect_list("name").alias("names")  # the paths go into the scans
    )
    groups = defaultdict(dict)
    for r in plans.collect():
        if r["error"] not in (None, NOT_PARQUET):
            raise ValueError(f"{min(r['names'])}: {r['error']}")
        if r["error"] is None:
            key = r["primary_column"], None if r["primary_column"] is None else _projection(r["crs"])
            held = groups[key].setdefault(r["columns"], [])
            held += r["names"]
    if not groups:
        return without_geometry(located(spark.read.format("parquet"), path))
    layers = []
    for (primary, code), by_schema in sorted(groups.items(), key=lambda g: tuple(map(str, g[0]))):
        # A schema that only Spark can tell is a class of its own.
        scans = [(None, by_schema[""])] if "" in by_schema else []
        for schema, members in type_classes([s for s in by_schema if s]):
            scans.append((schema, [n for m in members for n in by_schema[m]]))
        for schema, names in scans:
            reader = spark.read.format("parquet").option("mergeSchema", False)
            if isinstance(path, str) and any("=" in n[len(path) :] for n in names):
                reader = reader.option("basePath", path)
            rows = located(reader if schema is None else reader.schema(schema), sorted(names))
            has = primary is not None and primary in rows.columns
            layers.append(prepare(rows, crs=code, geometry=primary) if has else without_geometry(rows))
    return stack(layers)


def write_geoparquet(
    df: DataFrame, path: str, crs: str | None = "EPSG:4326", geometry: str = GEOMETRY, row_group: int = 1 << 17
) -> DataFrame:
    """Write a table with a WKB column as GeoParquet, a file from each task; returns ``(name, n_rows)``.

    The footer names geometry column and CRS. Rows are written batch by batch, so a task holds one
    row group. ``path`` is a folder all tasks reach through ``pyarrow.fs``. Names carry the attempt;
    the table of written files is Spark's own, so files of a failed attempt are not in it and are
    removed when the attempt fails in its own process.
    """
    about = {"encoding": "WKB", "geometry_types": []}
    if crs is not None:
        authority, code = crs.split(":")
        about["crs"] = {"id": {"authority": authority, "code": int(code) if code.isdigit() else code}}
    geo = {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: about}}
    meta = {b"geo": json.dumps(geo).encode()}

    def run(batches):
        from pyarrow import parquet as pq

        system, inner = open_path(path)
        system.create_dir(inner, recursive=True)
        name, writer, rows = f"part-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch]).replace_schema_metadata(meta)
                if writer is None:
                    writer = pq.ParquetWriter(f"{inner}/{name}", table.schema, filesystem=system)
                writer.write_table(table, row_group_size=row_group)
                rows += batch.num_rows
        except BaseException:
            if writer is not None:
                writer.close()
                system.delete_file(f"{inner}/{name}")
            raise
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{path.rstrip('/')}/{name}"]), pa.array([rows], pa.int64())], names=["name", "n_rows"]
            )

    from ..session import materialise

    return materialise(df.mapInArrow(run, "name string, n_rows long"), "written")
