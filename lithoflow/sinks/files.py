"""Writers: CSV and JSON as Spark writes them, and single files (CSV with byte order mark, indented
JSON, SQLite, GeoPackage) fed by an iterator over partitions, so the driver holds one at a time."""

from __future__ import annotations

import csv
import json
import os
import shutil
import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)


def flat(df: DataFrame, columns: list[str] | None = None, nulls: str | None = "") -> DataFrame:
    """The columns as text: nested ones as JSON, booleans as they are named, nulls as ``nulls``."""
    out = []
    for f in df.select(*(columns or df.columns)).schema.fields:
        c = F.to_json(f.name) if isinstance(f.dataType, NESTED) else F.initcap(F.col(f.name).cast("string")) if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast("string")
        out.append((F.coalesce(c, F.lit(nulls)) if nulls is not None else c).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    flat(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def rows_of(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator(prefetchPartitions=True)


def write_csv_file(df: DataFrame, path: str, columns: list[str] | None = None) -> int:
    """One file with a byte order mark; an empty table still has its header."""
    text, n = flat(df, columns), 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(text.columns)
        for n, row in enumerate(rows_of(text), 1):
            w.writerow(row)
    return n


def opened(v: Any, members: tuple[str, ...], within: bool = False) -> Any:
    """A value in which JSON texts below the named members are what they say."""
    if isinstance(v, dict):
        return {k: opened(x, members, within or k in members) for k, x in v.items()}
    if isinstance(v, list):
        return [opened(x, members, within) for x in v]
    if within and isinstance(v, str) and v[:1] in ("{", "["):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def write_json_file(df: DataFrame, path: str, nested: tuple[str, ...] = ()) -> int:
    """One indented array; characters beyond ASCII stay as they are.  ``nested``: members below which texts
    that hold JSON are written as what they say."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, row in enumerate(rows_of(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))), 1):
            f.write(("," if n > 1 else "") + "\n" + json.dumps(opened(json.loads(row.j), nested), ensure_ascii=False, indent=2))
        f.write("\n]\n")
    return n


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def batches(rows: Iterator[Row], size: int = 1000) -> Iterator[list[tuple]]:
    out: list[tuple] = []
    for r in rows:
        out.append(tuple(r))
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def publish(build: str, path: str) -> None:
    """The finished file to its place, whatever was there, without the journals of an older one."""
    for old in (f"{path}-journal", f"{path}-wal", f"{path}-shm"):
        if os.path.exists(old):
            os.remove(old)
    shutil.copyfile(build, f"{path}.part")
    os.replace(f"{path}.part", path)


def write_sqlite(path: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """A database with a table of text columns for each frame; empty ones have their columns too."""
    done = {}
    with tempfile.TemporaryDirectory() as tmp:
        db = sqlite3.connect(f"{tmp}/build.sqlite")
        for name, df in tables.items():
            text = flat(df, nulls=None)
            db.execute(f"CREATE TABLE {quoted(name)} ({', '.join(f'{quoted(c)} TEXT' for c in text.columns)})")
            for b in batches(rows_of(text)):
                db.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * len(text.columns))})", b)
            done[name] = db.execute(f"SELECT count(*) FROM {quoted(name)}").fetchone()[0]
        db.commit()
        db.close()
        publish(f"{tmp}/build.sqlite", path)
    return done


def closed(ring: list) -> list[tuple[float, float]]:
    points = [(float(v["lon"]), float(v["lat"])) for v in ring]
    return points if not points or points[0] == points[-1] else [*points, points[0]]


def wkb_multipolygon(polygons: list) -> bytes:
    """Little-endian WKB of array<polygon>, a polygon being an array of rings."""
    out = [struct.pack("<BII", 1, 6, len(polygons))]
    for rings in polygons:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in map(closed, rings):
            out.append(struct.pack("<I", len(ring)))
            out += [struct.pack("<2d", x, y) for x, y in ring]
    return b"".join(out)


def gpkg_blob(wkb: bytes, srs_id: int) -> bytes:
    """The GeoPackage header without envelope, then the WKB."""
    return b"GP" + struct.pack("<BBi", 0, 1, srs_id) + wkb


def gpkg_column(polygons: Column, srs_id: int) -> Column:
    """The blob of each shape, encoded on the executors in Arrow batches."""

    @F.pandas_udf("binary")
    def encode(shapes: pd.Series) -> pd.Series:
        return pd.Series([gpkg_blob(wkb_multipolygon([] if s is None else s), srs_id) for s in shapes])

    return encode(polygons)


#: The tables a GeoPackage must have.
GPKG_TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""


#: Fixed value: the definition of the geographic system a GeoPackage must list.
WGS84 = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def sql_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return "INTEGER"
    return "REAL" if isinstance(kind, (T.FractionalType, T.DecimalType)) else "TEXT"


def write_gpkg(path: str, layers: dict[str, DataFrame], geom: str = "rings", srs_id: int = 4612, srs_wkt: str = "undefined") -> dict[str, int]:
    """Layers of multipolygons: each frame has a column of rings, the others are attributes."""
    from lithoflow.functions.geometry import bbox, polygons

    done = {}
    with tempfile.TemporaryDirectory() as tmp:
        db = sqlite3.connect(f"{tmp}/build.gpkg")
        db.executescript(GPKG_TABLES)
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("PRAGMA user_version = 10200")
        srs = [("Undefined cartesian", -1, "NONE", -1, "undefined", None), ("Undefined geographic", 0, "NONE", 0, "undefined", None), ("WGS 84 geodetic", 4326, "EPSG", 4326, WGS84, None)]
        srs += [(f"EPSG:{srs_id}", srs_id, "EPSG", srs_id, srs_wkt, None)] if srs_id not in (-1, 0, 4326) else []
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?,?,?,?,?,?)", srs)
        for name, df in layers.items():
            names = [f.name for f in df.schema.fields if f.name != geom]
            kinds = {f.name: f.dataType for f in df.schema.fields}
            db.execute(f"CREATE TABLE {quoted(name)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{''.join(f', {quoted(c)} {sql_type(kinds[c])}' for c in names)})")
            shown = [F.to_json(c).alias(c) if isinstance(kinds[c], NESTED) else F.col(c).cast("int").alias(c) if isinstance(kinds[c], T.BooleanType) else F.col(c).cast("string").alias(c) if sql_type(kinds[c]) == "TEXT" else F.col(c) for c in names]
            rows = df.select(gpkg_column(polygons(F.col(geom)), srs_id).alias("_geom"), *shown)
            for b in batches(rows_of(rows)):
                db.executemany(f"INSERT INTO {quoted(name)} (geom{''.join(f', {quoted(c)}' for c in names)}) VALUES (?{', ?' * len(names)})", b)
            box = df.select(bbox(F.col(geom)).alias("b")).agg(F.min("b.lon_min"), F.min("b.lat_min"), F.max("b.lon_max"), F.max("b.lat_max")).first()
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?,'features',?,?,?,?,?,?)", (name, name, *box, srs_id))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?,'geom','MULTIPOLYGON',?,0,0)", (name, srs_id))
            done[name] = db.execute(f"SELECT count(*) FROM {quoted(name)}").fetchone()[0]
        db.commit()
        db.close()
        publish(f"{tmp}/build.gpkg", path)
    return done


def markdown(df: DataFrame, title: str) -> str:
    """A table of all rows for a report."""
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in df.toLocalIterator()]
    return "\n".join(lines) + "\n"
