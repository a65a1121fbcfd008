"""Polygon shapefiles with their attribute tables.

``read_folder(spark, path)`` reads them from any file system Spark knows, as binary files joined by their
name.  ``ShapefileSource`` is a Python data source for a folder all executors see: ``spark.dataSource
.register(ShapefileSource)``, then ``spark.read.format("shapefile").load("/folder or /file.shp")``; each file
is one input partition.  To open only some files, name them in ``read_folder`` (a pushed filter would stay
in the reader when the frame is used again).

Rows: source_file, shape_index (position in the file, null shapes included), shape_type, rings, attributes
(text by field name, null where blank or unreadable), field_types (the letter of each field's type),
deleted, crs.

Defined results: geometry stops at a truncated record; without a ``.dbf`` shapes have empty attributes; with
attribute and geometry files of different lengths the shorter decides; Z and M values are skipped;
files without content have no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_file string, shape_index int, shape_type int, rings array<array<struct<lon:double,lat:double>>>, attributes map<string,string>, field_types map<string,string>, deleted boolean, crs string"
POLYLINES = (3, 5, 13, 15)
POINTS = (1, 11)


def read_shapes(data: bytes) -> Iterator[tuple[int, list]]:
    """(type, rings) of each record of a .shp file."""
    at = 100
    while at + 12 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body, end = at + 8, at + 8 + 2 * words
        if words < 2 or end > len(data):
            return
        (kind,) = struct.unpack_from("<i", data, body)
        rings: list = []
        if kind in POINTS:
            rings = [[struct.unpack_from("<2d", data, body + 4)]]
        elif kind in POLYLINES:
            n_parts, n_points = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, body + 44), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", data, body + 44 + 4 * n_parts)
            rings = [[(flat[2 * k], flat[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:])]
        yield kind, rings
        at = end


#: The encodings that are tried in turn where no file names one.
GUESSES = ("utf-8", "shift_jis", "cp932")


def code_page(cpg: str | None) -> str | None:
    """The encoding a .cpg file names; None where every field is to be tried."""
    name = (cpg or "").strip().lower()
    if "utf" in name:
        return "utf-8"
    return "shift_jis" if any(x in name for x in ("932", "shift", "sjis")) else None


def decode(raw: bytes, enc: str | None) -> str:
    if enc:
        return raw.decode(enc, "replace")
    for guess in GUESSES:
        try:
            return raw.decode(guess)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def field_value(raw: bytes, kind: str, decimals: int, enc: str | None) -> str | None:
    text = decode(raw, enc).replace("\x00", "").strip()
    if kind in "NF":
        try:
            number = float(text) if "." in text or decimals else int(text)
        except ValueError:
            return None
        return str(number)
    if kind == "L":
        return {"Y": "true", "T": "true", "N": "false", "F": "false"}.get(text[:1].upper())
    return text


def read_fields(data: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, length, decimals) from the header of a .dbf file."""
    out, at = [], 32
    while at + 32 <= len(data) and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\x00", 1)[0]
        out.append((decode(name, None).strip(), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return out


def read_records(data: bytes, enc: str | None) -> Iterator[tuple[bool, dict[str, str | None]]]:
    """(deleted, values) of each record of a .dbf file, up to its end mark."""
    if len(data) < 32:
        return
    count, header, size = struct.unpack_from("<IHH", data, 4)
    fields = read_fields(data)
    for k in range(count):
        at = header + k * size
        if at >= len(data) or data[at] == 0x1A:
            return
        row, pos = {}, at + 1
        for name, kind, length, decimals in fields:
            row[name] = field_value(data[pos : pos + length], kind, decimals, enc)
            pos += length
        yield data[at] == 0x2A, row


#: What a projection's text holds (all of it), by the coordinate system it means; the first counts.
CRS = ((("JGD2000",), "EPSG:4612"), (("JGD_2000",), "EPSG:4612"), (("JGD2011",), "EPSG:6668"), (("JGD_2011",), "EPSG:6668"), (("WGS_1984",), "EPSG:4326"), (("WGS84",), "EPSG:4326"), (("TOKYO", "GCS"), "EPSG:4301"))


def crs_of(prj: str | None) -> str:
    text = (prj or "").upper()
    return next((code for marks, code in CRS if all(m in text for m in marks)), "UNKNOWN")


def rows_of(name: str, shp: bytes, dbf: bytes | None, cpg: bytes | None, prj: bytes | None) -> Iterator[tuple]:
    """The rows of one shapefile from the contents of its files."""
    enc = code_page(cpg.decode("ascii", "ignore") if cpg else None)
    crs = crs_of(prj.decode("utf-8", "ignore") if prj else None)
    types = {f[0]: f[1] for f in read_fields(dbf)} if dbf else {}
    records: Iterable = read_records(dbf, enc) if dbf else repeat((False, {}))
    for k, ((kind, rings), (deleted, row)) in enumerate(zip(read_shapes(shp), records)):
        yield (name, k, kind, [[{"lon": x, "lat": y} for x, y in r] for r in rings], row, types, deleted, crs)


def read_folder(spark: SparkSession, path: str, files: Sequence[str] | None = None) -> DataFrame:
    """The shapes of all shapefiles below a path, or of the files named; only these are opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,dbf,cpg,prj,SHP,DBF,CPG,PRJ}").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    found = found.withColumns({"stem": F.regexp_replace("path", r"\.[A-Za-z]+$", ""), "ext": ext})
    if files is not None:
        stems = sorted({f.rpartition(".")[0] if f.lower().endswith(".shp") else f for f in files})
        found = found.where(F.element_at(F.split("stem", "/"), -1).isin(stems))
    shp = found.where("ext = 'shp'").select("stem", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("shp"))
    for side in ("dbf", "cpg", "prj"):
        shp = shp.join(found.where(F.col("ext") == side).groupBy("stem").agg(F.max("content").alias(side)), "stem", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, *contents in b[["name", "shp", "dbf", "cpg", "prj"]].itertuples(index=False):
                own = [None if c is None else bytes(c) for c in contents]
                rows = list(rows_of(name, own[0] or b"", *own[1:]))
                yield pd.DataFrame(rows, columns=["source_file", "shape_index", "shape_type", "rings", "attributes", "field_types", "deleted", "crs"])

    return shp.mapInPandas(run, SCHEMA)


@dataclass
class File(InputPartition):
    path: str


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file:")

    def partitions(self) -> list[File]:
        p = Path(self.path)
        files = sorted(p.rglob("*.shp")) if p.is_dir() else [p]
        return [File(str(f)) for f in files]

    def read(self, partition: File) -> Iterator[tuple]:
        shp = Path(partition.path)

        def side(ext: str) -> bytes | None:
            return next((f.read_bytes() for f in (shp.with_suffix(ext), shp.with_suffix(ext.upper())) if f.exists()), None)

        yield from rows_of(shp.name, shp.read_bytes(), side(".dbf"), side(".cpg"), side(".prj"))


class ShapefileSource(DataSource):
    """Options: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:  # noqa: ANN001
        return ShapefileReader(self.options["path"])
