"""Commands: ``python -m lithoflow.cli build | query FOLDER LAT LON | app``.

Exit codes: 0 done, 1 a file or library is missing, 2 wrong arguments, 130 interrupted (without output).
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from dataclasses import replace
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lithoflow import config
from lithoflow.operators import point_query, proximity
from lithoflow.plans import pipeline
from lithoflow.session import table

RAW = ("raw_unit_code", "raw_unit_name_ja", "raw_unit_name_en", "raw_lithology", "raw_age")


def query(spark: SparkSession, folder: str, lat: float, lon: float) -> dict:
    """The answer for one point over the tables of a folder, with the card and chain of its feature."""
    point = spark.createDataFrame([(0, lat, lon)], "point_id long, lat double, lon double")
    boxes = proximity.rectangles(table(spark, folder, "region_boundaries"), "region", "nominal_quadrangle")
    own = table(spark, folder, "geology_features").select(F.col("feature_id").alias("shape_id"), F.col("geom").alias("rings"), F.col("feature_id").alias("shape_order"), "source_region", *RAW)
    found = point_query.answer(point, boxes, own)
    links = table(spark, folder, "geotech_features").select(F.col("feature_id").alias("shape_id"), "engineering_ground_type", "geotech_term_ja", "geotech_term_en", "interpretation_confidence", "geology_unit_card_id")
    cards = table(spark, folder, "inference_chains").select("geology_unit_card_id", "chain", "risk_flags", "source_evidence")
    row = point_query.with_cards(found, links, cards).first()
    return row.asDict(recursive=True) if row else {}


def build(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    conf = config.from_env()
    named = {k: v for k, v in (("raw", args.raw), ("out", args.out), ("pdf", args.pdf), ("labels", args.labels)) if v}
    known = dict(x.split("=", 1) for x in args.knowledge)
    if args.sheets:
        rows = json.loads(Path(args.sheets).read_text("utf-8"))
        named["sheets"] = tuple(config.Sheet(**{k: tuple(v) if k == "pdfs" else v for k, v in r.items()}) for r in rows)
    return pipeline.build(spark, replace(conf, **named, knowledge={**conf.knowledge, **known}))


def app() -> int:
    """Show the built tables in the viewer, if its library is there."""
    if find_spec("streamlit") is None:
        print("streamlit is not installed", file=sys.stderr)
        return 1
    try:
        return subprocess.run([sys.executable, "-m", "streamlit", "run", str(Path(__file__).resolve().parent / "viewer.py")]).returncode
    except KeyboardInterrupt:
        return 130


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lithoflow")
    sub = top.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build", help="read the raw sheets and write all tables")
    for name in ("raw", "out", "pdf", "labels", "sheets"):
        b.add_argument(f"--{name}")
    b.add_argument("--knowledge", nargs="*", default=[], metavar="ROLE=FILE")
    q = sub.add_parser("query", help="the unit and its chain at a point")
    q.add_argument("folder")
    q.add_argument("lat", type=float)
    q.add_argument("lon", type=float)
    q.add_argument("--max-chars", type=int, default=None, help="cut the JSON text to so many characters")
    sub.add_parser("app", help="show the built tables")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.what == "app":
        return app()
    try:
        spark = SparkSession.builder.getOrCreate()
        done = build(spark, args) if args.what == "build" else query(spark, args.folder, args.lat, args.lon)
    except KeyboardInterrupt:
        return 130
    except FileNotFoundError as e:
        print(f"not found: {e.filename or e}", file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"not found: {getattr(args, 'folder', None) or args.raw or config.from_env().raw}", file=sys.stderr)
        return 1
    text = json.dumps(done, ensure_ascii=False, indent=2, default=str)
    print(text if getattr(args, "max_chars", None) is None else text[: args.max_chars])
    return 0


if __name__ == "__main__":
    sys.exit(main())
