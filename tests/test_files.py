"""Sources, sinks and the build on files made here."""

import csv
import json
import sqlite3
import struct
import zlib

from pyspark.sql import functions as F

from lithoflow import cli, config
from lithoflow.config import Config, Sheet
from lithoflow.operators import assets
from lithoflow.plans import pipeline, views
from lithoflow.sinks import files, reports
from lithoflow.sources import pdf, shapefile


def shp(shapes, kind=5):
    body = b""
    for k, rings in enumerate(shapes):
        if rings is None:
            rec = struct.pack("<i", 0)
        else:
            pts = [p for r in rings for p in r]
            starts, n = [], 0
            for r in rings:
                starts.append(n)
                n += len(r)
            rec = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", k + 1, len(rec) // 2) + rec
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body


def dbf(fields, rows, enc):
    head = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([size, dec]) + b"\0" * 14 for n, t, size, dec in fields) + b"\r"
    size = 1 + sum(f[2] for f in fields)
    recs = b""
    for flag, row in rows:
        recs += flag.encode() + b"".join(v.encode(enc).ljust(f[2])[: f[2]] for v, f in zip(row, fields))
    return struct.pack("<B3BIHH20x", 3, 1, 1, 1, len(rows), 32 + len(head), size) + head + recs + b"\x1a"


SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
HOLE = [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4), (0.2, 0.2)]
FIELDS = [("MAJOR_CODE", "N", 6, 0), ("LEGEND01", "C", 20, 0), ("LEGEND02", "C", 20, 0), ("LEGEND03", "C", 30, 0), ("LEGEND04", "C", 30, 0), ("OK", "L", 1, 0), ("AREA", "N", 8, 2)]


def sheet_files(folder, enc="cp932", cpg="932"):
    rows = [(" ", ["12", "完新世", "", "沖積層", "砂", "T", "1.50"]), ("*", ["0", "後期更新世", "", "立川ローム層", "火山灰", "?", "x"]), (" ", ["7", "", "", "", "", "F", ""])]
    (folder / "a.shp").write_bytes(shp([[SQUARE, HOLE], None, [SQUARE]]) + b"\0\0")
    (folder / "a.dbf").write_bytes(dbf(FIELDS, rows, enc))
    (folder / "a.prj").write_text('GEOGCS["GCS_JGD_2000"]')
    if cpg:
        (folder / "a.cpg").write_text(cpg)


def test_shapefile_source(spark, tmp_path):
    for enc, cpg in (("cp932", "932"), ("utf-8", "UTF-8"), ("utf-8", None)):
        sheet_files(tmp_path, enc, cpg)
        got = pipeline.read_shapes(spark, str(tmp_path)).orderBy("shape_index").collect()
        assert [r.shape_type for r in got] == [5, 0, 5] and got[0].crs == "EPSG:4612" and got[1].deleted
        assert got[0].attributes["LEGEND03"] == "沖積層" and got[0].attributes["MAJOR_CODE"] == "12" and got[0].attributes["OK"] == "true"
        assert got[1].attributes["AREA"] is None and got[1].attributes["OK"] is None and got[2].attributes["AREA"] is None
        assert got[0].field_types["LEGEND03"] == "C" and got[0].field_types["MAJOR_CODE"] == "N"
        assert len(got[0].rings) == 2 and got[0].rings[0][1] == (0.0, 1.0) and got[1].rings == []
    spark.dataSource.register(shapefile.ShapefileSource)
    (tmp_path / "b.shp").write_bytes((tmp_path / "a.shp").read_bytes())
    own = spark.read.format("shapefile").load(str(tmp_path))
    bare = own.where("source_file = 'b.shp'").orderBy("shape_index").collect()
    assert [(r.shape_type, r.attributes, len(r.rings)) for r in bare] == [(5, {}, 2), (0, {}, 0), (5, {}, 1)] and own.count() == 6
    assert pipeline.read_shapes(spark, str(tmp_path), ["b.shp"]).count() == 3 and pipeline.read_shapes(spark, str(tmp_path)).count() == 6
    assert shapefile.crs_of("TOKYO") == "UNKNOWN" and shapefile.crs_of("GCS_Tokyo") == "EPSG:4301"
    assert shapefile.crs_of(None) == "UNKNOWN" and [f[0] for f in shapefile.read_fields((tmp_path / "a.dbf").read_bytes())][:2] == ["MAJOR_CODE", "LEGEND01"]


def test_build(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    sheet_files(raw)
    conf = Config(str(raw), str(out), (Sheet("08062", "Sheet", "図", "a.shp", "gsj_1984"),))
    # this profile reads LEGEND04 as a name and LEGEND05 as lithology; the other one fits the file
    conf = Config(str(raw), str(out), (Sheet("08062", "Sheet", "図", "a.shp", "gsj_1982"),))
    counts = pipeline.build(spark, conf)
    assert counts["geology_features"] == 2 and counts["cards"] == 2 and counts["manual_review"] == 1
    with open(out / "geotech_features.csv", encoding="utf-8-sig") as f:
        rows = {r["feature_id"]: r for r in csv.DictReader(f)}
    assert rows["08062_A_0000"]["engineering_ground_type"] == "alluvial_lowland_deposits" and rows["08062_A_0000"]["needs_manual_review"] == "False"
    assert rows["08062_A_0002"]["source_region"] == "08062" and rows["08062_A_0002"]["interpretation_confidence"] == "very_low"
    cards = json.loads((out / "inference_chains.json").read_text("utf-8"))
    assert len(cards) == 2 and len(cards[0]["chain"]) == 4
    assert cards[0]["chain"][0]["inputs"]["raw_unit_name_ja"] == "沖積層" and cards[0]["source_evidence"]["raw_attributes"]["source_region"] == "08062" and cards[0]["chain"][3]["outputs"]["applications"] == {}
    assert (out / "geology_unit_cards.csv").read_text("utf-8-sig").splitlines()[0].endswith("risk_flags,needs_manual_review,geology_chain")
    db = sqlite3.connect(out / "features.gpkg")
    blob = db.execute("select geom from geotech_features order by feature_id").fetchone()[0]
    assert blob[:2] == b"GP" and struct.unpack("<i", blob[4:8])[0] == 4612 and blob[8:13] == struct.pack("<BI", 1, 6)
    assert struct.unpack("<I", blob[13:17])[0] == 1 and struct.unpack("<I", blob[22:26])[0] == 2  # one polygon, a hole
    assert db.execute("select min_x, max_y from gpkg_contents").fetchall() == [(0.0, 1.0)] * 2 and db.execute("pragma user_version").fetchone()[0] == 10200
    assert {r[0] for r in db.execute("select srs_id from gpkg_spatial_ref_sys")} == {-1, 0, 4326, 4612}
    lite = sqlite3.connect(out / "features.sqlite")
    assert lite.execute("select count(*) from geology_unit_cards").fetchone()[0] == 2
    attributes = json.loads(lite.execute("select source_attribute_json from geotech_features where feature_id = '08062_A_0000'").fetchone()[0])
    assert attributes["MAJOR_CODE"] == 12 and attributes["OK"] is True and attributes["AREA"] == 1.5 and attributes["LEGEND03"] == "沖積層"
    b = spark.read.parquet(f"{out}/boundaries")
    assert b.first().nominal_quadrangle.lat_max == 1.0 and views.sheet_overview(b).first().longitude == "0.000–1.000"
    again = pipeline.boundaries_of(spark, str(out / "region_boundaries.yaml"), b).first()
    assert again.region == "08062" and again.nominal_quadrangle.lat_max == 1.0 and again.n_polygons == 2
    shown = views.chain_rows(spark.read.parquet(f"{out}/cards"), "ja").where("shown = 0").collect()
    assert {r.step for r in shown} == {"L4_considerations"} and {r.badge for r in shown} == {"🟡"}


def test_text_zero_is_a_value(spark):
    from lithoflow.operators import normalize

    rows = [("a.shp", 0, [[(0.0, 0.0)]], {"Symbol": "0", "MAJOR_CODE": "7"}, {"Symbol": "C", "MAJOR_CODE": "N"}, "x"), ("a.shp", 1, [[(0.0, 0.0)]], {"Symbol": "0", "MAJOR_CODE": "7"}, {"Symbol": "N", "MAJOR_CODE": "N"}, "x"), ("a.shp", 2, [[(0.0, 0.0)]], {}, {}, "x")]
    shapes = spark.createDataFrame(rows, "source_file string, shape_index int, rings array<array<struct<lon:double,lat:double>>>, attributes map<string,string>, field_types map<string,string>, crs string")
    got = normalize.normalize(shapes, normalize.sheet_table(spark, [Sheet("1", "e", "j", "a.shp", "gsj_1984")])).orderBy("shape_index").collect()
    assert [r.raw_unit_code for r in got] == ["0", "7", ""] and json.loads(got[0].source_attribute_json) == {"Symbol": "0", "MAJOR_CODE": 7} and got[2].source_attribute_json == "{}"


def picture(codec, width, height, payload):
    return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /Filter /%s >>\nstream\n%s\nendstream\n" % (width, height, codec, payload)


def test_pdf(spark, tmp_path):
    jpg = lambda k: b"\xff\xd8\xff" + bytes([k]) * 7000
    text = zlib.compress(b"BT (Hello \\(x\\)) Tj <3042> Tj ET" + b"BT (" + b"a" * 250 + b") ET")
    data = b"%PDF\n/Type /Page \n" + picture(b"DCTDecode", 400, 200, jpg(1)) + b"/Type /Page\n" + picture(b"DCTDecode", 300, 300, jpg(2) + b"zz") + picture(b"DCTDecode", 300, 300, jpg(1)) + picture(b"DCTDecode", 100, 300, jpg(3)) + picture(b"JPXDecode", 300, 900, b"\xff\x4f\xff\x51" + b"j" * 50000) + picture(b"DCTDecode", 300, 300, b"no") + b"stream\n" + text + b"\nendstream /JBIG2Decode /Type /Pages"
    (tmp_path / "08062_x.pdf").write_bytes(data)
    (tmp_path / "08063_empty.pdf").write_bytes(b"%PDF")
    files_ = pdf.read_files(spark, str(tmp_path))
    got = assets.asset_index(pdf.extract_pictures(files_), F.regexp_extract("source_pdf", "^([0-9]+)", 1)).orderBy("asset_id").collect()
    assert [(r.asset_id, r.format, r.page_estimate) for r in got] == [("08062_fig_000", "jp2", 2), ("08062_fig_001", "jpg", 2), ("08062_fig_002", "jpg", 1)]
    assert got[0].content_type_guess.startswith("portrait") and got[2].content_type_guess.startswith("wide")
    texts = {r.source_pdf: r for r in assets.text_index(pdf.extract_texts(files_)).collect()}
    assert texts["08062_x.pdf"].readable and texts["08062_x.pdf"].text_sample.startswith("Hello (x)あ") and texts["08062_x.pdf"].pages_est == 2
    assert not texts["08063_empty.pdf"].readable
    kept = assets.asset_index(pdf.extract_pictures(files_), F.regexp_extract("source_pdf", "^([0-9]+)", 1))
    written = {r.asset_id: r.file for r in assets.write_pictures(kept, str(tmp_path / "pics")).collect()}
    assert written["08062_fig_000"] == "08062/08062_fig_000.jp2" and (tmp_path / "pics" / written["08062_fig_001"]).read_bytes()[:3] == b"\xff\xd8\xff"
    assert assets.preview_count(assets.previews(kept)).first()[0] == 0  # these are no real pictures
    (tmp_path / "labels.csv").write_text("asset_id,content_label,caption\n08062_fig_001,photo,\"a, b\"\n08062_fig_001,map,c\n", "utf-8")
    tables = pipeline.figure_tables(spark, Config("", "", pdf=str(tmp_path), labels=str(tmp_path / "labels.csv")))
    assert {r.asset_id: r.content_label for r in tables["figures"].collect()}["08062_fig_001"] == "map"
    assert tables["pdf_scans"].where("jbig2_scanned = 1").count() == 1 and "Labelled: 1 of 3." in reports.clustering(tables["figures"], tables["pdf_texts"], tables["pdf_scans"])


def test_last_label_wins(spark):
    a = spark.createDataFrame([("x",), ("y",)], "asset_id string")
    labels = spark.createDataFrame([("x", "old", "c1", 1), ("x", "new", "c, 2", 2), (None, "n", "", 3)], "asset_id string, content_label string, caption string, line_no long")
    got = {r.asset_id: (r.content_label, r.label_status) for r in assets.labelled(a, labels).collect()}
    assert got == {"x": ("new", "ai_curated"), "y": ("", "pending_ai_or_manual")}


def test_single_files_of_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "a string, b array<string>, c boolean")
    assert files.write_csv_file(df, str(tmp_path / "e.csv")) == 0 and (tmp_path / "e.csv").read_text("utf-8-sig").strip() == "a,b,c"
    assert files.write_json_file(df, str(tmp_path / "e.json")) == 0 and json.loads((tmp_path / "e.json").read_text()) == []
    assert files.write_sqlite(str(tmp_path / "e.db"), {"t": df}) == {"t": 0}
    one = spark.createDataFrame([("あ", ["x"], True), (None, None, None)], df.schema)
    files.write_csv_file(one, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text("utf-8-sig").splitlines()[1:] == ['あ,"[""x""]",True', ",,"]


def test_a_report_has_all_rows(spark):
    text = files.markdown(spark.range(2536).orderBy("id"), "Sheets")
    assert text.splitlines()[4:] == [f"| {k} |" for k in range(2536)]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "find_spec", lambda name: None)
    assert cli.main(["app"]) == 1
    capsys.readouterr()

    def interrupt(*args, **kwargs):
        raise KeyboardInterrupt

    monkeypatch.setattr(cli, "find_spec", lambda name: object())
    monkeypatch.setattr(cli.subprocess, "run", interrupt)
    assert cli.main(["app"]) == 130 and capsys.readouterr() == ("", "")
    assert cli.main(["query", str(tmp_path / "nothing"), "35.5", "139.5"]) == 1 and "not found" in capsys.readouterr().err
    d = "/root/testdata/sf0.001"
    assert cli.main(["query", d, "0", "0", "--max-chars", "9"]) == 0 and len(capsys.readouterr().out.strip("\n")) == 9
    raw = tmp_path / "raw"
    raw.mkdir()
    sheet_files(raw)
    (tmp_path / "sheets.json").write_text(json.dumps([{"region": "08062", "name_en": "S", "name_ja": "図", "file": "a.shp", "profile": "gsj_1982"}]))
    assert cli.main(["build", "--raw", str(raw), "--out", str(tmp_path / "out"), "--sheets", str(tmp_path / "sheets.json")]) == 0
    assert json.loads(capsys.readouterr().out)["cards"] == 2
    monkeypatch.setattr(cli, "build", interrupt)
    assert cli.main(["build"]) == 130
    assert config.from_env({"LITHOFLOW_ROOT": "/x", "LITHOFLOW_KNOWLEDGE": "l1=a.csv"}, ()).knowledge == {"l1": "/x/knowledge/a.csv"} and len(config.from_env({}).sheets) == 3
