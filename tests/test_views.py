from pyspark.sql import functions as F

from lithoflow.functions import geometry as G
from lithoflow.plans import views


def test_layers_counts_and_labels(spark):
    f = spark.createDataFrame([("a", "soft", "1"), ("b", "soft", "2"), ("c", "hard", "3"), ("d", None, "4"), ("e", " ", "5")], "feature_id string, engineering_ground_type string, x string")
    assert [r[0] for r in views.ground_types(f).collect()] == ["hard", "soft"]
    assert [tuple(r) for r in views.type_counts(f).collect()][0] == ("soft", 2)
    assert views.ground_layer(f, ["soft"]).count() == 2 and views.ground_layer(f).count() == 5
    labels = spark.createDataFrame([("soft", "ja", "軟"), ("hard", "ja", "硬"), ("soft", "en", "Soft")], "code string, lang string, label string")
    assert [r[0] for r in views.codes_of(labels, "ja", ["軟"]).collect()] == ["soft"] and views.codes_of(labels, "en", ["軟"]).count() == 0
    cards = spark.createDataFrame([("k", "08062", "n", "c", "soft", True)], "geology_unit_card_id string, source_region string, raw_unit_name_ja string, raw_unit_code string, engineering_ground_type string, needs_manual_review boolean")
    assert views.unit_labels(cards).first().label == "08062 · n (c) → soft" and views.review_list(cards).count() == 1


def test_figures(spark):
    rows = [("a1", "08062", "map", "x, y", "wide", b"1"), ("a2", "08063", "", None, "photo", None), ("a3", "08062", None, "", "photo", b"")]
    a = spark.createDataFrame(rows, "asset_id string, source_region string, content_label string, caption string, content_type_guess string, preview_png binary")
    assert [r.shown_caption for r in views.figures(a).collect()] == ["map — x, y", "photo", "photo"]
    assert views.figures(a, region="08062").count() == 2 and views.figures(a, label="map").count() == 1 and views.figures(a, label="(all)").count() == 3 and views.figures(a, pattern="^MA").count() == 1
    assert [r[0] for r in views.label_choices(a).collect()] == ["(all)", "map"] and [r.asset_id for r in views.with_preview(a).collect()] == ["a1"]


def test_badges_and_shape_kinds(spark):
    df = spark.createDataFrame([("high", 5), ("low", 13), (None, 1)], "c string, t int")
    got = df.select(views.badge(F.col("c")), G.is_polygon(F.col("t")), G.is_line(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("🟢", True, False), ("🟠", False, True), ("⚪", False, False)]
