from lithoflow.streaming import enrich


def test_points_arriving_as_files(spark, tmp_path):
    rows = [(1, 35.6, 139.4, "2024-05-01 00:01:00"), (2, 0.0, 0.0, "2024-05-01 00:02:00"), (3, 35.5, 139.5, "2024-05-01 01:00:00")]
    df = spark.createDataFrame(rows, "point_id long, lat double, lon double, at string").selectExpr("point_id", "lat", "lon", "cast(at as timestamp) as at")
    df.write.parquet(str(tmp_path / "in"))
    boxes = spark.createDataFrame([("08062", 139.25, 35.5, 139.5, 35.666667), ("08063", 139.5, 35.5, 139.75, 35.666667)], "shape_id string, lon_min double, lat_min double, lon_max double, lat_max double")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    enrich.write(enrich.in_boxes(stream, boxes), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {(r.point_id, r.shape_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "08062"), (3, "08062"), (3, "08063")}
    assert enrich.counts_per_window(df.withColumnRenamed("point_id", "shape_id"), "at", "1 hour", "2 hours").count() == 3
