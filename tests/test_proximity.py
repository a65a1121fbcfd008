import math
import random

from pyspark.sql import functions as F

from lithoflow.functions import geometry as G
from lithoflow.operators import point_query
from lithoflow.operators import proximity as P


def points(spark, rows):
    return P.locations(spark.createDataFrame(rows, "id long, lat double, lon double, shape_id string"), "id", "lat", "lon")


def sphere(a, b):
    la, lo, lb, lob = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
    return 2 * P.RADIUS_M * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_equal_brute_force_also_at_date_line_and_poles(spark):
    rnd = random.Random(5)
    rows, k = [], 0
    for lat, lon in ((35.6, 139.7), (0.0, 0.0), (45.0, 179.99999), (-60.0, -180.0), (89.9999, 10.0), (-89.99995, -170.0)):
        for _ in range(40):
            x = lon + rnd.uniform(-3e-4, 3e-4) * (1 if abs(lat) < 80 else 1e6)
            rows.append((k, max(-90.0, min(90.0, lat + rnd.uniform(-2e-4, 2e-4))), (x + 180) % 360 - 180, "x"))
            k += 1
    rows += [(k, 35.6, 139.7, "x"), (k + 1, 35.6, 139.7, "x"), (k + 2, None, 1.0, "x"), (k + 3, 91.0, 1.0, "x"), (k + 4, 1.0, float("nan"), "x"), (k, 35.6, 139.7, "x"), (None, 35.6, 139.7, "x")]
    good = {r for r in rows if r[0] is not None and r[1] is not None and abs(r[1]) <= 90 and abs(r[2]) <= 180}
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and sphere(a, b) <= 12}
    assert {tuple(r) for r in P.near_pairs(points(spark, rows), 12.0).collect()} == want and len(want) > 100


def test_rectangles_include_edges_whatever_their_size(spark):
    boxes = P.rectangles(spark.createDataFrame([("a", (0.0, 0.0, 1.0, 1.0)), ("a", (0.0, 0.0, 1.0, 1.0)), ("w", (-170.0, -80.0, 170.0, 80.0)), ("p", (0.5, 0.5, 0.5, 0.5)), ("n", None)], "id string, b struct<lon_min:double,lat_min:double,lon_max:double,lat_max:double>"), "id", "b")
    got = {tuple(r) for r in P.in_rectangles(points(spark, [(1, 1.0, 1.0, ""), (2, 0.5, 0.5, ""), (3, 1.0000001, 1.0, ""), (4, 85.0, 0.0, "")]), boxes).collect()}
    assert got == {(1, "a"), (2, "a"), (2, "p"), (1, "w"), (2, "w"), (3, "w")}


RINGS = "shape_id string, rings array<array<struct<lon:double,lat:double>>>, shape_order int"


def square(x, y, s, close=True, back=False):
    x, y, s = float(x), float(y), float(s)
    p = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    p = p[::-1] if back else p
    return [*p, p[0]] if close else p


def test_shapes_equal_brute_force(spark):
    rnd = random.Random(1)
    shapes = [("donut", [square(0, 0, 3), square(1, 1, 1, back=True)], 0), ("open", [square(2, 2, 0.01, close=False)], 1), ("big", [[(9 * math.cos(t / 50), 9 * math.sin(t / 50) * (1 + 0.3 * math.sin(t / 5))) for t in range(314)]], 2), ("none", [], 3), ("null", None, 4), ("line", [[(0.0, 0.0), (1.0, 1.0)]], 5), (None, [square(0, 0, 1)], 6), ("tiny", [square(5, 5, 1e-6)], 7)]
    df = spark.createDataFrame(shapes, RINGS)
    pts = [(k, rnd.uniform(-11, 11), rnd.uniform(-11, 11), "") for k in range(400)] + [(400 + k, 2 + rnd.uniform(0, 0.01), 2 + rnd.uniform(0, 0.01), "") for k in range(50)] + [(500, 5 + 5e-7, 5 + 5e-7, "")]
    want = set()
    for k, lat, lon, _ in pts:
        for key, rings, _ in shapes:
            odd = False
            for r in rings or []:
                if len(r) > 2:
                    for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]]):
                        odd ^= (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
            if odd and key:
                want.add((k, key))
    got = {tuple(r) for r in P.in_shapes(points(spark, pts), df.select("shape_id", "rings")).collect()}
    assert got == want and {"donut", "open", "big", "tiny"} <= {s for _, s in got}
    first = {r.point_id: r.shape_id for r in point_query.first_shape(points(spark, pts), df, "shape_order").collect()}
    order = {s[0]: s[2] for s in shapes}
    assert all(first[k] == min((s for p, s in want if p == k), key=order.get) for k in first)


def test_empty_tables(spark):
    none = points(spark, [])
    assert P.near_pairs(none, 12.0).count() == 0
    assert P.in_shapes(none, spark.createDataFrame([], RINGS).select("shape_id", "rings")).count() == 0


def test_answer_messages(spark):
    boxes = spark.createDataFrame([("s", 0.0, 0.0, 5.0, 5.0)], "shape_id string, lon_min double, lat_min double, lon_max double, lat_max double")
    feats = spark.createDataFrame([("f", [square(0, 0, 1)], "f", "u")], "shape_id string, rings array<array<struct<lon:double,lat:double>>>, shape_order string, unit string")
    got = {r.point_id: r for r in point_query.answer(points(spark, [(1, 0.5, 0.5, ""), (2, 3.0, 3.0, ""), (3, 9.0, 9.0, "")]), boxes, feats).collect()}
    assert got[1].found and got[1].unit == "u" and abs(got[1].distance_m - 55596) < 10
    assert not got[2].found and "inside sheet s" in got[2].message and "outside" in got[3].message


def test_measures(spark):
    rings = [square(0.0, 0.0, 0.01), square(0.002, 0.002, 0.002, back=True)]
    df = spark.createDataFrame([("a", rings, 0), ("e", [], 0), ("n", None, 0)], RINGS)
    got = {r[0]: r for r in df.select("shape_id", G.polygon_area_m2(F.col("rings")), G.vertex_mean(F.col("rings")), G.polygons(F.col("rings")), G.distance_to_boundary_m(F.lit(0.005), F.lit(0.005), F.col("rings"))).collect()}
    side = 0.01 * math.pi / 180 * G.EARTH_M
    assert abs(got["a"][1] - side * side * (1 - 0.04)) < 1
    assert [len(p) for p in got["a"][3]] == [1, 1]  # a clockwise ring opens a polygon
    assert got["e"][1] == 0.0 and got["e"][2] == (0.0, 0.0) and got["e"][4] == float("inf") and got["n"][1] is None
    snapped = spark.range(1).select(G.snap(F.lit(139.246811), 0.25), G.snap(F.lit(35.669898), 1 / 6)).first()
    assert tuple(snapped) == (139.25, 35.666667)
    line = spark.range(1).select(G.sample_line(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.001), 50.0).alias("l")).first().l
    assert len(line) == 4 and line[-1].lon == 0.001


def test_spots_of_crowded_places(spark):
    rows = [(k, 35.0, 139.0) for k in range(2000)] + [(5000, 35.00005, 139.0), (6000, 35.001, 139.0)]
    points = spark.createDataFrame(rows, "point_id long, lat double, lon double")
    pairs, members = P.near_spots(points, 12.0)
    assert [tuple(r) for r in pairs.collect()] == [(0, 5000)]
    sizes = {r.spot: r["count"] for r in members.groupBy("spot").count().collect()}
    assert sizes == {0: 2000, 5000: 1, 6000: 1}
