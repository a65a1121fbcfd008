"""Points near other points, and the regions that hold a point.

Near pairs: a grid whose rows are strips of latitude and whose cells are a little wider than the
distance at the strip's narrow edge.  Each point has one home cell and is sent, besides, to the cells
its circle touches; an equi-join on the cell gives the candidates and the great-circle distance
decides.  Columns wrap at the date line, and strips at the poles shrink to a single cell.

Regions: adaptive polygon coverage.  A shape is covered with cells of a power-of-two grid, refined
where its boundary runs.  Cells wholly inside are accepted by the equi-join alone; only matches on
boundary cells get the exact test.

Defined results: points with a null, NaN or impossible coordinate are no locations and match nothing;
repeated rows count once; null, empty and degenerate shapes hold nothing; empty tables give no rows.
Crowded cells are split by the adaptive skew join (both joins are inner equi-joins).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.geometry import haversine_m
from lithoflow.session import cut

RADIUS_M = 6371008.8


def locations(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(point_id, lat, lon) of the possible coordinates, each row once."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lon")
    return df.select(F.col(key).alias("point_id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where(ok & F.col("point_id").isNotNull()).distinct()


def near_pairs(points: DataFrame, metres: float, cell_factor: float = 2.0) -> DataFrame:
    """(a, b) with a < b: all pairs of point ids at most ``metres`` apart on the sphere."""
    cell = metres * cell_factor
    step = math.degrees(cell / RADIUS_M)  # height of a strip
    reach = math.degrees(metres / RADIUS_M) * (1 + 1e-9) + 1e-12

    def columns(row: Column) -> Column:  # cells of a strip: at least `cell` wide at its narrow edge
        edge = F.least(F.greatest(F.abs(row * step), F.abs((row + 1) * step)), F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(2 * math.pi * RADIUS_M * F.cos(F.radians(edge)) / cell)).cast("long")

    def column(lon: Column, n: Column) -> Column:
        return F.floor((lon + 180.0) / 360.0 * n).cast("long")

    row = F.floor(F.col("lat") / step).cast("long")
    home = points.select(F.col("point_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), row.alias("row"))
    home = home.withColumn("n", columns(F.col("row")))
    home = home.select("b", "lat2", "lon2", "row", F.pmod(column(F.col("lon2"), F.col("n")), F.col("n")).alias("col"))
    probe = points.select(
        F.col("point_id").alias("a"),
        F.col("lat").alias("lat1"),
        F.col("lon").alias("lon1"),
        F.explode(F.sequence(F.floor((F.col("lat") - reach) / step).cast("long"), F.floor((F.col("lat") + reach) / step).cast("long"))).alias("row"),
    ).withColumn("n", columns(F.col("row")))
    # the circle's half width in longitude; all columns where it holds a pole
    ratio = math.sin(math.radians(reach)) / F.cos(F.radians("lat1"))
    wide = F.when((F.abs("lat1") + reach < 90) & (ratio < 1), F.degrees(F.asin(ratio)) + 1e-12).otherwise(180.0)
    low, high = column(F.col("lon1") - wide, F.col("n")), column(F.col("lon1") + wide, F.col("n"))
    probe = probe.withColumn("raw", F.explode(F.sequence(low, F.least(high, low + F.col("n") - 1))))
    probe = probe.select("a", "lat1", "lon1", "row", F.pmod("raw", F.col("n")).alias("col"))
    near = haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), RADIUS_M) <= metres
    return probe.join(home, ["row", "col"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_spots(points: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near pairs (a, b) of spots, and the spot of every point (point_id, spot).  A spot is
    the points of exactly one place, named after its smallest id, so a crowded place gives one spot and no
    pairs within; every pair of points is two members of one spot or of two near ones."""
    spots = points.groupBy("lat", "lon").agg(F.min("point_id").alias("spot"))
    members = points.join(spots, ["lat", "lon"]).select("point_id", "spot")
    return near_pairs(spots.select(F.col("spot").alias("point_id"), "lat", "lon"), metres), members


def rectangles(df: DataFrame, key: str, box: str) -> DataFrame:
    """(shape_id, lon_min, lat_min, lon_max, lat_max) of the boxes without nulls, each row once."""
    cols = ("lon_min", "lat_min", "lon_max", "lat_max")
    return df.select(F.col(key).alias("shape_id"), *[F.col(f"{box}.{c}").alias(c) for c in cols]).dropna().distinct()


def in_rectangles(points: DataFrame, boxes: DataFrame, cell_deg: float = 1 / 16) -> DataFrame:
    """(point_id, shape_id): points in a box, edges included.

    The coverage of a box by cells needs no refining: cells strictly between the first and the last
    row and column are inside, the rest is compared with the edges.  Boxes spanning many cells are
    covered by coarser ones: the cell doubles until a side has at most 16 of them.
    """
    span = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span / (16 * cell_deg), F.lit(1e-12))))).cast("int")
    ij = lambda c, size: F.floor(c / size).cast("long")
    boxes = boxes.withColumn("level", level).withColumn("size", F.lit(cell_deg) * F.pow(F.lit(2.0), F.col("level")))
    boxes = boxes.where((F.col("lon_min") <= F.col("lon_max")) & (F.col("lat_min") <= F.col("lat_max")))
    cells = boxes.withColumn("i", F.explode(F.sequence(ij(F.col("lon_min"), F.col("size")), ij(F.col("lon_max"), F.col("size")))))
    cells = cells.withColumn("j", F.explode(F.sequence(ij(F.col("lat_min"), F.col("size")), ij(F.col("lat_max"), F.col("size")))))
    inside = (F.col("i") * F.col("size") >= F.col("lon_min")) & ((F.col("i") + 1) * F.col("size") <= F.col("lon_max")) & (F.col("j") * F.col("size") >= F.col("lat_min")) & ((F.col("j") + 1) * F.col("size") <= F.col("lat_max"))
    cells = cells.withColumn("inside", inside)
    levels = [r[0] for r in boxes.select("level").distinct().collect()]  # at most log2 of the globe's cells
    if not levels:
        levels = [0]
    spots = points.withColumn("level", F.explode(F.array(*[F.lit(x).cast("int") for x in sorted(levels)]))).withColumn("size", F.lit(cell_deg) * F.pow(F.lit(2.0), F.col("level")))
    spots = spots.select("point_id", "lat", "lon", "level", ij(F.col("lon"), F.col("size")).alias("i"), ij(F.col("lat"), F.col("size")).alias("j"))
    exact = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
    return spots.join(cells, ["level", "i", "j"]).where(F.col("inside") | exact).select("point_id", "shape_id").distinct()


# --- shapes ---------------------------------------------------------------------------------------

#: Finest and coarsest grid of the coverage: cells of 360 / 2^level degrees, refined two levels at a time.
FINEST, COARSEST, LEVEL_STEP = 20, 6, 2
#: Pairs of a cell and an edge that are compared at once.
PAIRS = 4_000_000


def last_level(rings: Column) -> Column:
    """The level of a shape's boundary cells: its extent is 4 to 16 of them, where FINEST allows."""
    vertices = F.flatten(rings)
    side = [F.array_max(F.transform(vertices, lambda v: v[k])) - F.array_min(F.transform(vertices, lambda v: v[k])) for k in ("lon", "lat")]  # noqa: B023
    level = F.ceil(F.log2(360.0 / F.greatest(*side, F.lit(1e-9)))) + 2
    level = F.least(F.lit(FINEST), F.greatest(F.lit(COARSEST), level))
    return (level - (level - COARSEST) % LEVEL_STEP).cast("int")


def flat_edges(geom: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) edges x1, y1, x2, y2 of all shapes of a batch, and the shape each belongs to.  Rings are
    closed; vertices with a missing coordinate are left out, as are rings of under three vertices."""
    rings = geom.flatten()
    shape_of_ring = np.repeat(np.arange(len(geom)), pc.fill_null(pc.list_value_length(geom), 0).to_numpy(zero_copy_only=False))
    points = rings.flatten()
    ring = np.repeat(np.arange(len(rings)), pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False))
    x, y = (pc.struct_field(points, k).to_numpy(zero_copy_only=False).astype(float) for k in ("lon", "lat"))
    ok = np.isfinite(x) & np.isfinite(y)
    x, y, ring = x[ok], y[ok], ring[ok]
    n = np.bincount(ring, minlength=len(rings)) if len(rings) else np.zeros(0, int)
    ok = (n > 2)[ring] if len(ring) else np.zeros(0, bool)
    x, y, ring = x[ok], y[ok], ring[ok]
    if not len(ring):
        return np.empty((0, 4)), np.empty(0, int)
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
    nxt = np.arange(1, len(ring) + 1)
    nxt[np.r_[first[1:], len(ring)] - 1] = first  # the last vertex of a ring goes back to its first
    return np.column_stack([x, y, x[nxt], y[nxt]]), shape_of_ring[ring]


def by_cell(cells: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For cells (their shapes): in blocks, the pairs (cell within the block, edge)."""
    n = count[cells]
    cut = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS))
    at = 0
    for end in np.unique(np.minimum(cut + 1, len(cells))):
        m = n[at:end]
        who = np.repeat(np.arange(end - at), m)
        edge = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[cells[at:end]], m)
        yield slice(at, end), who, edge
        at = end


def cover(e: np.ndarray, shape: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """The cells of the shapes with edges e: arrays shape, level, i, j, inside."""
    n = len(last)
    count = np.bincount(shape, minlength=n)
    start = np.r_[0, np.cumsum(count)[:-1]]
    lo, hi = np.full((2, n), np.inf), np.full((2, n), -np.inf)
    for k in range(2):
        np.minimum.at(lo[k], shape, np.minimum(e[:, k], e[:, k + 2]))
        np.maximum.at(hi[k], shape, np.maximum(e[:, k], e[:, k + 2]))
    first = np.maximum(last - LEVEL_STEP, COARSEST)
    out = []
    own = i = j = np.empty(0, int)
    for level in range(COARSEST, FINEST + 1, LEVEL_STEP):
        size = 360.0 / 2**level
        new = np.flatnonzero((first == level) & (count > 0))
        i0, i1, j0, j1 = (np.floor(a[new] / size).astype(int) for a in (lo[0], hi[0], lo[1], hi[1]))
        w, m = i1 - i0 + 1, (i1 - i0 + 1) * (j1 - j0 + 1)
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        own = np.r_[own, np.repeat(new, m)]
        i, j = np.r_[i, np.repeat(i0, m) + at % np.repeat(w, m)], np.r_[j, np.repeat(j0, m) + at // np.repeat(w, m)]
        if not len(own):
            continue
        touch, odd = np.zeros(len(own), bool), np.zeros(len(own), bool)
        slack = size * 1e-6 + 1e-12  # cells count as a little larger than they are, so no edge is missed
        for block, who, edge in by_cell(own, start, count):
            x1, y1, x2, y2 = e[edge].T
            lx, ly = i[block][who] * size - slack, j[block][who] * size - slack
            hx, hy = lx + size + 2 * slack, ly + size + 2 * slack
            near = (np.minimum(x1, x2) <= hx) & (np.maximum(x1, x2) >= lx) & (np.minimum(y1, y2) <= hy) & (np.maximum(y1, y2) >= ly)
            side = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (lx, hx) for cy in (ly, hy)]
            near &= (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)
            touch[block] = np.bincount(who, near, block.stop - block.start) > 0
            cx, cy = lx + size / 2 + slack, ly + size / 2 + slack
            with np.errstate(divide="ignore", invalid="ignore"):
                crosses = ((y1 > cy) != (y2 > cy)) & (cx < (x2 - x1) * (cy - y1) / (y2 - y1) + x1)
            odd[block] = np.bincount(who, crosses, block.stop - block.start) % 2 == 1
        done = ~touch & odd
        rest = touch & (last[own] <= level)
        for keep, held in ((done, True), (rest, False)):
            out.append((own[keep], np.full(keep.sum(), level), i[keep], j[keep], np.full(keep.sum(), held)))
        more = touch & (last[own] > level)
        f = 2**LEVEL_STEP
        a, b = np.tile(np.arange(f), f), np.repeat(np.arange(f), f)
        own, i, j = np.repeat(own[more], f * f), (i[more][:, None] * f + a).ravel(), (j[more][:, None] * f + b).ravel()
        fine = size / f
        keep = ((i + 1) * fine >= lo[0][own]) & (i * fine <= hi[0][own]) & ((j + 1) * fine >= lo[1][own]) & (j * fine <= hi[1][own])
        own, i, j = own[keep], i[keep], j[keep]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, t) for t in (int, int, int, int, bool))


def coverage(shapes: DataFrame) -> DataFrame:
    """(shape_id, level, i, j, inside): the cells of every shape of (shape_id, rings, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, shape = flat_edges(b.column("rings"))
            own, level, i, j, held = cover(e, shape, b.column("last").to_numpy(zero_copy_only=False))
            order = np.argsort(own, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [b.column("shape_id").take(pa.array(own[order])), pa.array(level[order], pa.int32()), pa.array(i[order], pa.int64()), pa.array(j[order], pa.int64()), pa.array(held[order], pa.bool_())],
                names=["shape_id", "level", "i", "j", "inside"],
            )

    kind = shapes.schema["shape_id"].dataType.simpleString()
    return shapes.select("shape_id", "rings", "last").mapInArrow(run, f"shape_id {kind}, level int, i long, j long, inside boolean")


def holds(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd test of a point against array<array<struct<lon,lat>>>; open rings close themselves."""

    def crossings(ring: Column) -> Column:
        def crosses(p: Column, q: Column) -> Column:
            over = (p["lat"] > lat) != (q["lat"] > lat)
            return F.when(over & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]), 1).otherwise(0)

        shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.aggregate(F.zip_with(ring, shifted, crosses), F.lit(0), lambda a, x: a + x)

    full = F.filter(F.transform(rings, lambda r: F.filter(r, lambda v: v["lon"].isNotNull() & v["lat"].isNotNull())), lambda r: F.size(r) > 2)
    return F.aggregate(F.transform(full, crossings), F.lit(0), lambda a, x: a + x) % 2 == 1


def in_shapes(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(point_id, shape_id): points in a shape of (shape_id, rings).

    Only cell numbers and ids go through the first join; the rings are joined to the candidates of
    boundary cells afterwards, so no shape is copied to each of its cells.  Shapes do not cross the
    date line (one that does is given as two rings).
    """
    shapes = shapes.where(F.col("shape_id").isNotNull() & (F.size("rings") > 0)).withColumn("last", last_level(F.col("rings"))).where(F.col("last").isNotNull())
    lasts = [r[0] for r in shapes.select("last").distinct().collect()]  # at most one for each level
    levels = sorted({max(x - k, COARSEST) for x in lasts for k in (0, LEVEL_STEP)}) or [COARSEST]
    cells = coverage(shapes)
    ij = lambda c, level: F.floor(c / (360.0 / F.pow(F.lit(2.0), level))).cast("long")
    spots = points.withColumn("level", F.explode(F.array(*[F.lit(x).cast("int") for x in levels])))
    spots = spots.select("point_id", "lat", "lon", "level", ij(F.col("lon"), F.col("level")).alias("i"), ij(F.col("lat"), F.col("level")).alias("j"))
    hits = spots.join(cells, ["level", "i", "j"]).select("point_id", "shape_id", "lat", "lon", "inside")
    hits = cut(hits)  # used twice, and small beside the cells
    exact = hits.where(~F.col("inside")).distinct().join(shapes.select("shape_id", "rings"), "shape_id").where(holds(F.col("lon"), F.col("lat"), F.col("rings")))
    return hits.where("inside").select("point_id", "shape_id").unionByName(exact.select("point_id", "shape_id")).distinct()
