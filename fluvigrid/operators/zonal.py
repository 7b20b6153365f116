"""Zonal operators: polygon-cell overlap, zonal statistics, point in polygon, dissolve, centroids.

Cells have unit size unless a grid says otherwise; column ``ix`` counts from the left and ``iy`` from the bottom.
Candidate cells of a polygon come from index arithmetic on its bounding box, so nothing is compared with cells that
it cannot touch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Grid

UNIT_GRID = Grid(0.0, 16.0, 0.0, 16.0, 16, 16)
RINGS = "array<array<struct<x:double,y:double>>>"


def _cells(polys: DataFrame, g: Grid) -> DataFrame:
    """``polys`` with one row per candidate cell: ``ix, iy`` and the cell's centre ``x, y``."""
    lo = lambda c, edge, res, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - edge) / res)))
    span = lambda a, b, edge, res, n: F.explode(F.sequence(lo(a, edge, res, n).cast("int"), lo(b, edge, res, n).cast("int")))
    touching = polys.where((F.col("xmax") > g.xmin) & (F.col("xmin") < g.xmax) & (F.col("ymax") > g.ymin) & (F.col("ymin") < g.ymax))
    out = touching.withColumn("ix", span("xmin", "xmax", g.xmin, g.resx, g.nx)).withColumn("iy", span("ymin", "ymax", g.ymin, g.resy, g.ny))
    return out.withColumn("x", F.lit(g.xmin) + (F.col("ix") + 0.5) * g.resx).withColumn("y", F.lit(g.ymin) + (F.col("iy") + 0.5) * g.resy)


def _overlap_table(weighed: DataFrame, g: Grid) -> DataFrame:
    """The overlap columns: polygon index and id, cell number from the upper left, centre, size, weight, weight_norm."""
    covered = weighed.where("weight > 0")
    cell = (F.lit(g.ny - 1) - F.col("iy")) * g.nx + F.col("ix") + 1
    total = F.sum("weight").over(Window.partitionBy("id"))
    return covered.select("id", "ix", "iy", cell.cast("int").alias("cell"), "x", "y", F.lit(g.resx * g.resy).alias("size"), "weight", (F.col("weight") / total).alias("weight_norm"))


def overlap_boxes(boxes: DataFrame, g: Grid = UNIT_GRID) -> DataFrame:
    """Overlap of axis-parallel boxes (id, xmin, xmax, ymin, ymax) with the grid; exact, as expressions."""
    side = lambda lo, hi, c, res: F.greatest(F.lit(0.0), F.least(F.col(hi), F.col(c) + res / 2) - F.greatest(F.col(lo), F.col(c) - res / 2))
    weight = side("xmin", "xmax", "x", g.resx) * side("ymin", "ymax", "y", g.resy) / (g.resx * g.resy)
    return _overlap_table(_cells(boxes, g).withColumn("weight", weight), g)


def clipped_area(ring: np.ndarray, x0: float, x1: float, y0: float, y1: float) -> float:
    """Area of a ring within a box: the box's four half-planes cut it one after another."""
    points = ring
    for axis, sign, edge in ((0, 1, x0), (0, -1, x1), (1, 1, y0), (1, -1, y1)):
        if len(points) == 0:
            return 0.0
        d = sign * (points[:, axis] - edge)
        kept = []
        for i in range(len(points)):
            a, b, da, db = points[i - 1], points[i], d[i - 1], d[i]
            if (da >= 0) != (db >= 0):
                kept.append(a + (b - a) * (da / (da - db)))
            if db >= 0:
                kept.append(b)
        points = np.array(kept).reshape(-1, 2)
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def bounding_box(rings: Column) -> list[Column]:
    """xmin, xmax, ymin, ymax of rings, as columns."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax")]


def mean_latitude(rings: Column) -> Column:
    _, _, lo, hi = bounding_box(rings)
    return (lo + hi) / 2


def overlap_polygons(polys: DataFrame, g: Grid = UNIT_GRID) -> DataFrame:
    """Overlap of polygons (id, rings; the first ring is the outline, others are holes). Weights are exact areas.

    Polygons smaller than a cell keep their share of it. Candidate cells are clipped in batches.
    """
    cells = _cells(polys.select("id", "rings", *bounding_box(F.col("rings"))), g)

    @F.pandas_udf("double")
    def share(rings: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for i, (own, cx, cy) in enumerate(zip(rings, x, y, strict=True)):
            areas = [clipped_area(np.array([(p["x"], p["y"]) for p in ring]), cx - g.resx / 2, cx + g.resx / 2, cy - g.resy / 2, cy + g.resy / 2) for ring in own]
            out[i] = max(0.0, areas[0] - sum(areas[1:])) / (g.resx * g.resy) if areas else 0.0
        return pd.Series(out)

    return _overlap_table(cells.withColumn("weight", share("rings", "x", "y")), g)


def zonal_statistics(cube: DataFrame, overlap: DataFrame, by: tuple[str, ...] = ("t",), normalized: bool = False) -> DataFrame:
    """Per polygon and step: min, max, mean = sum of weight x value (unnormalised by default), sum = mean x covered size.

    A missing cell makes the polygon's mean and sum null.
    """
    weight = F.col("weight_norm" if normalized else "weight")
    joined = cube.join(overlap, ["ix", "iy"])
    whole = F.count("v") == F.count(F.lit(1))
    out = joined.groupBy("id", *by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.when(whole, F.sum(F.col("v") * weight)).alias("mean"), F.sum("size").alias("_size"))
    return out.withColumn("sum", F.col("mean") * F.col("_size")).drop("_size")


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Ray casting over all rings: holes count as outside."""

    def crosses(ring: Column) -> Column:
        def hit(s: Column) -> Column:
            a, b = s["a"], s["b"]
            at = a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"])
            return ((a["y"] > y) != (b["y"] > y)) & (x < at)

        return F.size(F.filter(_ends(ring), lambda s: F.coalesce(hit(s), F.lit(False))))

    return F.aggregate(F.transform(rings, crosses), F.lit(0), lambda acc, n: acc + n) % 2 == 1


def locate(points: DataFrame, polys: DataFrame, cell: float = 4.0) -> DataFrame:
    """The polygon of each point (pid, x, y): polygons and points meet on coarse cells, then the ray decides.

    Points in no polygon have a null id. The polygons' boxes bound how many coarse cells they take.
    """
    boxed = polys.select("id", "rings", *bounding_box(F.col("rings")))
    tile = lambda c: F.floor(F.col(c) / cell).cast("int")
    spread = boxed.withColumn("cx", F.explode(F.sequence(tile("xmin"), tile("xmax")))).withColumn("cy", F.explode(F.sequence(tile("ymin"), tile("ymax"))))
    asked = points.withColumn("cx", tile("x")).withColumn("cy", tile("y"))
    hits = asked.join(spread, ["cx", "cy"]).where(inside(F.col("rings"), F.col("x"), F.col("y"))).groupBy("pid").agg(F.min("id").alias("id"))
    return points.join(hits, "pid", "left").select("pid", "x", "y", "id")


def box_rings(boxes: DataFrame) -> DataFrame:
    """Boxes as polygons."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"))
    return boxes.select("id", F.array(ring).alias("rings"))


def dissolve(overlap: DataFrame, groups: DataFrame) -> DataFrame:
    """The overlap of merged polygons: weights of a cell add up to at most 1. ``groups`` is (id, group)."""
    merged = overlap.join(groups, "id").groupBy("group", "ix", "iy", "cell", "x", "y", "size").agg(F.least(F.lit(1.0), F.sum("weight")).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("group"))
    return merged.withColumn("weight_norm", F.col("weight") / total).withColumnRenamed("group", "id")


def _ends(ring: Column) -> Column:
    """Edges (a, b) of a ring, the closing one included."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    """Area of a ring; negative where it runs clockwise."""
    return F.aggregate(_ends(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def ring_length(ring: Column) -> Column:
    return F.aggregate(_ends(ring), F.lit(0.0), lambda acc, s: acc + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def _loops(edges: list[tuple]) -> list[list[tuple]]:
    """Simple loops of directed edges (a, b), as many of which leave a point as reach it."""
    ahead: dict = {}
    for a, b in sorted(edges, reverse=True):
        ahead.setdefault(a, []).append(b)
    out = []
    for start in sorted(ahead):
        while ahead[start]:
            path, place, at = [start], {start: 0}, start
            while ahead[at]:
                at = ahead[at].pop()
                if at in place:
                    out.append(path[place[at] :])
                    for p in path[place[at] + 1 :]:
                        del place[p]
                    path = path[: place[at] + 1]
                else:
                    place[at] = len(path)
                    path.append(at)
    return out


def merged_outline(polys: DataFrame, groups: DataFrame) -> DataFrame:
    """``id, rings`` of merged polygons (id, rings; the first ring is the outline): polygons of a group (id, group) that
    tessellate an area, as catchments do, become its outlines and holes, the largest first; outlines run anticlockwise.

    Shared edges run both ways and cancel in an aggregation; a task chains what is left of one group, which is the
    polygon it returns. Borders have to share their points. Repeated points are dropped; repeated polygons count once.
    """
    turned = lambda ring, hole: F.when((signed_area(ring) > 0) == hole, F.reverse(ring)).otherwise(ring)
    ordered = F.transform("rings", lambda ring, i: turned(ring, i > 0))
    own = polys.join(groups, "id").dropDuplicates(["group", "id"])
    edges = own.select("group", F.explode(F.flatten(F.transform(ordered, _ends))).alias("e")).select("group", F.col("e.a").alias("a"), F.col("e.b").alias("b")).where("a <> b")
    forth = F.col("a") < F.col("b")
    net = edges.groupBy("group", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.sum(F.when(forth, 1).otherwise(-1)).alias("n")).where("n <> 0")
    left = net.select("group", *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "pq" for c in "xy"], "n")

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for px, py, qx, qy, n in frame[["px", "py", "qx", "qy", "n"]].itertuples(index=False):
            edges += [((px, py), (qx, qy)) if n > 0 else ((qx, qy), (px, py))] * abs(n)
        loops = _loops(edges)
        size = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)))
        rings = [[{"x": x, "y": y} for x, y in ring] for ring in sorted(loops, key=lambda ring: (-size(ring), ring))]
        return pd.DataFrame({"id": [frame["group"].iloc[0]], "rings": [rings]})

    id_type = dict(groups.dtypes)["group"]
    return left.groupBy("group").applyInPandas(chain, f"id {id_type}, rings {RINGS}")


def centroid(rings: Column) -> Column:
    """Centroid (x, y) of the outline."""
    ends = _ends(rings[0])
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    total = lambda f: F.aggregate(F.transform(ends, f), F.lit(0.0), lambda acc, v: acc + v)
    area = total(cross) * 3
    return F.struct((total(lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s)) / area).alias("x"), (total(lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s)) / area).alias("y"))


def height_under(polys_overlap: DataFrame, terrain: DataFrame) -> DataFrame:
    """Weighted mean of a single raster (ix, iy, v) under each polygon."""
    return terrain.join(polys_overlap, ["ix", "iy"]).groupBy("id").agg(F.sum(F.col("v") * F.col("weight_norm")).alias("z"))
