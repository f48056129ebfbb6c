"""Spatial join of foot points with zone polygons by a grid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Side of a cell in the frame's units, and how far around a cell an edge still makes it one to be tested.
CELL, MARGIN = 1 / 32, 1e-6
#: Cells a side that a zone's bounding box may span; a larger zone's cells are as many times larger.
MOST_CELLS = 64


def _edges(points: str) -> Column:
    """A polygon's edges as structs of both ends."""
    p = F.col(points)
    n = F.size(p)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, (i + n - 1) % n).alias("b")))


def grid_index(zones: DataFrame, cell: float = CELL) -> DataFrame:
    """zones (camera_id, zone_id, points) -> (camera_id, zone_id, level, cx, cy, whole, points): the cells that each polygon covers.

    whole: all of the cell is inside; its points are null then. Other cells are met by an edge
    and need the exact test. A cell of level k is 2**k cells wide; a zone's level is the least
    at which its bounding box is MOST_CELLS wide at most, so a zone has a bounded number of
    cells. Polygons of fewer than three points have none.
    """
    z = zones.where("size(points) >= 3").select("camera_id", "zone_id", "points", _edges("points").alias("edges"), *(f(F.transform("points", lambda q: q[c])).alias(f"{n}{c}") for n, f in (("lo_", F.array_min), ("hi_", F.array_max)) for c in "xy"))
    span = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")) / cell
    z = z.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(1.0)) / MOST_CELLS))).cast("int"))
    side = F.lit(cell) * F.pow(F.lit(2.0), "level")
    steps = lambda c: F.explode(F.sequence(F.floor((F.col(f"lo_{c}") - MARGIN) / side), F.floor((F.col(f"hi_{c}") + MARGIN) / side)))
    cells = z.withColumn("side", side).withColumn("cx", steps("x")).withColumn("cy", steps("y"))
    x0, y0 = F.col("cx") * F.col("side"), F.col("cy") * F.col("side")
    half = F.col("side") / 2 + MARGIN

    def meets(e: Column) -> Column:
        """Separating axes of an edge and the cell: the two of the cell, and the edge's normal."""
        ax, ay, bx, by = (e[p][q] - o - F.col("side") / 2 for p in "ab" for q, o in (("x", x0), ("y", y0)))
        apart = (F.least(ax, bx) > half) | (F.greatest(ax, bx) < -half) | (F.least(ay, by) > half) | (F.greatest(ay, by) < -half)
        return ~(apart | (F.abs(ax * by - ay * bx) > half * (F.abs(bx - ax) + F.abs(by - ay))))

    told = cells.withColumn("met", F.exists("edges", meets)).withColumn("middle", C.in_polygon(x0 + F.col("side") / 2, y0 + F.col("side") / 2, "points"))
    kept = told.where("met or middle").withColumn("whole", ~F.col("met"))
    return kept.select("camera_id", "zone_id", "level", "cx", "cy", "whole", F.when(~F.col("whole"), F.col("points")).alias("points"))


def zone_membership(points: DataFrame, zones: DataFrame, x: str = "foot_x", y: str = "foot_y", cell: float = CELL) -> DataFrame:
    """points (camera_id, ...) with zone_id: a row for each of the camera's polygons that the point is in, by the even-odd rule. (ST-05, F-02)

    An equi join by camera and cell; only points in cells on an edge are tested against the
    polygon. Points without coordinates are in no zone; other columns of points are kept. The
    levels in use, one as a rule, are a driver-side list of at most a few numbers.
    """
    index = grid_index(zones, cell).withColumnRenamed("points", "polygon")
    levels = [r["level"] for r in index.select("level").distinct().orderBy("level").collect()] or [0]
    where = lambda c, k: F.floor(F.col(c) / (cell * 2.0**k))
    cells = F.array(*(F.struct(F.col("camera_id"), F.lit(k).alias("level"), where(x, k).alias("cx"), where(y, k).alias("cy")) for k in levels))
    # A row travels as one struct, so that its columns may have any names.
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.struct(*points.columns).alias("row"), (F.explode(cells) if len(levels) > 1 else cells[0]).alias("cell"))
    at = at.select("row", *(F.col(f"cell.{c}").alias(c) for c in ("camera_id", "level", "cx", "cy")))
    hits = at.join(index, ["camera_id", "level", "cx", "cy"]).where(F.col("whole") | C.in_polygon(f"row.{x}", f"row.{y}", "polygon"))
    return hits.select("row.*", "zone_id")
