"""Voronoi cells by clipping with bisectors.

A cell begins as the box and is cut by the bisectors to its site's nearest sites.
Once no vertex is farther from the site than half the way to the nearest site that
wasn't looked at, no other site can cut it: the cell is final. The others look at
more sites, round by round, and at last at all within twice their farthest vertex,
which proves them final, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import even_round
from .overlay import clip_by, clip_by_edges
from .spatial import cell_of, cells_of, nearest
from .storage import durable

#: Nearest sites that the rounds look at.
ROUNDS = (12, 48)


def bisector(x: Column, y: Column, ox: Column, oy: Column) -> Column:
    """The edge with the places nearer to (x, y) than to (ox, oy) on its left."""
    mx, my = (x + ox) / 2, (y + oy) / 2
    return F.struct(g.vertex(mx, my).alias("a"), g.vertex(mx - (oy - y), my + (ox - x)).alias("b"))


def farthest(ring: Column, x: Column, y: Column) -> Column:
    return F.array_max(F.transform(ring, lambda v: F.sqrt(F.pow(v["x"] - x, 2) + F.pow(v["y"] - y, 2))))


def voronoi(points: DataFrame, clip_to: DataFrame | None = None, bbox: tuple[float, float, float, float] | None = None, order: str = "_idx") -> DataFrame:
    """Points with their cell as geometry, and cell_area; of points at one place the first has the cell.

    Cells are cut to the polygons of a layer, or a box, or the points' extent and a fifth of it on each side. Needs two places.
    """
    first = points.where("x is not null and y is not null").groupBy("x", "y").agg(F.min(order).alias("source"))
    sites = durable(first.select("source", "x", "y"))
    r = sites.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if r.n < 2:
        raise ValueError("Voronoi cells need at least two distinct points")
    if clip_to is not None:
        b = g.bounds(F.col("geometry"))
        m = clip_to.where("geometry is not null").select(b.alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
        if m[0] is None:
            raise ValueError("the clip layer is empty")
        bbox = tuple(m)
    if bbox is None:
        dx, dy = max((r.x1 - r.x0) * 0.2, 1e-9), max((r.y1 - r.y0) * 0.2, 1e-9)
        bbox = (r.x0 - dx, r.y0 - dy, r.x1 + dx, r.y1 + dy)
    # cells begin with a box that also holds the sites, so that every site is in its cell
    outer = (min(bbox[0], r.x0), min(bbox[1], r.y0), max(bbox[2], r.x1), max(bbox[3], r.y1))
    box = F.get(F.get(g.rectangle(*map(F.lit, outer))["coords"], 0), 0)
    edge = (outer[2] - outer[0] + outer[3] - outer[1]) / max(2.0, r.n**0.5)
    x, y = F.col("x"), F.col("y")
    others = sites.select(F.col("source").alias("target"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    named = sites.withColumnRenamed("source", "_idx")

    def cut(open_: DataFrame, pairs: DataFrame) -> DataFrame:
        """Sites with their cell after the bisectors to their partners, the nearest first."""
        gap = F.pow(x - F.col("ox"), 2) + F.pow(y - F.col("oy"), 2)
        lines = pairs.join(others, "target").where("source <> target").select("source", F.struct(gap.alias("d"), bisector(x, y, F.col("ox"), F.col("oy")).alias("e")).alias("l"))
        sides = lines.groupBy("source").agg(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["e"]).alias("edges"), F.max("l.d").alias("seen"))
        return open_.join(sides, "source").select("source", "x", "y", clip_by_edges(F.col("ring"), F.col("edges")).alias("ring"), F.sqrt("seen").alias("seen"))

    left = sites.withColumn("ring", box)
    done = None
    for k in ROUNDS:
        near = nearest(left.select(F.col("source").alias("_idx"), "x", "y"), named, min(k + 1, 100), None).select("source", "target")
        made = durable(cut(left, near.join(sites, "source").select("source", "target", "x", "y")))
        final = (2 * farthest(F.col("ring"), x, y) <= F.col("seen")) | F.lit(r.n <= k + 1)
        ready = made.where(final).select("source", "ring")
        done = ready if done is None else done.unionByName(ready)
        left = made.where(~final).select("source", "x", "y", "ring")
        if left.isEmpty():
            break
    else:
        # all sites within twice the farthest vertex
        far = farthest(F.col("ring"), x, y) * 2
        span = F.struct((x - far).alias("minx"), (y - far).alias("miny"), (x + far).alias("maxx"), (y + far).alias("maxy"))
        inside = F.struct(*[F.greatest(F.lit(outer[i]), F.least(F.lit(outer[i + 2]), span[k])).alias(k) for k, i in (("minx", 0), ("miny", 1))], *[F.greatest(F.lit(outer[i]), F.least(F.lit(outer[i + 2]), span[k])).alias(k) for k, i in (("maxx", 0), ("maxy", 1))])
        reach = left.select("source", "x", "y", far.alias("far"), F.explode(cells_of(inside, edge)).alias("c"))
        placed = others.select("*", cell_of(F.col("ox"), F.col("oy"), edge).alias("c"))
        pairs = reach.join(placed, "c").where(F.pow(x - F.col("ox"), 2) + F.pow(y - F.col("oy"), 2) <= F.pow("far", 2)).select("source", "target", "x", "y")
        done = done.unionByName(cut(left, pairs).select("source", "ring"))
    clip = F.get(F.get(g.rectangle(*map(F.lit, bbox))["coords"], 0), 0)
    cells = done.select("source", g.polygon(clip_by_edges(F.col("ring"), g.segments(clip))).alias("geometry")).where(F.size(g.vertices(F.col("geometry"))) >= 4)
    if clip_to is not None:
        cells = clip_by(cells.withColumnRenamed("source", "_idx"), clip_to.withColumn("_idx", F.monotonically_increasing_id())).select(F.col("_idx").alias("source"), "geometry")
    sized = cells.withColumn("cell_area", even_round(g.area(F.col("geometry")), 9)).where("cell_area > 0")
    return points.join(sized, points[order] == sized["source"]).drop("source")
