"""Buffers of points, lines and polygons.

A buffer is the union of simple pieces: a rectangle along each segment, a sector,
wedge or triangle at each vertex, a cap at each end, and the polygon itself. The
pieces of all features go through one arrangement (see ``overlay``), where what lies
inside none of a feature's pieces is outside its buffer. A negative distance leaves
what is inside the polygon and in none of its border's pieces; a ring
is what one buffer has and a smaller one has not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import arrangement as net
from .alike import alike
from .overlay import Arrangement
from .storage import durable

CAPS, JOINS = ("round", "flat", "square"), ("round", "mitre", "bevel")


def _arc(x: Column, y: Column, start: Column, turn: Column, radius: float, quad_segs: int) -> Column:
    """Points on a circle from an angle on, with about ``quad_segs`` steps a quarter."""
    steps = F.greatest(F.lit(1), F.round(F.abs(turn) / (math.pi / 2 / quad_segs)).cast("int"))
    return F.transform(F.sequence(F.lit(0), steps), lambda i: g.vertex(x + radius * F.cos(start + turn * i / steps), y + radius * F.sin(start + turn * i / steps)))


def _pieces(features: DataFrame, distance: float, quad_segs: int, cap: str, join: str, mitre_limit: float) -> DataFrame:
    """row, geometry: the pieces around all points, segments, vertices and ends; ``features`` has row and geometry."""
    d = abs(float(distance))
    shape = F.col("geometry")
    dots = features.where(g.is_point(shape)).select("row", F.explode(g.vertices(shape)).alias("v"))
    discs = dots.select("row", g.regular_polygon(F.col("v.x"), F.col("v.y"), F.lit(d), 4 * quad_segs).alias("geometry"))
    # vertices of a path that repeat one another count once
    keep = lambda r: F.filter(r, lambda v, i: (i == 0) | (v["x"] != F.get(r, i - 1)["x"]) | (v["y"] != F.get(r, i - 1)["y"]))
    paths = features.where(~g.is_point(shape)).select("row", g.is_polygon(shape).alias("ring"), F.explode(F.flatten(shape["coords"])).alias("raw")).select("row", "ring", keep(F.col("raw")).alias("p"))
    lone = paths.where("size(p) = 1").select("row", g.regular_polygon(F.get("p", 0)["x"], F.get("p", 0)["y"], F.lit(d), 4 * quad_segs).alias("geometry"))
    paths = paths.where("size(p) > 1")
    a, b = F.col("s.a"), F.col("s.b")
    size = F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    ux, uy = (b["x"] - a["x"]) / size, (b["y"] - a["y"]) / size
    corner = lambda v, along, across: g.vertex(v["x"] + along * ux - across * uy, v["y"] + along * uy + across * ux)
    quad = lambda before, after: g.polygon(F.array(corner(a, -before, -d), corner(b, after, -d), corner(b, after, d), corner(a, -before, d), corner(a, -before, -d)))
    segments = paths.select("row", F.explode(g.segments(F.col("p"))).alias("s"))
    out = discs.unionByName(lone).unionByName(segments.select("row", quad(F.lit(0.0), F.lit(0.0)).alias("geometry")))
    # corners: each vertex with the one before and the one behind; a ring goes on around
    n = F.size("p")
    inner = F.transform(F.slice("p", 2, F.greatest(n - 2, F.lit(0))), lambda v, i: F.struct(F.get("p", i).alias("u"), v.alias("v"), F.get("p", i + 2).alias("w")))
    closing = F.array(F.struct(F.get("p", n - 2).alias("u"), F.get("p", 0).alias("v"), F.get("p", 1).alias("w")))
    closed = F.col("ring") | ((n > 2) & (F.get("p", 0)["x"] == F.element_at("p", -1)["x"]) & (F.get("p", 0)["y"] == F.element_at("p", -1)["y"]))
    turns = paths.select("row", F.explode(F.when(closed, F.concat(inner, closing)).otherwise(inner)).alias("t"))
    v = F.col("t.v")
    angle = lambda p, q: F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    one, two = angle(F.col("t.u"), v), angle(v, F.col("t.w"))
    turn = F.pmod(two - one + math.pi, F.lit(2 * math.pi)) - math.pi
    # a left turn opens on the right side, a right turn on the left
    start = F.when(turn > 0, one - math.pi / 2).otherwise(one + math.pi / 2)
    placed = turns.select("row", v.alias("v"), turn.alias("turn"), start.alias("start")).where(F.abs("turn") > 1e-9)
    x, y = F.col("v.x"), F.col("v.y")
    if join == "round":
        around = _arc(x, y, F.col("start"), F.col("turn"), d, quad_segs)
    else:
        ends = [g.vertex(x + d * F.cos(F.col("start") + t), y + d * F.sin(F.col("start") + t)) for t in (F.lit(0.0), F.col("turn"))]
        flat = F.array(*ends)
        half = F.cos(F.col("turn") / 2)
        tip = g.vertex(x + d / half * F.cos(F.col("start") + F.col("turn") / 2), y + d / half * F.sin(F.col("start") + F.col("turn") / 2))
        around = F.when(1 / half <= mitre_limit, F.array(ends[0], tip, ends[1])).otherwise(flat) if join == "mitre" else flat
    fan = F.concat(F.array(g.vertex(x, y)), around, F.array(g.vertex(x, y)))
    out = out.unionByName(placed.select("row", g.polygon(fan).alias("geometry")))
    if cap != "flat":
        end = lambda i, j: F.struct(F.get("p", i).alias("a"), F.get("p", j).alias("b"))
        tips = paths.where(~closed).select("row", F.explode(F.array(end(1, 0), end(F.size("p") - 2, F.size("p") - 1))).alias("s"))
        if cap == "square":
            made = g.polygon(F.array(corner(b, 0.0, -d), corner(b, d, -d), corner(b, d, d), corner(b, 0.0, d), corner(b, 0.0, -d)))
        else:
            half_disc = _arc(b["x"], b["y"], angle(a, b) - math.pi / 2, F.lit(math.pi), d, quad_segs)
            made = g.polygon(F.concat(half_disc, F.slice(half_disc, 1, 1)))
        out = out.unionByName(tips.select("row", made.alias("geometry")))
    return out


def _between(features: DataFrame, made: DataFrame, cell: float | None) -> DataFrame:
    """(row, geometry) of what a row's pieces cover, without what its pieces marked ``less`` cover; ``made`` is (row, less, geometry)."""
    pieces = durable(made.withColumn("id", F.monotonically_increasing_id()))
    found = Arrangement([pieces], "id", cell, "row")
    named = found.sides.join(pieces.select(F.col("id").alias("fid"), "row", "less"), "fid")
    side = lambda c: (F.max(F.col(c) & ~F.col("less")) & ~F.max(F.col(c) & F.col("less"))).alias(c)
    sides = named.groupBy(*net.EDGE, "row").agg(side("left"), side("right"))
    return found.shapes(net.directed(sides, F.col("left"), F.col("right"), "row"), "row")


def _checked(quad_segs: int, cap: str, join: str) -> None:
    if quad_segs < 1:
        raise ValueError("quad_segs must be at least 1")
    if cap not in CAPS or join not in JOINS:
        raise ValueError(f"cap_style is one of {CAPS}, join_style one of {JOINS}")


def buffer(features: DataFrame, distance: float, quad_segs: int = 8, cap_style: str = "round", join_style: str = "round", mitre_limit: float = 5.0, dissolve: bool = False, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """Features with their buffer as geometry and ``_buffer_source_index``; what a negative distance empties goes. ``dissolve`` makes one feature of all."""
    _checked(quad_segs, cap_style, join_style)
    if distance == 0:
        raise ValueError("distance must not be 0")
    ready = durable(features.where("geometry is not null").withColumn("__row", F.monotonically_increasing_id()))
    each, members = alike(ready, "__row")
    members = members.withColumnsRenamed({"shape": "__shape", "member": "__member"})
    small = each.select((F.lit(0).cast("bigint") if dissolve else F.col("__row")).alias("row"), "geometry")
    around = _pieces(small, distance, quad_segs, cap_style, join_style, mitre_limit).withColumn("less", F.lit(distance < 0))
    bodies = small.where(g.is_polygon(F.col("geometry"))).select("row", "geometry", F.lit(False).alias("less"))
    if distance < 0 and not dissolve:
        around = around.join(bodies.select("row").distinct(), "row", "left_semi")
    shapes = _between(small, around.unionByName(bodies), cell)
    if dissolve:
        return shapes.select(F.lit(True).alias("dissolved"), F.lit(float(distance)).alias("buffer_distance"), "geometry")
    out = ready.drop("geometry").withColumn("_buffer_source_index", F.col(order))
    return out.join(members, F.col("__row") == F.col("__member")).join(shapes, F.col("__shape") == F.col("row")).drop("__row", "row", "__shape", "__member")


def ring_buffers(features: DataFrame, distances: list[float], quad_segs: int = 8, cap_style: str = "round", join_style: str = "round", mitre_limit: float = 5.0, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """For each feature the rings between consecutive distances; the first one holds polygons themselves."""
    _checked(quad_segs, cap_style, join_style)
    steps = sorted(float(d) for d in distances)
    if not steps or steps[0] <= 0:
        raise ValueError("distances must be positive")
    ready = durable(features.where("geometry is not null").withColumn("__row", F.monotonically_increasing_id()))
    each, members = alike(ready, "__row")
    members = members.withColumnsRenamed({"shape": "__shape", "member": "__member"})
    n, made = len(steps), None
    for i, d in enumerate(steps):
        small = each.select((F.col("__row") * n + i).alias("row"), "geometry")
        bodies = small.where(g.is_polygon(F.col("geometry")))
        parts = _pieces(small, d, quad_segs, cap_style, join_style, mitre_limit).unionByName(bodies).withColumn("less", F.lit(False))
        if i:
            parts = parts.unionByName(_pieces(small, steps[i - 1], quad_segs, cap_style, join_style, mitre_limit).unionByName(bodies).withColumn("less", F.lit(True)))
        made = parts if made is None else made.unionByName(parts)
    shapes = _between(ready, made, cell).withColumn("ring_index", (F.col("row") % n + 1).cast("int")).withColumn("__of", F.floor(F.col("row") / n)).drop("row")
    limit = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("ring_index"))
    labels = [f"{a:g}-{b:g}" for a, b in zip([0.0, *steps], steps, strict=False)]
    joined = ready.drop("geometry").join(members, F.col("__row") == F.col("__member")).join(shapes, F.col("__shape") == F.col("__of")).drop("__row", "__of", "__shape", "__member")
    return joined.withColumns({"inner": limit([0.0, *steps[:-1]]), "outer": limit(steps), "label": limit(labels)})
