"""Overlay of layers: clip, erase, union, intersection and dissolving.

``clip_by``, ``erase``, ``union``, ``regions`` and ``dissolve`` take polygons of any
shape, with holes and several parts, and work on the arrangement of all their
edges (see ``arrangement``): what covers each side of an edge decides whether it
bounds the result. ``clip`` and ``intersections`` are shorter ways for one convex
mask, or convex targets: a polygon is clipped edge by edge of the mask, as nested
array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import even_round
from . import arrangement as net
from .aggregates import aggregate_of
from .alike import alike, handed_out
from .shapes import repair as clean_rings
from .shapes import topology_issues, validity
from .spatial import cells_of
from .storage import durable


def shell(shape: Column) -> Column:
    return F.get(F.get(shape["coords"], 0), 0)


def is_convex(ring: Column) -> Column:
    """Whether all turns of a counter-clockwise ring are to the left."""
    pairs = g.segments(ring)
    turns = F.zip_with(pairs, F.concat(F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), F.slice(pairs, 1, 1)), lambda s, t: (s["b"]["x"] - s["a"]["x"]) * (t["b"]["y"] - t["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (t["b"]["x"] - t["a"]["x"]))
    return F.forall(turns, lambda v: v >= -g.EPS)


def clip_ring(ring: Column, mask: Column) -> Column:
    """The part of a closed ring inside a convex closed ring; an empty array if there is none."""
    return clip_by_edges(ring, g.segments(mask))


def clip_by_edges(ring: Column, edges: Column) -> Column:
    """The part of a closed convex or simple ring to the left of all edges (a, b)."""
    none = F.array().cast(g.RING)

    def cut(now: Column, edge: Column) -> Column:
        side = lambda v: (edge["b"]["x"] - edge["a"]["x"]) * (v["y"] - edge["a"]["y"]) - (edge["b"]["y"] - edge["a"]["y"]) * (v["x"] - edge["a"]["x"])

        def keep(s: Column) -> Column:
            p, q = side(s["a"]), side(s["b"])
            t = p / F.when(p != q, p - q)
            meet = g.vertex(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))
            return F.when((p >= 0) & (q >= 0), F.array(s["b"])).when(p >= 0, F.array(meet)).when(q >= 0, F.array(meet, s["b"])).otherwise(none)

        left = F.flatten(F.transform(g.segments(now), keep))
        return g.once(left, lambda r: F.when(F.size(r) > 0, F.concat(r, F.slice(r, 1, 1))).otherwise(none))

    return F.aggregate(edges, ring.cast(g.RING), cut)


def clip_path(path: Column, mask: Column) -> Column:
    """The paths that are left of an open path inside a convex closed ring, which counts as inside."""
    def inside(s: Column) -> Column:
        """The range of a segment inside all half planes, as (lo, hi)."""
        def narrow(now: Column, edge: Column) -> Column:
            side = lambda v: (edge["b"]["x"] - edge["a"]["x"]) * (v["y"] - edge["a"]["y"]) - (edge["b"]["y"] - edge["a"]["y"]) * (v["x"] - edge["a"]["x"])
            p, q = side(s["a"]), side(s["b"])
            t = p / F.when(p != q, p - q)
            lo = F.when((p < 0) & (q < 0), 2.0).when((p < 0) & (q >= 0), F.greatest(now["lo"], t)).otherwise(now["lo"])
            hi = F.when((p >= 0) & (q < 0), F.least(now["hi"], t)).otherwise(now["hi"])
            return F.struct(lo.alias("lo"), hi.alias("hi"))

        return F.aggregate(g.segments(mask), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), narrow)

    at = lambda s, t: F.when(t <= 0, s["a"]).when(t >= 1, s["b"]).otherwise(g.vertex(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])))
    kept = F.filter(F.transform(F.transform(g.segments(path), lambda s: F.struct(s.alias("s"), inside(s).alias("r"))), lambda e: F.when(e["r"]["lo"] < e["r"]["hi"], F.struct(at(e["s"], e["r"]["lo"]).alias("a"), at(e["s"], e["r"]["hi"]).alias("b")))), lambda e: e.isNotNull())
    # segments that meet are one path
    none = F.array().cast(f"array<{g.RING}>")

    def joined(paths: Column, e: Column) -> Column:
        end = F.element_at(F.element_at(paths, -1), -1)
        meets = (F.size(paths) > 0) & (end["x"] == e["a"]["x"]) & (end["y"] == e["a"]["y"])
        longer = F.concat(F.slice(paths, 1, F.greatest(F.size(paths) - 1, F.lit(0))), F.array(F.concat(F.element_at(paths, -1), F.array(e["b"]))))
        return F.when(meets, longer).otherwise(F.concat(paths, F.array(F.array(e["a"], e["b"]))))

    return F.aggregate(kept, none, joined)


def clip_geometry(shape: Column, mask: Column) -> Column:
    """Points, lines and polygons inside a convex ring; null if nothing is left."""
    box = g.polygon(mask)
    parts = F.transform(shape["coords"], lambda rings: F.filter(F.transform(rings, lambda r: clip_ring(r, mask)), lambda r: F.size(r) >= 4))
    kept = F.when(g.is_point(shape), F.filter(shape["coords"], lambda p: g.covers(box, F.get(F.get(p, 0), 0)["x"], F.get(F.get(p, 0), 0)["y"]))).when(~g.is_polygon(shape), F.transform(F.flatten(F.transform(F.flatten(shape["coords"]), lambda path: clip_path(path, mask))), lambda path: F.array(path))).otherwise(F.filter(parts, lambda p: F.size(p) > 0))
    kind = F.when((shape["type"] == "LineString") & (F.size(kept) > 1), "MultiLineString").otherwise(shape["type"])
    return F.when(F.size(kept) > 0, F.struct(kind.alias("type"), kept.alias("coords")))


def clip(df: DataFrame, mask: Column, order: str = "_idx") -> DataFrame:
    """Features cut to a convex mask polygon (a Column); what is empty goes."""
    out = df.withColumn("source_feature_index", F.col(order)).withColumn("geometry", clip_geometry(F.col("geometry"), shell(mask)))
    return out.where(F.col("geometry").isNotNull() & (~g.is_polygon(F.col("geometry")) | (g.area(F.col("geometry")) > 0)))


def intersections(sources: DataFrame, targets: DataFrame, cell: float, order: str = "_idx") -> DataFrame:
    """(source, target, geometry, _intersection_area) of polygons and convex target polygons that share area.

    Polygons meet on grid cells; a pair counts in the one cell that holds the
    lower left corner of what their boxes share.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        placed = df.where(F.col("geometry").isNotNull()).select(F.col(order).alias(name), F.col("geometry").alias(f"{name}_g"), g.bounds(F.col("geometry")).alias(f"{name}_b"))
        return placed.select("*", F.explode(cells_of(F.col(f"{name}_b"), cell)).alias("c"))

    a, b = F.col("source_b"), F.col("target_b")
    x, y = F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"])
    meet = (x <= F.least(a["maxx"], b["maxx"])) & (y <= F.least(a["maxy"], b["maxy"])) & (F.floor(x / cell) == F.col("c.cx")) & (F.floor(y / cell) == F.col("c.cy"))
    pairs = side(sources, "source").join(side(targets, "target"), "c").where(meet)
    cut = pairs.select("source", "target", clip_geometry(F.col("source_g"), shell(F.col("target_g"))).alias("geometry"))
    return cut.withColumn("_intersection_area", even_round(g.area(F.col("geometry")))).where("_intersection_area > 0")


def intersect_filter(sources: DataFrame, targets: DataFrame, cell: float, order: str = "_idx") -> DataFrame:
    """Sources with the target that they share most area with, the first of equals."""
    best = intersections(sources, targets, cell, order).groupBy("source").agg(F.min_by(F.struct("target", "_intersection_area"), F.struct(-F.col("_intersection_area"), F.col("target"))).alias("b"))
    return sources.join(best, sources[order] == best["source"]).withColumns({"_target_index": F.col("b.target"), "_intersection_area": F.col("b._intersection_area")}).drop("source", "b")


def overlaps(df: DataFrame, cell: float, tolerance: float = 0.0, order: str = "_idx") -> DataFrame:
    """(feature, other, area): pairs of convex polygons of one layer that share more area than the tolerance."""
    found = intersections(df, df, cell, order).where((F.col("source") < F.col("target")) & (F.col("_intersection_area") > tolerance))
    return found.select(F.col("source").alias("feature"), F.col("target").alias("other"), F.col("_intersection_area").alias("area"))


class Arrangement:
    """The noded edges of layers, and what covers their sides. Feature i of layer k of n has the id i * n + k; features of different planes don't meet."""

    def __init__(self, layers: list[DataFrame], order: str = "_idx", cell: float | None = None, plane: str | None = None) -> None:
        n = len(layers)
        parts = None
        for k, df in enumerate(layers):
            shape = F.col("geometry")
            found = net.segments_of(df.where(~g.is_point(shape)).select((F.col(order).cast("bigint") * n + k).alias("fid"), "geometry", *([plane] if plane else [])), "fid", plane)
            parts = found if parts is None else parts.unionByName(found)
        segments = durable(parts.withColumn("sid", F.monotonically_increasing_id()))
        self.cell = cell or net.grid_cell(segments)
        self.pieces = durable(net.node(segments, self.cell))
        self.borders = durable(net.boundaries(self.pieces.where("polygon")))
        edges = net.undirected(self.pieces).select(*net.EDGE).distinct()
        self.sides = durable(net.coverage(edges, self.borders, self.cell))

    def covered(self, layer: int, layers: int) -> DataFrame:
        """Edges with whether any feature of a layer covers their sides."""
        of = self.sides.where(F.pmod(F.col("fid"), F.lit(layers)) == layer)
        return of.groupBy(*net.EDGE).agg(F.max("left").alias("u_left"), F.max("right").alias("u_right"))

    def shapes(self, edges: DataFrame, key: str) -> DataFrame:
        """(key, geometry) of directed edges."""
        parts = net.polygons(edges, key, self.cell)
        return parts.groupBy(key).agg(net.geometry_of(F.array_sort(F.collect_list("part"))).alias("geometry"))


def _paths(found: Arrangement, keep: Column) -> DataFrame:
    """(fid, geometry) of the first layer's lines: runs of their pieces that are to be kept."""
    pieces = net.undirected(found.pieces.where("not polygon").withColumns({f"__{c}": F.col(c) for c in net.POINTS}))
    known = pieces.join(found.covered(1, 2), list(net.EDGE), "left").withColumn("__in", F.coalesce(F.col("u_left") | F.col("u_right"), F.lit(False)))
    run = Window.partitionBy("fid", "part").orderBy("seq", "piece")
    kept = known.withColumn("at", F.row_number().over(run)).where(keep).withColumn("path", F.col("at") - F.row_number().over(run))
    vertex = lambda x, y: g.vertex(F.col(x), F.col(y))
    each = kept.groupBy("fid", "part", "path").agg(F.array_sort(F.collect_list(F.struct("at", vertex("__px", "__py").alias("a"), vertex("__qx", "__qy").alias("b")))).alias("p"))
    line = F.concat(F.transform("p", lambda p: p["a"]), F.array(F.element_at("p", -1)["b"]))
    lines = each.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("part", "path", line.alias("line")))).alias("lines"))
    kind = F.when(F.size("lines") == 1, "LineString").otherwise("MultiLineString")
    return lines.select("fid", F.struct(kind.alias("type"), F.transform("lines", lambda p: F.array(p["line"])).alias("coords")).alias("geometry"))


def _points(features: DataFrame, mask: DataFrame, inside: bool, cell: float, order: str) -> DataFrame:
    """(fid, geometry) of the points that a mask covers, or those that none covers."""
    each = features.where(g.is_point(F.col("geometry"))).select((F.col(order).cast("bigint") * 2).alias("fid"), F.col("geometry.type").alias("kind"), F.posexplode("geometry.coords").alias("i", "p"))
    each = each.withColumns({"x": F.get(F.get("p", 0), 0)["x"], "y": F.get(F.get("p", 0), 0)["y"]})
    where = mask.where(g.is_polygon(F.col("geometry"))).select(F.col("geometry").alias("m"), F.explode(cells_of(g.bounds(F.col("geometry")), cell)).alias("c"))
    hit = each.withColumn("c", F.struct(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))).join(where, "c").where(g.covers(F.col("m"), F.col("x"), F.col("y"))).select("fid", "i").distinct()
    kept = each.join(hit, ["fid", "i"], "left_semi" if inside else "left_anti")
    parts = kept.groupBy("fid").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("i", "p"))).alias("l"))
    return parts.select("fid", F.struct(F.col("kind").alias("type"), F.transform("l", lambda e: e["p"]).alias("coords")).alias("geometry"))


def _masked(features: DataFrame, mask: DataFrame, inside: bool, order: str, cell: float | None) -> DataFrame:
    each, members = alike(features, order)
    mask, _ = alike(mask.where(g.is_polygon(F.col("geometry"))), order)
    found = Arrangement([each, mask], order, cell)
    own = found.sides.where(F.pmod(F.col("fid"), F.lit(2)) == 0)
    both = own.join(found.covered(1, 2), list(net.EDGE), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("u_left", "u_right")})
    keeps = lambda a, b: F.col(a) & (F.col(b) if inside else ~F.col(b))
    shapes = found.shapes(net.directed(both, keeps("left", "u_left"), keeps("right", "u_right"), "fid"), "fid")
    all_ = shapes.unionByName(_paths(found, F.col("__in") if inside else ~F.col("__in"))).unionByName(_points(each, mask, inside, 4 * found.cell, order))
    out = features.drop("geometry").withColumn("source_feature_index", F.col(order))
    made = handed_out(all_.withColumn("__id", F.floor(F.col("fid") / 2)).drop("fid"), members, "__id")
    return out.join(made, F.col(order) == F.col("__id")).drop("__id")


def clip_by(features: DataFrame, mask: DataFrame, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """Points, lines and polygons cut to the area that any polygon of the mask layer covers; what is empty goes, as do lower dimensions that are left of a polygon."""
    return _masked(features, mask, True, order, cell)


def erase(features: DataFrame, mask: DataFrame, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """What is left of points, lines and polygons outside the area of the mask layer."""
    return _masked(features, mask, False, order, cell)


def union(source: DataFrame, target: DataFrame, source_prefix: str = "source_", target_prefix: str = "target_", order: str = "_idx", cell: float | None = None) -> DataFrame:
    """The pieces into which two polygon layers split each other, none of them overlapping.

    Each has the attributes of the first source and the first target that cover it,
    overlay_origin (both, source, target), and how many of either cover it.
    """
    if source_prefix == target_prefix:
        raise ValueError("source_prefix and target_prefix must differ")
    found = Arrangement([source, target], order, cell)
    layer, id_ = F.pmod(F.col("fid"), F.lit(2)), F.floor(F.col("fid") / 2)
    made = [f(F.when((layer == k) & F.col(side), id_)).alias(f"{side}_{name}{k}") for side in ("left", "right") for k in (0, 1) for name, f in (("first", F.min), ("n", F.count))]
    labels = found.sides.groupBy(*net.EDGE).agg(*made)
    label = lambda side: F.concat_ws(":", *[F.coalesce(F.col(f"{side}_{c}").cast("string"), F.lit("")) for c in ("first0", "n0", "first1", "n1")])
    covered = lambda side: F.col(f"{side}_n0") + F.col(f"{side}_n1") > 0
    forth = labels.where(covered("left")).select(label("left").alias("label"), *net.POINTS)
    back = labels.where(covered("right")).select(label("right").alias("label"), F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    parts = net.polygons(forth.unionByName(back), "label", found.cell)
    of = lambda i: F.split("label", ":")[i]
    number = lambda i: F.when(of(i) != "", of(i)).cast("bigint")
    pieces = parts.select(number(0).alias("_source_index"), number(1).alias("source_overlap_count"), number(2).alias("_target_index"), number(3).alias("target_overlap_count"), net.geometry_of(F.array("part")).alias("geometry"))
    for df, index, prefix in ((source, "_source_index", source_prefix), (target, "_target_index", target_prefix)):
        other = df.select(F.col(order).cast("bigint").alias(index), *[F.col(c).alias(prefix + c) for c in df.columns if c not in ("geometry", order)])
        pieces = pieces.join(other, index, "left")
    return pieces.withColumn("overlay_origin", F.when(F.col("_target_index").isNull(), "source").when(F.col("_source_index").isNull(), "target").otherwise("both"))


def regions(sources: DataFrame, targets: DataFrame, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """(source, target, geometry, _intersection_area) of all polygons of any shape that share area.

    Equal shapes count once, pairs of convex ones are clipped directly, and the others go through arrangements.
    """
    (left, left_of), (right, right_of) = alike(sources, order), alike(targets, order)
    ring = shell(F.col("geometry"))
    plain = g.is_polygon(F.col("geometry")) & (F.size("geometry.coords") == 1) & (F.size(F.get("geometry.coords", 0)) == 1) & is_simple_convex(ring)
    flat_left, flat_right = left.where(plain), right.where(plain)
    odd_left, odd_right = left.where(~F.coalesce(plain, F.lit(False))), right.where(~F.coalesce(plain, F.lit(False)))
    found = _convex_regions(flat_left, flat_right, order)
    if not odd_right.isEmpty():
        found = found.unionByName(_arranged_regions(left, odd_right, order, cell))
    if not odd_left.isEmpty():
        found = found.unionByName(_arranged_regions(odd_left, flat_right, order, cell))
    out = handed_out(handed_out(durable(found), left_of, "source"), right_of, "target")
    return out.select("source", "target", "geometry", "_intersection_area")


def is_simple_convex(ring: Column) -> Column:
    """Whether a closed ring turns to the left all the way, once around."""
    span = lambda k: F.array_max(F.transform(ring, lambda v: v[k])) - F.array_min(F.transform(ring, lambda v: v[k]))
    way = lambda k: F.aggregate(g.segments(ring), F.lit(0.0), lambda acc, s: acc + F.abs(s["b"][k] - s["a"][k]))
    around = lambda k: way(k) <= 2 * span(k) + net.SNAP
    return (F.size(ring) >= 4) & (g.ring_area(ring) > 0) & is_convex(ring) & around("x") & around("y")


def _convex_regions(sources: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """``regions`` of convex polygons without holes: boxes meet on grid cells, a pair in the one that holds the lower left corner of what they share."""
    on_grid = lambda r: F.transform(r, lambda v: g.vertex(F.round(v["x"], net.DIGITS), F.round(v["y"], net.DIGITS)))

    def side(df: DataFrame, name: str) -> DataFrame:
        rings = df.select(F.col(order).alias(name), on_grid(shell(F.col("geometry"))).alias(f"{name}_r"))
        return rings.withColumn(f"{name}_b", g.bounds(g.polygon(F.col(f"{name}_r"))))

    left, right = side(sources, "source"), side(targets, "target")
    wide, tall = F.col("b.maxx") - F.col("b.minx"), F.col("b.maxy") - F.col("b.miny")
    boxes = left.select(F.col("source_b").alias("b")).unionByName(right.select(F.col("target_b").alias("b")))
    r = boxes.agg(F.count(F.lit(1)).alias("n"), (F.max("b.maxx") - F.min("b.minx")).alias("w"), (F.max("b.maxy") - F.min("b.miny")).alias("h"), F.avg(F.greatest(wide, tall)).alias("mean")).first()
    cell = max(r.mean, (r.w * r.h / r.n) ** 0.5, max(r.w, r.h) / 1e4) if r.n else 1.0
    a, b = F.col("source_b"), F.col("target_b")
    x, y = F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"])
    meet = (x < F.least(a["maxx"], b["maxx"])) & (y < F.least(a["maxy"], b["maxy"])) & (F.floor(x / cell) == F.col("c.cx")) & (F.floor(y / cell) == F.col("c.cy"))
    placed = [durable(df).select("*", F.explode(cells_of(F.col(f"{name}_b"), cell)).alias("c")) for df, name in ((left, "source"), (right, "target"))]
    cut = placed[0].join(placed[1], "c").where(meet).select("source", "target", g.once(clip_ring(F.col("source_r"), F.col("target_r")), lambda r: g.once(on_grid(r), net.straight)).alias("ring"))
    made = durable(cut).where(F.size("ring") >= 4).withColumn("size", g.ring_area(F.col("ring"))).where("size > 0")
    return made.select("source", "target", g.polygon(F.col("ring")).alias("geometry"), even_round(F.col("size")).alias("_intersection_area"))


def _arranged_regions(sources: DataFrame, targets: DataFrame, order: str, cell: float | None) -> DataFrame:
    """``regions`` of polygons of any shape."""
    found = Arrangement([sources, targets], order, cell)
    side = lambda k, name: found.sides.where(F.pmod(F.col("fid"), F.lit(2)) == k).select(*net.EDGE, F.floor(F.col("fid") / 2).alias(name), F.col("left").alias(f"{name}_left"), F.col("right").alias(f"{name}_right"))
    both = side(0, "source").join(side(1, "target"), list(net.EDGE))
    edges = net.directed(both, F.col("source_left") & F.col("target_left"), F.col("source_right") & F.col("target_right"), "source", "target")
    shapes = found.shapes(edges.withColumn("pair", F.struct("source", "target")), "pair")
    return shapes.select("pair.source", "pair.target", "geometry", even_round(g.area(F.col("geometry"))).alias("_intersection_area"))


def repair(df: DataFrame, drop_invalid: bool = False, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """Geometries made valid, with is_valid, invalid_reason and _repaired.

    Rings are closed and repeated vertices go; a polygon whose rings cross becomes the area
    that a way from outside enters an odd number of times, in several parts if need be. What
    can't be mended (no coordinates, too few vertices, no area) keeps its shape and its reason.
    """
    before = df.withColumn("__before", validity(F.col("geometry")))
    cleaned = durable(clean_rings(before))
    crossed = cleaned.where(F.col("invalid_reason") == "self-intersection").select(order, "geometry", F.col(order).cast("bigint").alias("__plane"))
    found = Arrangement([crossed], order, cell, "__plane")  # each meets itself only
    made = found.shapes(net.directed(found.sides, F.col("left"), F.col("right"), "fid"), "fid").select(F.col("fid").alias("__fid"), F.col("geometry").alias("__made"))
    out = cleaned.join(made, F.col(order).cast("bigint") == F.col("__fid"), "left").withColumn("geometry", F.coalesce("__made", "geometry"))
    out = out.withColumn("invalid_reason", F.when(F.col("__made").isNull(), F.col("invalid_reason"))).withColumn("is_valid", F.col("invalid_reason").isNull())
    out = out.withColumn("_repaired", F.col("is_valid") & F.col("__before").isNotNull()).drop("__before", "__fid", "__made")
    return out.where("is_valid") if drop_invalid else out


CHECKS = ("invalid", "empty", "duplicate", "overlap", "sliver", "small")


def check_topology(df: DataFrame, checks: list[str] | None = None, min_area: float = 0.0, sliver_ratio: float = 0.01, overlap_tolerance: float = 0.0, max_issues: int | None = None, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """(feature, issue, other, area): what is wrong with features, and which valid polygons of any shape share more area than the tolerance.

    All issues come, or, if asked for, the first ``max_issues`` by feature.
    """
    wanted = list(checks or CHECKS)
    if strange := set(wanted) - set(CHECKS):
        raise ValueError(f"unknown checks {', '.join(sorted(strange))}")
    if min(min_area, sliver_ratio, overlap_tolerance) < 0:
        raise ValueError("min_area, sliver_ratio and overlap_tolerance can't be negative")
    out = topology_issues(df, min_area, sliver_ratio, order).withColumn("area", F.lit(None).cast("double"))
    if "overlap" in wanted:
        sound = durable(df.where(g.is_polygon(F.col("geometry")) & validity(F.col("geometry")).isNull()))
        shared = regions(sound, sound, order, cell).where((F.col("source") < F.col("target")) & (F.col("_intersection_area") > overlap_tolerance))
        out = out.unionByName(shared.select(F.col("source").alias("feature"), F.lit("overlap").alias("issue"), F.col("target").alias("other"), F.col("_intersection_area").alias("area")))
    out = out.where(F.col("issue").isin(wanted))
    return out.orderBy("feature", "issue", "other").limit(max_issues) if max_issues is not None else out


def dissolve(df: DataFrame, group_by: list[str], aggregations: list[dict] | None = None, order: str = "_idx", cell: float | None = None, values: list[str] | None = None) -> DataFrame:
    """One feature a group with aggregates and ``_feature_count``, its polygons merged: borders inside a group are gone.

    Points and lines are put together as they are. ``values`` names fields whose
    distinct values, ordered, come as ``<field>_values``.
    """
    made = [aggregate_of(df, a["op"], a.get("field"), order).alias(a.get("as") or f"{a.get('field', '')}_{a['op']}".strip("_")) for a in aggregations or []]
    made += [F.array_sort(F.collect_set(v)).alias(f"{v}_values") for v in values or []]
    flat = ~g.is_polygon(F.col("geometry"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(flat, F.struct(F.col(order).alias("o"), F.col("geometry.coords").alias("c"))))), lambda p: p["c"]))
    ready = df.withColumn("__row", F.monotonically_increasing_id())
    groups = durable(ready.groupBy(*group_by).agg(*made, F.count(F.lit(1)).alias("_feature_count"), F.min("__row").alias("__group"), F.max(F.when(flat, F.col("geometry.type"))).alias("__kind"), parts.alias("__parts")))
    same = F.lit(True)
    for c in group_by:
        same &= F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}"))
    features = durable(ready.alias("f").join(groups.alias("g"), same).select(F.col("f.__row").alias("__row"), F.col("f.geometry").alias("geometry"), F.col("g.__group").alias("__group")).where(g.is_polygon(F.col("geometry"))).groupBy("__group", "geometry").agg(F.min("__row").alias("__row")))  # equal shapes of a group count once
    found = Arrangement([features], "__row", cell, "__group")
    named = found.sides.join(features.select(F.col("__row").alias("fid"), "__group"), "fid")
    sides = named.groupBy(*net.EDGE, "__group").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    shapes = found.shapes(net.directed(sides, F.col("left"), F.col("right"), "__group"), "__group").withColumnRenamed("geometry", "__shape")
    rest = F.when(F.size("__parts") > 0, F.struct(F.regexp_replace("__kind", "^(Multi)?", "Multi").alias("type"), F.col("__parts").alias("coords")))
    return groups.join(shapes, "__group", "left").withColumn("geometry", F.coalesce("__shape", rest)).drop("__group", "__kind", "__parts", "__shape")
