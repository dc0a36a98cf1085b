"""Distances, neighbours and joins of points, lines and polygons of any shape.

Geometries are taken apart into segments (a point is a segment without length),
and segments meet on the cells of a grid that are no farther from them than the
search distance, so long lines and large polygons are in the cells along their
border only. What lies inside a polygon, far from its border, is found by parity
(see ``arrangement``). Nearest neighbours search in rounds of growing distance; a
source that has enough neighbours within a round's distance is done.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import even_round, loose
from . import arrangement as net
from . import spatial
from .alike import alike, handed_out
from .storage import durable


def pieces_of(df: DataFrame, order: str) -> DataFrame:
    """fid and the ends of all segments; a vertex alone is a segment of no length."""
    ring = F.explode(F.flatten("geometry.coords")).alias("r")
    alone = F.transform(F.slice("r", 1, 1), lambda v: F.struct(v.alias("a"), v.alias("b")))
    parts = df.where(F.col("geometry").isNotNull()).select(F.col(order).cast("bigint").alias("fid"), ring).select("fid", F.explode(F.when(F.size("r") > 1, g.segments(F.col("r"))).otherwise(alone)).alias("s"))
    return parts.select("fid", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def borders_of(df: DataFrame, order: str) -> DataFrame:
    """fid and edges of polygons, for parity; edges that a polygon has twice don't count."""
    found = net.segments_of(df.where(g.is_polygon(F.col("geometry"))).select(F.col(order).cast("bigint").alias("fid"), "geometry"), "fid")
    return net.boundaries(found.withColumnsRenamed({"ax": "px", "ay": "py", "bx": "qx", "by": "qy"}))


def segment_gap(s: tuple[str, str, str, str], t: tuple[str, str, str, str]) -> Column:
    """Planar distance of two segments; 0 if they cross or touch."""
    a, b, c, d = (F.struct(F.col(v[i]).alias("x"), F.col(v[i + 1]).alias("y")) for v in (s, t) for i in (0, 2))
    one, two = F.struct(a.alias("a"), b.alias("b")), F.struct(c.alias("a"), d.alias("b"))
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    cross = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    ends = [g.segment_distance(one, c["x"], c["y"]), g.segment_distance(one, d["x"], d["y"]), g.segment_distance(two, a["x"], a["y"]), g.segment_distance(two, b["x"], b["y"])]
    return F.when(cross, 0.0).otherwise(F.least(*ends))


def pairs_within(sources: DataFrame, targets: DataFrame, reach: float, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """(source, target, distance) of geometries that are ``reach`` apart or less; what overlaps or touches is 0 apart."""
    left, right = pieces_of(sources, order), pieces_of(targets, order)
    cell = cell or max(net.grid_cell(left.unionByName(right)), 2 * reach)
    names = ("ax", "ay", "bx", "by")
    near = left.select(F.col("fid").alias("source"), *names, F.explode(net.crossed_cells(*names, cell)).alias("c"))
    other = right.select(F.col("fid").alias("target"), *[F.col(n).alias(f"t{n}") for n in names], F.explode(net.crossed_cells(*names, cell, reach)).alias("c"))
    gap = segment_gap(names, tuple(f"t{n}" for n in names))
    apart = near.join(other, "c").select("source", "target", gap.alias("distance")).where(F.col("distance") <= reach)
    # a polygon that holds a vertex of the other one holds or meets it
    first = lambda df, name: df.where(F.col("geometry").isNotNull()).select(F.col(order).cast("bigint").alias(name), F.explode(F.transform("geometry.coords", lambda p: F.get(F.get(p, 0), 0))).alias("v")).select(name, F.col("v.x").alias("mx"), F.col("v.y").alias("my"))
    held = net.parity(first(sources, "source"), ("source", "mx", "my"), borders_of(targets, order), cell).where("below").select("source", F.col("fid").alias("target"))
    holds = net.parity(first(targets, "target"), ("target", "mx", "my"), borders_of(sources, order), cell).where("below").select(F.col("fid").alias("source"), "target")
    inside = held.unionByName(holds).withColumn("distance", F.lit(0.0))
    return apart.unionByName(inside).groupBy("source", "target").agg(F.min("distance").alias("distance"))


def nearest(sources: DataFrame, targets: DataFrame, k: int = 1, max_distance: float | None = None, order: str = "_idx") -> DataFrame:
    """(source, target, distance, rank): the k nearest geometries, ties to the smaller target.

    Equal shapes are searched once: the k nearest targets are among the k smallest of each of the k nearest
    shapes, those under their smallest target.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    (left, left_of), (right, right_of) = alike(sources, order), alike(targets, order)
    near = _nearest_shapes(left, right, k, max_distance, order)
    nr = F.row_number().over(Window.partitionBy("shape").orderBy("member"))
    few = right_of.withColumn("nr", nr).where(F.col("nr") <= k).drop("nr")
    place = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target"))
    ranked = handed_out(near.drop("rank"), few, "target").withColumn("rank", place).where(F.col("rank") <= k)
    return handed_out(durable(ranked), left_of, "source").select("source", "target", "distance", "rank")


def _nearest_shapes(left: DataFrame, right: DataFrame, k: int, max_distance: float | None, order: str) -> DataFrame:
    """(source, target, distance, rank): the k nearest of distinct shapes, in rounds of growing distance."""
    box = g.bounds(F.col("geometry"))
    size = left.unionByName(right).select(box.alias("b")).agg(F.min("b.minx").alias("x0"), F.min("b.miny").alias("y0"), F.max("b.maxx").alias("x1"), F.max("b.maxy").alias("y1")).first()
    empty = left.sparkSession.createDataFrame([], "source bigint, target bigint, distance double, rank int")
    n = right.count()
    if not n or size.x0 is None:
        return empty
    diagonal = max(math.hypot(size.x1 - size.x0, size.y1 - size.y0), 1e-9)
    most = diagonal if max_distance is None else min(max_distance, diagonal)
    reach, found = min(most, max(diagonal * math.sqrt(k / n) / 2, diagonal * 1e-6)), empty
    place = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target"))
    while True:
        ranked = pairs_within(left, right, reach, order).withColumn("rank", place).where(F.col("rank") <= k)
        if reach >= most:
            return found.unionByName(ranked)
        ranked = durable(ranked)
        done = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") == min(k, n)).select("source")
        found = found.unionByName(ranked.join(done, "source", "left_semi"))
        left = durable(left.join(done, F.col(order) == F.col("source"), "left_anti"))
        if left.isEmpty():
            return found
        reach = min(most, reach * 4)


def nearest_neighbors(sources: DataFrame, targets: DataFrame, k: int = 1, max_distance: float | None = None, drop_unmatched: bool | None = None, distance_field: str = "_nearest_distance", order: str = "_idx", prefix: str = "target_") -> DataFrame:
    """As ``spatial.nearest_neighbors``, for layers with geometries; layers of x and y go there."""
    if "geometry" not in sources.columns or "geometry" not in targets.columns:
        return spatial.nearest_neighbors(sources, targets, k, max_distance, drop_unmatched, distance_field, order, prefix)
    drop = max_distance is not None if drop_unmatched is None else drop_unmatched
    found = nearest(sources, targets, k, max_distance, order)
    other = targets.select(F.col(order).alias("target"), *[F.col(c).alias(prefix + c) for c in targets.columns if c not in ("geometry", order)])
    joined = sources.join(found, sources[order] == found["source"], "inner" if drop else "left").drop("source").join(other, "target", "left")
    return joined.withColumnsRenamed({"target": "_target_index", "rank": "_neighbor_rank"}).withColumn("distance", even_round(F.col("distance"))).withColumnRenamed("distance", distance_field)


def distances(sources: DataFrame, targets: DataFrame, mode: str = "nearest", order: str = "_idx") -> DataFrame:
    """As ``spatial.distances``, for layers with geometries."""
    if "geometry" not in sources.columns or "geometry" not in targets.columns:
        return spatial.distances(sources, targets, mode, order)
    if mode == "nearest":
        return nearest(sources, targets, 1, None, order).select("source", "target", even_round(F.col("distance")).alias("distance"))
    box = g.bounds(F.col("geometry"))
    size = sources.select("geometry").unionByName(targets.select("geometry")).select(box.alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
    if size[0] is None:
        return sources.sparkSession.createDataFrame([], "source bigint, target bigint, distance double")
    # the full matrix is this mode's result
    (left, left_of), (right, right_of) = alike(sources, order), alike(targets, order)
    apart = pairs_within(left, right, math.hypot(size[2] - size[0], size[3] - size[1]), order).select("source", "target", even_round(F.col("distance")).alias("distance"))
    return handed_out(handed_out(apart, left_of, "source"), right_of, "target").select("source", "target", "distance")


def within_pairs(sources: DataFrame, targets: DataFrame, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """(source, target): sources that lie in a target polygon with more than its border."""
    from .overlay import Arrangement

    points = sources.where(g.is_point(F.col("geometry")))
    found = Arrangement([sources.where(~g.is_point(F.col("geometry"))), targets.where(g.is_polygon(F.col("geometry")))], order, cell)
    layer, id_ = F.pmod(F.col("fid"), F.lit(2)), F.floor(F.col("fid") / 2)
    side = lambda k, name: found.sides.where(layer == k).select(*net.EDGE, id_.alias(name), F.col("left").alias(f"{name}_left"), F.col("right").alias(f"{name}_right"))
    edge = list(net.EDGE)
    bit = lambda c: c.cast("int")
    # polygons: every side of an edge that the source covers, the target covers, too
    own = side(0, "source")
    whole = own.groupBy("source").agg(F.sum(bit(F.col("source_left")) + bit(F.col("source_right"))).alias("n"))
    shared = own.join(side(1, "target"), edge).groupBy("source", "target").agg(F.sum(bit(F.col("source_left") & F.col("target_left")) + bit(F.col("source_right") & F.col("target_right"))).alias("m"))
    polygons = shared.join(whole, "source").where("m = n").select("source", "target")
    # lines: every piece is in the target or on its border, and one is inside
    runs = net.undirected(found.pieces.where("not polygon")).select(id_.alias("source"), *edge).distinct()
    count = runs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    met = runs.join(side(1, "target"), edge).groupBy("source", "target").agg(F.count(F.lit(1)).alias("m"), F.sum(bit(F.col("target_left") & F.col("target_right"))).alias("inner"))
    lines = met.join(count, "source").where("m = n and inner > 0").select("source", "target")
    # points: all inside or on the border, one inside
    each = points.select(F.col(order).cast("bigint").alias("source"), F.posexplode("geometry.coords").alias("i", "p")).select("source", "i", F.get(F.get("p", 0), 0)["x"].alias("x"), F.get(F.get("p", 0), 0)["y"].alias("y"))
    coarse = 4 * found.cell
    where = targets.where(g.is_polygon(F.col("geometry"))).select(F.col(order).cast("bigint").alias("target"), F.col("geometry").alias("m"), F.explode(spatial.cells_of(g.bounds(F.col("geometry")), coarse)).alias("c"))
    hits = each.withColumn("c", spatial.cell_of(F.col("x"), F.col("y"), coarse)).join(where, "c").where(g.covers(F.col("m"), F.col("x"), F.col("y")) | g.on_boundary(F.col("m"), F.col("x"), F.col("y")))
    hit = hits.groupBy("source", "target").agg(F.count(F.lit(1)).alias("m"), F.sum(bit(g.contains(F.col("m"), F.col("x"), F.col("y")))).alias("inner"))
    dots = hit.join(each.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source").where("m = n and inner > 0").select("source", "target")
    return polygons.unionByName(lines).unionByName(dots)


def related_pairs(sources: DataFrame, targets: DataFrame, predicate: str = "intersects", distance: float = 0.0, order: str = "_idx") -> DataFrame:
    """(source, target) of geometries that intersect, are within, contain, or are within a distance."""
    (left, left_of), (right, right_of) = alike(sources, order), alike(targets, order)
    found = durable(_related_shapes(left, right, predicate, distance, order))
    return handed_out(handed_out(found, left_of, "source"), right_of, "target").select("source", "target")


def _related_shapes(sources: DataFrame, targets: DataFrame, predicate: str, distance: float, order: str) -> DataFrame:
    """``related_pairs`` of distinct shapes."""
    if predicate == "within":
        return within_pairs(sources, targets, order)
    if predicate == "contains":
        return within_pairs(targets, sources, order).select(F.col("target").alias("source"), F.col("source").alias("target"))
    if predicate not in ("intersects", "dwithin"):
        raise ValueError(f"unknown predicate {predicate}")
    return pairs_within(sources, targets, distance if predicate == "dwithin" else 0.0, order).select("source", "target")


def spatial_join(sources: DataFrame, targets: DataFrame, predicate: str = "intersects", distance: float = 0.0, join_type: str = "inner", cardinality: str = "first", order: str = "_idx", prefix: str = "target_", cell: float | None = None) -> DataFrame:
    """Sources with the attributes of the targets they relate to: the first by order, or all. Layers of x and y go to ``spatial.spatial_join``."""
    if "geometry" not in sources.columns:
        return spatial.spatial_join(sources, targets, cell or 1.0, predicate, distance, join_type, cardinality, order, prefix)
    (left, left_of), (right, right_of) = alike(sources, order), alike(targets, order)
    pairs = durable(_related_shapes(left, right, predicate, distance, order))
    # a shape's id is the smallest of its features
    counts = pairs.join(right_of.groupBy(F.col("shape").alias("target")).agg(F.count(F.lit(1)).alias("m")), "target").groupBy("source").agg(F.min("target").alias("first"), F.sum("m").alias("_joined_count"))
    hits = counts.withColumnRenamed("first", "target") if cardinality == "first" else handed_out(pairs, right_of, "target").join(counts.drop("first"), "source")
    hits = handed_out(hits, left_of, "source")
    other = targets.select(F.col(order).alias("target"), *[F.col(c).alias(prefix + c) for c in targets.columns if c not in ("geometry", order)])
    joined = sources.join(hits, sources[order] == hits["source"], "inner" if join_type == "inner" else "left").drop("source").join(other, "target", "left").withColumnRenamed("target", "_target_index")
    return joined.withColumn("_joined_count", F.coalesce("_joined_count", F.lit(0))).withColumn("_join_status", F.when(F.col("_target_index").isNull(), "unmatched").otherwise("matched"))


# distances in metres on longitude and latitude

#: Metres of a degree of longitude at the equator and of latitude, and the earth's radius.
LON_M, LAT_M, EARTH_M = 111_320.0, 110_540.0, 6_371_000.0


def metres(x: str, y: str, s: tuple[str, str, str, str], dot: str) -> Column:
    """Metres from a place to a segment in a plane at the place's latitude, or along the great circle to a point."""
    wide = F.cos(F.radians(F.col(y))) * LON_M
    px, py = F.col(x) * wide, F.col(y) * LAT_M
    one = F.struct(F.struct((F.col(s[0]) * wide).alias("x"), (F.col(s[1]) * LAT_M).alias("y")).alias("a"), F.struct((F.col(s[2]) * wide).alias("x"), (F.col(s[3]) * LAT_M).alias("y")).alias("b"))
    return F.when(F.col(dot), g.haversine(F.col(x), F.col(y), F.col(s[0]), F.col(s[1]), EARTH_M)).otherwise(g.segment_distance(one, px, py))


def nearest_metres(places: DataFrame, targets: DataFrame, first: float = 500.0) -> DataFrame:
    """(id, metres) of the nearest target of each place (id, x, y), in rounds of four times the distance; equal places are searched once.

    A round looks into all cells that the distance reaches, in degrees at the place's latitude, so a found distance
    up to it can't be beaten; the last round looks everywhere.
    """
    marked, _ = alike(targets.select(F.monotonically_increasing_id().alias("fid"), "geometry"), "fid")
    everyone, places = places, durable(places.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"))
    names = ("ax", "ay", "bx", "by")
    pieces = durable(pieces_of(marked, "fid").join(marked.select("fid", g.is_point(F.col("geometry")).alias("dot")), "fid"))
    # inside a polygon the distance is 0
    cell = net.grid_cell(pieces)
    held = net.parity(places.select("id", F.col("x").alias("mx"), F.col("y").alias("my")), ("id", "mx", "my"), borders_of(marked, "fid"), cell).where("below").select("id").distinct()
    found = durable(held.withColumn("metres", F.lit(0.0)))
    left = durable(places.join(held, "id", "left_anti"))
    reach = first
    while not left.isEmpty() and not pieces.isEmpty():
        last = reach > 5e6
        step = max(reach / LAT_M, 1e-6)
        if last:
            near = left.crossJoin(pieces)  # places farther than 5,000 km from every target
        else:
            # a cell is as high as the reach; to the sides as many as the latitude asks for
            wide = F.ceil(F.lit(1.05) / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("y")) + step))), F.lit(0.02)))
            cx, cy = net.slot(F.col("x"), step), net.slot(F.col("y"), step, net.OFFSET_Y)
            around = F.flatten(F.transform(F.sequence(cx - wide, cx + wide), lambda c: F.transform(F.sequence(cy - 2, cy + 2), lambda r: F.struct(c.alias("cx"), r.alias("cy")))))
            near = left.select("*", F.explode(around).alias("c")).join(pieces.select("*", F.explode(net.crossed_cells(*names, step)).alias("c")), "c")
        least = durable(near.select("id", metres("x", "y", names, "dot").alias("metres")).groupBy("id").agg(F.min("metres").alias("metres")))
        settled = least if last else least.where(F.col("metres") <= reach)
        found = found.unionByName(settled)
        left = durable(left.join(settled, "id", "left_anti"))
        reach *= 4
        if last:
            break
    return everyone.join(places.withColumnRenamed("id", "spot"), ["x", "y"]).join(found.withColumnRenamed("id", "spot"), "spot").select("id", "metres")


def enrich_real_estate(features: DataFrame, metro: DataFrame | None = None, malls: DataFrame | None = None, main_roads: DataFrame | None = None, allowed_zones: DataFrame | None = None, order: str = "_idx") -> DataFrame:
    """Missing distances to metro, malls and main roads (whole metres) and missing zone marks, from the layers that are given; what is there stays.

    A distance counts as missing if it is null, blank or no number, a mark if all three of its names are null. Features
    take part with the first vertex of a point, else with their centroid; rows that got something have spatial_enrichment_applied.
    """
    here = F.when(g.is_point(F.col("geometry")), F.struct(g.x_of(F.col("geometry")).alias("x"), g.y_of(F.col("geometry")).alias("y"))).otherwise(g.centroid(F.col("geometry")))
    places = durable(features.select(F.col(order).cast("bigint").alias("id"), here.alias("p")).select("id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).where("x is not null and y is not null"))
    out, touched = features, F.lit(False)
    for layer, field in ((metro, "distance_to_metro_m"), (malls, "distance_to_mall_m"), (main_roads, "distance_to_main_road_m")):
        if layer is None:
            continue
        known = loose(features, field).isNotNull() if field in features.columns else F.lit(False)
        need = places.join(features.where(~known).select(F.col(order).cast("bigint").alias("id")), "id", "left_semi")
        got = nearest_metres(need, layer).select(F.col("id").alias("__id"), F.bround("metres", 0).cast("bigint").alias(f"__{field}"))
        out = out.join(got, F.col(order) == F.col("__id"), "left").drop("__id")
        kind = features.schema[field].dataType.simpleString() if field in features.columns else "bigint"
        old = F.when(loose(features, field).isNotNull(), F.col(field)) if field in features.columns else F.lit(None).cast(kind)
        out = out.withColumn(field, F.coalesce(old, F.col(f"__{field}").cast(kind)))
        touched = touched | F.col(f"__{field}").isNotNull()
    marks = ("in_allowed_zone", "build_zone_allowed", "construction_allowed")
    if allowed_zones is not None:
        zones = durable(allowed_zones.where("geometry is not null").select(F.monotonically_increasing_id().alias("fid"), "geometry"))
        borders = durable(borders_of(zones, "fid"))
        cell = net.grid_cell(borders.withColumnsRenamed({"px": "ax", "py": "ay", "qx": "bx", "qy": "by"}))
        held = net.parity(places.select("id", F.col("x").alias("mx"), F.col("y").alias("my")), ("id", "mx", "my"), borders, cell).where("below").select(F.col("id").alias("__id")).distinct()
        some = places.select(F.col("id").alias("__id")).join(held.withColumn("__in", F.lit(True)), "__id", "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
        out = out.join(some, F.col(order) == F.col("__id"), "left").drop("__id")
        set_ = F.lit(False)
        for m in marks:
            set_ = set_ | (F.col(m).isNotNull() if m in features.columns else F.lit(False))
        out = out.withColumn("__new", ~set_ & F.col("__in").isNotNull())
        touched = touched | F.col("__new")
        for m in marks:
            kind = features.schema[m].dataType.simpleString() if m in features.columns else "boolean"
            old = F.col(m) if m in features.columns else F.lit(None).cast("boolean")
            out = out.withColumn(m, F.when(F.col("__new"), F.col("__in").cast(kind)).otherwise(old))
    if metro is None and malls is None and main_roads is None and allowed_zones is None:
        return features
    out = out.withColumn("spatial_enrichment_applied", F.when(touched, True))
    return out.drop(*[c for c in out.columns if c.startswith("__")])
