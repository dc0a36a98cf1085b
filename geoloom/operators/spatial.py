"""Spatial joins, nearest neighbours and statistics over points and polygons.

All joins are equi joins on grid cells followed by an exact test, so they
shuffle by cell and never compare all pairs. ``cell`` is the edge of a grid cell
in map units; a good one is about as large as the search distance or a typical
polygon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import even_round, local, loose
from .storage import durable


def cell_of(x: Column, y: Column, cell: float) -> Column:
    return F.struct(F.floor(x / cell).alias("cx"), F.floor(y / cell).alias("cy"))


def cells_of(box: Column, cell: float, margin: float = 0.0) -> Column:
    """All cells that a box, widened by a margin, touches."""
    span = lambda low, high: F.sequence(F.floor((low - margin) / cell), F.floor((high + margin) / cell))
    return F.flatten(F.transform(span(box["minx"], box["maxx"]), lambda cx: F.transform(span(box["miny"], box["maxy"]), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def point_pairs(points: DataFrame, polygons: DataFrame, cell: float, predicate: str = "intersects", distance: float = 0.0, point_id: str = "_idx", polygon_id: str = "_idx", carry: tuple[str, ...] = ()) -> DataFrame:
    """(source, target) ids of points (x, y) and polygons (geometry) that meet the predicate, with the points' columns of ``carry``.

    ``intersects`` counts the boundary, ``within`` does not, ``dwithin`` allows a
    distance. Each point is in one cell and each polygon once in a cell, so no
    pair comes twice.
    """
    margin = distance if predicate == "dwithin" else g.EPS
    left = points.where("x is not null and y is not null").select(F.col(point_id).alias("source"), *carry, "x", "y", cell_of(F.col("x"), F.col("y"), cell).alias("c"))
    right = polygons.where("geometry is not null").select(F.col(polygon_id).alias("target"), "geometry", F.explode(cells_of(g.bounds(F.col("geometry")), cell, margin)).alias("c"))
    x, y, shape = F.col("x"), F.col("y"), F.col("geometry")
    test = {"intersects": lambda: g.covers(shape, x, y), "within": lambda: g.contains(shape, x, y), "dwithin": lambda: g.distance(shape, x, y) <= distance}[predicate]()
    box = g.bounds(shape)
    near = x.between(box["minx"] - margin, box["maxx"] + margin) & y.between(box["miny"] - margin, box["maxy"] + margin)
    return left.join(right, "c").where(near).where(test).select("source", "target", *carry)


def spatial_join(points: DataFrame, polygons: DataFrame, cell: float, predicate: str = "intersects", distance: float = 0.0, join_type: str = "inner", cardinality: str = "first", order: str = "_idx", prefix: str = "target_") -> DataFrame:
    """Points with the attributes of polygons they meet: the first by order, or all.

    ``_joined_count`` is the number of all matches even if only the first is given.
    """
    pairs = point_pairs(points, polygons, cell, predicate, distance, order, order)
    if cardinality == "first":
        hits = pairs.groupBy("source").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("_joined_count"))
    else:
        counts = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("_joined_count"))
        hits = pairs.join(counts, "source")
    attributes = [c for c in polygons.columns if c not in ("geometry", order)]
    other = polygons.select(F.col(order).alias("target"), *[F.col(c).alias(prefix + c) for c in attributes])
    joined = points.join(hits, points[order] == hits["source"], "inner" if join_type == "inner" else "left").drop("source")
    out = joined.join(other, "target", "left").withColumnRenamed("target", "_target_index")
    return out.withColumn("_joined_count", F.coalesce("_joined_count", F.lit(0))).withColumn("_join_status", F.when(F.col("_target_index").isNull(), "unmatched").otherwise("matched"))


def filter_points_in_polygon(points: DataFrame, polygons: DataFrame, cell: float, predicate: str = "within", drop_outside: bool = True, order: str = "_idx") -> DataFrame:
    """Points inside (boundary included) or outside any polygon; or all, with ``__in_polygon__``."""
    hits = point_pairs(points, polygons, cell, "intersects", 0.0, order, order).select(F.col("source").alias(order)).distinct()
    if not drop_outside:
        return points.join(hits.withColumn("__in_polygon__", F.lit(True)), order, "left").withColumn("__in_polygon__", F.coalesce("__in_polygon__", F.lit(False)))
    return points.join(hits, order, "left_semi" if predicate == "within" else "left_anti")


def aggregate_points(points: DataFrame, polygons: DataFrame, cell: float, value_field: str | None = None, stats: tuple[str, ...] = ("sum", "mean", "min", "max"), density: bool = False, order: str = "_idx") -> DataFrame:
    """Polygons with the count and statistics of the points inside; those without any stay."""
    value = loose(points, value_field) if value_field else F.lit(None).cast("double")
    valued = points.select(order, "x", "y", value.alias("__v"))
    made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    hits = point_pairs(valued, polygons, cell, "intersects", 0.0, order, order, ("__v",))
    sums = hits.groupBy(F.col("target").alias(order)).agg(F.count(F.lit(1)).alias("point_count"), *[made[s]("__v").alias(f"{value_field}_{s}") for s in (stats if value_field else ())])
    out = polygons.join(sums, order, "left").withColumn("point_count", F.coalesce("point_count", F.lit(0)))
    if density:
        size = g.area(F.col("geometry"))
        out = out.withColumn("density", F.when(size > 0, F.col("point_count") / size))
    return out


def nearest(sources: DataFrame, targets: DataFrame, k: int = 1, max_distance: float | None = None, order: str = "_idx", cell: float | None = None) -> DataFrame:
    """(source, target, distance, rank): the k nearest points, ties to the smaller target.

    Rounds over grids that double: a source is done when its k-th candidate in
    the nine cells around it is no farther than a cell's edge, which no point
    outside these cells can beat; the others go on to the next round.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    left = sources.where("x is not null and y is not null").select(F.col(order).alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    right = durable(targets.where("x is not null and y is not null").select(F.col(order).alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")))
    n, x0, x1, y0, y1 = right.agg(F.count(F.lit(1)), F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    a0, a1, b0, b1 = left.agg(F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy")).first()
    found = None
    if n and a0 is not None:
        extent = max(x1 - x0, y1 - y0, max(a1, x1) - min(a0, x0), max(b1, y1) - min(b0, y0), 1e-9)
        edge = cell or max(math.sqrt(max(x1 - x0, 1e-9) * max(y1 - y0, 1e-9) * k / n), extent / 1e6)
        if max_distance is not None:
            edge = min(edge, max_distance) if max_distance > 0 else edge
        while True:
            last = edge >= extent or (max_distance is not None and edge >= max_distance)
            around = F.explode(F.array(*[F.struct((F.floor(F.col("sx") / edge) + dx).alias("cx"), (F.floor(F.col("sy") / edge) + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("c")
            pairs = left.select("*", around).join(right.select("*", cell_of(F.col("tx"), F.col("ty"), edge).alias("c")), "c")
            gap = F.sqrt(F.pow(F.col("sx") - F.col("tx"), 2) + F.pow(F.col("sy") - F.col("ty"), 2))
            pairs = pairs.select("source", "target", gap.alias("distance"))
            if max_distance is not None:
                pairs = pairs.where(F.col("distance") <= max_distance)
            place = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target"))
            ranked = pairs.withColumn("rank", place).where(F.col("rank") <= k)
            if last:
                found = ranked if found is None else found.unionByName(ranked)
                break
            ranked = durable(ranked)
            done = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("m"), F.max("distance").alias("far")).where((F.col("m") == k) & (F.col("far") <= edge)).select("source")
            settled = ranked.join(done, "source", "left_semi")
            found = settled if found is None else found.unionByName(settled)
            left = durable(left.join(done, "source", "left_anti"))
            if left.isEmpty():
                break
            edge *= 4
    empty = sources.sparkSession.createDataFrame([], "source bigint, target bigint, distance double, rank int")
    return empty if found is None else found


def nearest_neighbors(sources: DataFrame, targets: DataFrame, k: int = 1, max_distance: float | None = None, drop_unmatched: bool | None = None, distance_field: str = "_nearest_distance", order: str = "_idx", prefix: str = "target_") -> DataFrame:
    """Sources with distance, rank and attributes of their nearest targets; a row for each rank."""
    drop = max_distance is not None if drop_unmatched is None else drop_unmatched
    found = nearest(sources, targets, k, max_distance, order)
    other = targets.select(F.col(order).alias("target"), *[F.col(c).alias(prefix + c) for c in targets.columns if c not in ("x", "y", order)])
    joined = sources.join(found, sources[order] == found["source"], "inner" if drop else "left").drop("source").join(other, "target", "left")
    return joined.withColumnsRenamed({"target": "_target_index", "rank": "_neighbor_rank"}).withColumn("distance", even_round(F.col("distance"))).withColumnRenamed("distance", distance_field)


def distances(sources: DataFrame, targets: DataFrame, mode: str = "nearest", order: str = "_idx") -> DataFrame:
    """(source, target, distance): the nearest target of each source, or every pair where pairs are asked for."""
    if mode == "nearest":
        return nearest(sources, targets, 1, None, order).select("source", "target", even_round(F.col("distance")).alias("distance"))
    left = sources.select(F.col(order).alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    right = targets.select(F.col(order).alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    gap = F.sqrt(F.pow(F.col("sx") - F.col("tx"), 2) + F.pow(F.col("sy") - F.col("ty"), 2))
    return left.crossJoin(right).select("source", "target", even_round(gap).alias("distance"))  # the full matrix is this mode's result


def connection_lines(joined: DataFrame) -> DataFrame:
    """Lines from sources (x, y) to their target's place (target_x, target_y); rows without both go."""
    known = joined.where("x is not null and y is not null and target_x is not null and target_y is not null")
    return known.withColumn("geometry", g.line(F.array(g.vertex(F.col("x"), F.col("y")), g.vertex(F.col("target_x"), F.col("target_y")))))


def neighbours(points: DataFrame, weights: str = "knn", k: int = 8, distance: float | None = None, order: str = "_idx") -> DataFrame:
    """Directed neighbour pairs (i, j), i <> j: the k nearest others, or all others within a distance."""
    if weights == "knn":
        near = nearest(points, points, k + 1, None, order).where("source <> target")
        place = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target"))
        return near.withColumn("n", place).where(F.col("n") <= k).select(F.col("source").alias("i"), F.col("target").alias("j"))
    left = points.select(F.col(order).alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    box = F.struct((F.col("ax") - distance).alias("minx"), (F.col("ay") - distance).alias("miny"), (F.col("ax") + distance).alias("maxx"), (F.col("ay") + distance).alias("maxy"))
    right = points.select(F.col(order).alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), cell_of(F.col("x"), F.col("y"), distance).alias("c"))
    gap = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return left.select("*", F.explode(cells_of(box, distance)).alias("c")).join(right, "c").where((gap <= distance) & (F.col("i") != F.col("j"))).select("i", "j")


def places_of(points: DataFrame, order: str, *sums: Column) -> DataFrame:
    """Places (x, y) once, with _idx, the smallest id there, n, how many points are there, and sums."""
    known = points.where("x is not null and y is not null")
    return durable(known.groupBy("x", "y").agg(F.min(order).alias("_idx"), F.count(F.lit(1)).alias("n"), *sums))


def places_around(places: DataFrame, distance: float) -> DataFrame:
    """Directed pairs (i, j) of places within a distance, each also with itself."""
    return neighbours(places, "distance", distance=distance).unionByName(places.select(F.col("_idx").alias("i"), F.col("_idx").alias("j")))


def at_places(points: DataFrame, places: DataFrame, order: str, name: str) -> DataFrame:
    """(name, place): the ids of points with that of their place."""
    return points.select(F.col(order).alias(name), "x", "y").join(places.select("x", "y", F.col("_idx").alias("place")), ["x", "y"]).select(name, "place")


def hotspots(points: DataFrame, field: str, weights: str = "knn", k: int = 8, distance: float | None = None, order: str = "_idx") -> DataFrame:
    """Getis-Ord Gi* with the row itself: z-score, two-sided p and bin from -3 to 3; needs 8 values."""
    valued = durable(points.withColumn("__v", local(points, field)).where(F.col("__v").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()))
    n, mean, sd = valued.agg(F.count(F.lit(1)), F.avg("__v"), F.stddev_pop("__v")).first()
    if n < 8 or not sd:
        raise ValueError("needs at least 8 values that aren't all equal")
    if weights == "knn":
        values = valued.select(F.col(order).alias("j"), "__v")
        pairs = neighbours(valued, weights, k, distance, order).unionByName(values.select(F.col("j").alias("i"), "j"))
        around = pairs.join(values, "j").groupBy("i").agg(F.sum("__v").alias("s"), F.count(F.lit(1)).alias("w"))
    else:
        # points at one place have the same neighbours
        places = places_of(valued, order, F.sum("__v").alias("v"))
        sums = places_around(places, distance).join(places.select(F.col("_idx").alias("j"), "n", "v"), "j").groupBy(F.col("i").alias("place")).agg(F.sum("v").alias("s"), F.sum("n").alias("w"))
        around = at_places(valued, places, order, "i").join(sums, "place").drop("place")
    z = (F.col("s") - mean * F.col("w")) / (sd * F.sqrt((n * F.col("w") - F.col("w") * F.col("w")) / (n - 1)))
    scored = around.select(F.col("i").alias(order), F.when(F.col("w") < n, z).otherwise(0.0).alias("gi_z"))
    size = F.abs("gi_z")
    level = F.when(size >= 2.576, 3).when(size >= 1.96, 2).when(size >= 1.645, 1).otherwise(0)
    out = points.join(scored, order, "left")
    return out.withColumn("gi_bin", F.when(F.col("gi_z").isNotNull(), level * F.signum("gi_z").cast("int"))).withColumn("gi_z", even_round(F.col("gi_z")))


def morans_i(points: DataFrame, field: str, weights: str = "knn", k: int = 8, distance: float | None = None, row_standardize: bool = True, order: str = "_idx") -> DataFrame:
    """One row: Moran's I, its expectation, variance under normality, z-score and the number of rows."""
    valued = durable(points.withColumn("__v", local(points, field)).where(F.col("__v").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()))
    n, mean = valued.agg(F.count(F.lit(1)), F.avg("__v")).first()
    one = _moran_sums(valued, k, mean, row_standardize, order) if weights == "knn" else _moran_sums_of_places(valued, distance, mean, row_standardize, order)
    i = F.lit(float(n)) / F.col("s0") * F.col("cross") / F.col("m2")
    expected = -1.0 / (n - 1)
    variance = (n * n * F.col("s1") - n * F.col("s2") + 3 * F.col("s0") * F.col("s0")) / (F.col("s0") * F.col("s0") * (n * n - 1)) - expected * expected
    return one.select(even_round(i).alias("morans_i"), even_round(F.lit(expected)).alias("expected_i"), even_round(variance, 9).alias("variance"), even_round((i - expected) / F.sqrt(variance)).alias("z_score"), F.lit(n).cast("bigint").alias("n"))


def _moran_sums_of_places(valued: DataFrame, distance: float, mean: float, row_standardize: bool, order: str) -> DataFrame:
    """s0, cross, m2, s1, s2 of neighbours within a distance: points at one place have the same ones, so places are paired and their sums taken."""
    z = F.col("__v") - F.lit(mean)
    places = places_of(valued, order, F.sum(z).alias("z"), F.sum(z * z).alias("zz"))
    pairs = places_around(places, distance)
    others = pairs.join(places.select(F.col("_idx").alias("j"), "n"), "j").groupBy(F.col("i").alias("_idx")).agg((F.sum("n") - 1).alias("d"))
    weight = F.when(F.col("d") > 0, 1.0 / F.col("d")) if row_standardize else F.when(F.col("d") > 0, F.lit(1.0))
    each = durable(places.join(others, "_idx").select("_idx", F.col("n").cast("double").alias("n"), "z", "zz", F.col("d").cast("double").alias("d"), F.coalesce(weight, F.lit(0.0)).alias("w")))
    left, right = (each.select(F.col("_idx").alias(k), *[F.col(c).alias(c + k) for c in ("n", "z", "w")]) for k in "ij")
    met = pairs.join(left, "i").join(right, "j")
    both = F.col("ni") * F.col("nj") - F.when(F.col("i") == F.col("j"), F.col("ni")).otherwise(0.0)
    sums = met.groupBy(F.col("i").alias("_idx")).agg(F.sum("zj").alias("around"), F.sum(F.col("nj") * F.col("wj")).alias("into"), (F.sum(both * F.pow(F.col("wi") + F.col("wj"), 2)) / 2).alias("s1"))
    row, column = F.col("d") * F.col("w"), F.col("into") - F.col("w")
    s0 = F.sum(F.col("n") * row)
    return each.join(sums, "_idx").agg(F.when(s0 > 0, s0).alias("s0"), F.sum(F.col("w") * (F.col("z") * F.col("around") - F.col("zz"))).alias("cross"), F.sum("zz").alias("m2"), F.sum("s1").alias("s1"), F.sum(F.col("n") * F.pow(row + column, 2)).alias("s2"))


def _moran_sums(valued: DataFrame, k: int, mean: float, row_standardize: bool, order: str) -> DataFrame:
    """s0, cross, m2, s1, s2 of the k nearest neighbours."""
    pairs = durable(neighbours(valued, "knn", k, None, order))
    out_degree = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    edges = pairs.join(out_degree, "i").select("i", "j", (1.0 / F.col("d") if row_standardize else F.lit(1.0)).alias("w"))
    dev = valued.select(F.col(order).alias("id"), (F.col("__v") - F.lit(mean)).alias("z"))
    crossed = edges.join(dev.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(dev.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    top = crossed.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("cross"))
    bottom = dev.agg(F.sum(F.col("z") * F.col("z")).alias("m2"))
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    both = edges.join(back, ["i", "j"], "full").agg((F.sum(F.pow(F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), 2)) / 2).alias("s1"))
    rows, columns = edges.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("r")), edges.groupBy(F.col("j").alias("id")).agg(F.sum("w").alias("c"))
    s2 = rows.join(columns, "id", "full").agg(F.sum(F.pow(F.coalesce("r", F.lit(0.0)) + F.coalesce("c", F.lit(0.0)), 2)).alias("s2"))
    return top.crossJoin(bottom).crossJoin(both).crossJoin(s2)  # four tables of one row


def kernel_density(points: DataFrame, cell_size: float, bandwidth: float, weight_field: str | None = None, kernel: str = "gaussian", bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(row, col, density) of the cells that points reach; gaussian up to three bandwidths, others one.

    Rows count from the north. The grid starts at the west and north of ``bbox``,
    or of the points' extent widened by the kernel's reach. No points give no rows.
    """
    weight = F.coalesce(loose(points, weight_field), F.lit(0.0)) if weight_field else F.lit(1.0)
    reach = bandwidth * (3 if kernel == "gaussian" else 1)
    usable = points.where("x is not null and y is not null").select("x", "y", weight.alias("__w")).where("__w > 0")
    if bbox is None:
        low_x, low_y, high_x, high_y = usable.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        bbox = (0.0, 0.0, 0.0, 0.0) if low_x is None else (low_x - reach, low_y - reach, high_x + reach, high_y + reach)
    west, south, east, north = bbox
    right, down = F.col("x") - west, F.lit(north) - F.col("y")
    box = F.struct((right - reach).alias("minx"), (down - reach).alias("miny"), (right + reach).alias("maxx"), (down + reach).alias("maxy"))
    spread = usable.select("x", "y", "__w", F.explode(cells_of(box, cell_size)).alias("c"))
    spread = spread.where(F.col("c.cx").between(0, max(1, math.ceil((east - west) / cell_size)) - 1) & F.col("c.cy").between(0, max(1, math.ceil((north - south) / cell_size)) - 1))
    centre_x, centre_y = F.lit(west) + (F.col("c.cx") + 0.5) * cell_size, F.lit(north) - (F.col("c.cy") + 0.5) * cell_size
    d2 = (F.pow(F.col("x") - centre_x, 2) + F.pow(F.col("y") - centre_y, 2)) / (bandwidth * bandwidth)
    shape = {"gaussian": F.exp(-d2 / 2) / (2 * math.pi), "quartic": 3 / math.pi * F.pow(1 - d2, 2), "epanechnikov": 2 / math.pi * (1 - d2)}[kernel] / (bandwidth * bandwidth)
    inside = d2 <= (9 if kernel == "gaussian" else 1)
    return spread.where(inside).groupBy(F.col("c.cy").alias("row"), F.col("c.cx").alias("col")).agg(even_round(F.sum(shape * F.col("__w")), 9).alias("density"))


def interpolate_idw(points: DataFrame, value_field: str, cell_size: float, bbox: tuple[float, float, float, float], power: float = 2.0, neighbors: int = 12, nodata: float = -9999.0, order: str = "_idx", search_radius: float | None = None) -> DataFrame:
    """(row, col, value) of every cell in the box from its nearest samples, within the radius if there is one; a sample at the centre decides alone."""
    valued = points.withColumn("__v", local(points, value_field)).where("__v is not null and x is not null and y is not null")
    columns, rows = max(1, math.ceil((bbox[2] - bbox[0]) / cell_size)), max(1, math.ceil((bbox[3] - bbox[1]) / cell_size))
    cells = points.sparkSession.range(rows * columns).select(F.col("id").alias(order), (F.lit(bbox[0]) + (F.col("id") % columns + 0.5) * cell_size).alias("x"), (F.lit(bbox[3]) - (F.floor(F.col("id") / columns) + 0.5) * cell_size).alias("y"))
    near = nearest(cells, valued, neighbors, search_radius, order).join(valued.select(F.col(order).alias("target"), "__v"), "target")
    weight = 1 / F.pow(F.col("distance"), power)
    exact = F.col("distance") < 1e-12
    sums = near.groupBy("source").agg(F.avg(F.when(exact, F.col("__v"))).alias("hit"), (F.sum(F.when(~exact, weight * F.col("__v"))) / F.sum(F.when(~exact, weight))).alias("mean"))
    joined = cells.select(F.col(order).alias("source")).join(sums, "source", "left")
    return joined.select(F.floor(F.col("source") / columns).alias("row"), (F.col("source") % columns).alias("col"), even_round(F.coalesce("hit", "mean", F.lit(nodata))).alias("value"))


def dbscan(points: DataFrame, eps: float, min_samples: int = 5, order: str = "_idx") -> DataFrame:
    """cluster_id (from 0 by smallest member; -1 for noise) and cluster_size by density.

    Core points that are within eps are linked; a label spreads from the
    smallest member with pointer jumping, so long chains take few rounds.
    Border points go to the cluster of their smallest core neighbour.
    """
    from .attributes import number_rows

    # points at one place have the same neighbours; a place goes by its smallest point
    places = places_of(points, order)
    pairs = durable(places_around(places, eps))
    core = durable(pairs.join(places.select(F.col("_idx").alias("j"), "n"), "j").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("i"))
    links = pairs.join(core, "i", "left_semi").join(core.withColumnRenamed("i", "j"), "j", "left_semi")
    labels = label_components(core.withColumnRenamed("i", "node"), links.select(F.col("i").alias("a"), F.col("j").alias("b")))
    border = pairs.join(core, "i", "left_anti").join(core.withColumnRenamed("i", "j"), "j", "left_semi").groupBy("i").agg(F.min("j").alias("node"))
    found = labels.unionByName(border.join(labels, "node").select(F.col("i").alias("node"), "label")).withColumnRenamed("node", "place")
    members = at_places(points, places, order, "node").join(found, "place").select("node", "label")
    if min_samples <= 1:  # points without a place are clusters, too
        members = members.unionByName(points.where("x is null or y is null").select(F.col(order).alias("node"), F.col(order).alias("label")))
    members = durable(members)
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("cluster_size"))
    numbered = number_rows(sizes, "label", name="cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("int"))
    joined = points.join(members.join(numbered, "label"), points[order] == F.col("node"), "left")
    return joined.drop("node", "label").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def label_components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each component.

    Links are rewritten until every one points from a node to its component's
    smallest: first each node's larger neighbours, then its smaller ones, are
    linked to the smallest node around it. That takes a number of rounds that
    grows with the logarithm of the longest chain.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    seen = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = durable(small.where("a <> b").distinct())
        before, seen = seen, state(edges)
        if seen == before:
            roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
            return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def kmeans(points: DataFrame, k: int, seed: int = 0, max_iterations: int = 100) -> DataFrame:
    """cluster_id and distance_to_center by k-means on x and y."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import VectorAssembler

    known = VectorAssembler(inputCols=["x", "y"], outputCol="__xy").transform(points.where("x is not null and y is not null"))
    model = KMeans(k=k, seed=seed, maxIter=max_iterations, featuresCol="__xy", predictionCol="cluster_id").fit(known)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    own = F.get(centres, F.col("cluster_id"))
    here = vector_to_array("__xy")
    gap = F.sqrt(F.pow(here[0] - own[0], 2) + F.pow(here[1] - own[1], 2))
    return model.transform(known).withColumn("distance_to_center", even_round(gap)).drop("__xy")


def cluster(points: DataFrame, method: str = "dbscan", **options) -> DataFrame:
    """Clusters by density (dbscan: eps, min_samples) or around centres (kmeans: k, seed, max_iterations)."""
    if method not in ("dbscan", "kmeans"):
        raise ValueError(f"unknown method {method}")
    return {"dbscan": dbscan, "kmeans": kmeans}[method](points, **options)
