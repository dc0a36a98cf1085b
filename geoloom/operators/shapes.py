"""Operators that make or measure geometries of a layer with a ``geometry`` column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import even_round


def area_perimeter(df: DataFrame) -> DataFrame:
    """_area, _perimeter (polygons) and _length (lines), to six places."""
    shape = F.col("geometry")
    size = g.length(shape)
    polygon = g.is_polygon(shape)
    return df.withColumns({"_area": even_round(g.area(shape)), "_perimeter": even_round(F.when(polygon, size).when(shape.isNotNull(), 0.0)), "_length": even_round(F.when(polygon, 0.0).otherwise(size))})


def centroids(df: DataFrame, precision: int = 8) -> DataFrame:
    """Geometries replaced by their centroid; null stays null."""
    c = g.centroid(F.col("geometry"))
    return df.withColumn("geometry", g.point(even_round(c["x"], precision), even_round(c["y"], precision)))


def envelope(df: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """The bounding rectangle of each group, its area and number of features."""
    b = g.bounds(F.col("geometry"))
    sums = df.groupBy(*(group_by or [])).agg(F.min(b["minx"]).alias("x0"), F.min(b["miny"]).alias("y0"), F.max(b["maxx"]).alias("x1"), F.max(b["maxy"]).alias("y1"), F.count("geometry").alias("feature_count"))
    shape = g.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return sums.where("feature_count > 0").withColumn("shape_area", even_round(g.area(shape))).withColumn("geometry", shape).drop("x0", "y0", "x1", "y1")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, collinear points left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out: list = []
    for row in (points, points[::-1]):
        half: list = []
        for p in row:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        out += half[:-1]
    return out


def convex_hull(df: DataFrame, group_by: str) -> DataFrame:
    """(group, hull vertices as geometry, shape_area, feature_count).

    Hulls are taken in two steps: within salted parts of a group, then of the
    parts' hulls, which are small; so no task holds a whole group.
    """
    vertices = df.where("geometry is not null").select(F.col(group_by).alias("k"), F.explode(g.vertices(F.col("geometry"))).alias("v"))
    salted = vertices.withColumn("salt", F.pmod(F.xxhash64("v.x", "v.y"), F.lit(64)).cast("int")).select("k", "salt", "v.x", "v.y")
    kind = df.schema[group_by].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = hull(list(zip(pdf["x"], pdf["y"], strict=True)))
        return pd.DataFrame({"k": [key[0]] * len(found), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    parts = salted.groupBy("k", "salt").applyInPandas(one, f"k {kind}, x double, y double")

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = hull(list(zip(pdf["x"], pdf["y"], strict=True)))
        return pd.DataFrame({"k": [key[0]], "ring": [[{"x": x, "y": y} for x, y in [*found, *found[:1]]]]})

    whole = parts.groupBy("k").applyInPandas(last, f"k {kind}, ring {g.RING}")
    counts = df.where("geometry is not null").groupBy(F.col(group_by).alias("k2")).agg(F.count(F.lit(1)).alias("feature_count"))
    joined = whole.join(counts, F.col("k").eqNullSafe(F.col("k2"))).drop("k2")
    return joined.select(F.col("k").alias(group_by), g.polygon(F.col("ring")).alias("geometry"), even_round(F.abs(g.ring_area(F.col("ring")))).alias("shape_area"), "feature_count")


def turned_box(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The smallest rectangle around a hull; one of its sides lies along one of the hull's."""
    best: tuple | None = None
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        size = math.hypot(bx - ax, by - ay)
        if not size:
            continue
        ux, uy = (bx - ax) / size, (by - ay) / size
        along, across = [x * ux + y * uy for x, y in points], [y * ux - x * uy for x, y in points]
        s0, s1, t0, t1 = min(along), max(along), min(across), max(across)
        if best is None or (s1 - s0) * (t1 - t0) < best[0]:
            best = ((s1 - s0) * (t1 - t0), [(s * ux - t * uy, s * uy + t * ux) for s, t in ((s0, t0), (s1, t0), (s1, t1), (s0, t1))])
    return best[1] if best else points


def rotated_rectangle(df: DataFrame, group_by: str) -> DataFrame:
    """(group, smallest rectangle in any direction as geometry, shape_area, feature_count), from the group's hull."""

    @F.pandas_udf(g.RING)
    def around(rings: pd.Series) -> pd.Series:
        made = [turned_box([(v["x"], v["y"]) for v in r][:-1]) for r in rings]
        return pd.Series([[{"x": x, "y": y} for x, y in [*m, *m[:1]]] for m in made])

    ring = around(F.get(F.get(F.col("geometry.coords"), 0), 0))
    boxed = convex_hull(df, group_by).withColumn("geometry", g.polygon(ring))
    return boxed.withColumn("shape_area", even_round(g.area(F.col("geometry"))))


def explode_multipart(df: DataFrame, order: str = "_idx") -> DataFrame:
    """One row a part, with source_feature_index and part_index; null geometries go."""
    parts = df.where("geometry is not null").select("*", F.posexplode("geometry.coords").alias("part_index", "__part"))
    single = F.regexp_replace(F.col("geometry.type"), "^Multi", "")
    return parts.withColumn("source_feature_index", F.col(order)).withColumn("geometry", F.struct(single.alias("type"), F.array("__part").alias("coords"))).drop("__part")


def buffer_points(df: DataFrame, distance: float, quad_segs: int = 8) -> DataFrame:
    """Points replaced by regular polygons around them; ``buffers.buffer`` takes lines and polygons, too."""
    if distance <= 0:
        raise ValueError("distance must be positive")
    shape = F.col("geometry")
    return df.withColumn("geometry", F.when(g.is_point(shape), g.regular_polygon(g.x_of(shape), g.y_of(shape), F.lit(float(distance)), max(8, 4 * quad_segs)))).where("geometry is not null")


def ring_buffers(df: DataFrame, distances: list[float], quad_segs: int = 8) -> DataFrame:
    """For each point the rings between consecutive distances."""
    rings = [(i, a, b) for i, (a, b) in enumerate(zip([0.0, *sorted(distances)], sorted(distances), strict=False))]
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("ring_index"), F.lit(float(a)).alias("inner"), F.lit(float(b)).alias("outer"), F.lit(f"{a:g}-{b:g}").alias("label")) for i, a, b in rings])).alias("__r")
    shape = F.col("geometry")
    out = df.where(g.is_point(shape)).select("*", each)
    return out.select(*[c for c in df.columns if c != "geometry"], F.col("__r.ring_index").alias("ring_index"), F.col("__r.inner").alias("inner"), F.col("__r.outer").alias("outer"), F.col("__r.label").alias("label"), g.annulus(g.x_of(shape), g.y_of(shape), F.col("__r.inner"), F.col("__r.outer"), max(8, 4 * quad_segs)).alias("geometry"))


def generate_grid(spark, bbox: tuple[float, float, float, float], cell_size: float, grid_type: str = "square", max_cells: int = 10_000_000) -> DataFrame:
    """Square or hexagonal cells over a box, row by row from below, named row_col."""
    x0, y0, x1, y1 = bbox
    if grid_type == "square":
        cols, rows = max(1, math.ceil((x1 - x0) / cell_size - 1e-9)), max(1, math.ceil((y1 - y0) / cell_size - 1e-9))
    else:
        wide, tall = math.sqrt(3) * cell_size / 2, cell_size * 0.75
        cols, rows = math.ceil((x1 - x0) / wide) + 1, math.ceil((y1 - y0) / tall) + 1
    if rows * cols > max_cells:
        raise ValueError(f"{rows * cols} cells; at most {max_cells}")
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    if grid_type == "square":
        x, y = F.lit(x0) + F.col("col") * cell_size, F.lit(y0) + F.col("row") * cell_size
        shape = g.rectangle(x, y, x + cell_size, y + cell_size)
    else:
        cx = F.lit(x0) + F.col("col") * wide + F.when(F.col("row") % 2 == 1, wide / 2).otherwise(0.0)
        cy, r = F.lit(y0) + F.col("row") * tall, cell_size / 2
        ring = [g.vertex(cx + r * math.cos(math.pi / 6 + i % 6 * math.pi / 3), cy + r * math.sin(math.pi / 6 + i % 6 * math.pi / 3)) for i in range(7)]
        shape = g.polygon(F.array(*ring))
    return cells.select(F.concat_ws("_", "row", "col").alias("cell_id"), "row", "col", shape.alias("geometry"))


def grid_over(df: DataFrame, cell_size: float, grid_type: str = "square", clip_to_features: bool = False, max_cells: int = 10_000_000) -> DataFrame:
    """Cells over the extent of a layer; with ``clip_to_features`` only those that touch a feature."""
    from .attributes import number_rows
    from .proximity import related_pairs

    b = g.bounds(F.col("geometry"))
    r = df.where("geometry is not null").select(b.alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
    if r[0] is None:
        raise ValueError("the layer has no extent")
    cells = generate_grid(df.sparkSession, tuple(r), cell_size, grid_type, max_cells)
    if not clip_to_features:
        return cells
    numbered = number_rows(cells, "row", "col")
    features = df.where("geometry is not null").select(F.monotonically_increasing_id().alias("_idx"), "geometry")
    met = related_pairs(numbered, features).select(F.col("source").alias("_idx")).distinct()
    return numbered.join(met, "_idx", "left_semi").drop("_idx")


def transform_crs(df: DataFrame, source: int, target: int, precision: int | None = None) -> DataFrame:
    """EPSG 4326, 3857 and the UTM zones (326zz, 327zz), any to any, by way of longitude and latitude."""
    if source == target:
        return df
    shape = F.col("geometry")
    for epsg in (source, target):
        if epsg not in (4326, 3857) and not g.is_utm(epsg):
            raise ValueError(f"no way from EPSG:{source} to EPSG:{target}")
    if source == 3857:
        shape = g.from_mercator(shape)
    elif source != 4326:
        shape = g.from_utm(shape, source)
    if target == 3857:
        shape = g.to_mercator(shape)
    elif target != 4326:
        shape = g.to_utm(shape, target)
    if precision is not None:
        shape = g.map_vertices(shape, lambda v: g.vertex(even_round(v["x"], precision), even_round(v["y"], precision)))
    return df.withColumn("geometry", shape)


def utm_zone(df: DataFrame) -> int:
    """The EPSG code of the UTM zone at the middle of a layer in longitude and latitude; 4326's own if the layer is empty."""
    b = g.bounds(F.col("geometry"))
    r = df.select(b.alias("b")).agg(((F.min("b.minx") + F.max("b.maxx")) / 2).alias("x"), ((F.min("b.miny") + F.max("b.maxy")) / 2).alias("y")).first()
    if r.x is None:
        return 4326
    zone = min(60, max(1, int((r.x + 180) // 6) + 1))
    return (32600 if r.y >= 0 else 32700) + zone


def douglas_peucker(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = ring[a], ring[b]
        size, far, at = math.hypot(bx - ax, by - ay), -1.0, None
        for i in range(a + 1, b):
            x, y = ring[i]
            d = math.hypot(x - ax, y - ay) if size == 0 else abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / size
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [p for i, p in enumerate(ring) if i in keep]


def simplify(df: DataFrame, tolerance: float) -> DataFrame:
    """Rings and lines without vertices closer than the tolerance to their chords; rings keep four vertices."""
    @F.pandas_udf(g.GEOMETRY)
    def run(kind: pd.Series, coords: pd.Series) -> pd.DataFrame:
        out = []
        for name, parts in zip(kind, coords, strict=True):
            done = []
            for rings in parts if parts is not None else []:
                kept = []
                for ring in rings:
                    points = [(v["x"], v["y"]) for v in ring]
                    few = douglas_peucker(points, tolerance) if len(points) > 2 else points
                    if "Polygon" in name and len(few) < 4:
                        few = points
                    kept.append([{"x": x, "y": y} for x, y in few])
                done.append(kept)
            out.append((name, done))
        return pd.DataFrame(out, columns=["type", "coords"])

    done = run(F.col("geometry.type"), F.col("geometry.coords"))
    return df.withColumn("geometry", F.when(F.col("geometry").isNotNull(), done))


def validity(shape: Column) -> Column:
    """Null if a geometry is usable, else what is wrong with it."""
    rings = F.flatten(shape["coords"])
    first, last = (lambda r: F.get(r, 0)), (lambda r: F.element_at(r, -1))
    unclosed = F.exists(rings, lambda r: (F.size(r) > 0) & ((first(r)["x"] != last(r)["x"]) | (first(r)["y"] != last(r)["y"])))
    odd = F.exists(g.vertices(shape), lambda v: v["x"].isNull() | v["y"].isNull() | F.isnan(v["x"]) | F.isnan(v["y"]))
    polygon = g.is_polygon(shape)

    def crossing(ring: Column) -> Column:
        """Whether two edges that aren't neighbours cross."""
        edges = F.transform(g.segments(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))
        side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
        meet = lambda s, t: (side(s["a"], s["b"], t["a"]) * side(s["a"], s["b"], t["b"]) < 0) & (side(t["a"], t["b"], s["a"]) * side(t["a"], t["b"], s["b"]) < 0)
        return F.exists(edges, lambda s: F.exists(edges, lambda t: (t["i"] > s["i"] + 1) & meet(s, t)))

    return (
        F.when(shape.isNull(), "null geometry").when(F.size(g.vertices(shape)) == 0, "empty geometry").when(odd, "invalid coordinate")
        .when(polygon & unclosed, "ring is not closed").when(polygon & F.exists(rings, lambda r: F.size(r) < 4), "ring has too few vertices")
        .when((shape["type"] == "LineString") & F.exists(rings, lambda r: F.size(r) < 2), "line has too few vertices").when(polygon & F.exists(rings, crossing), "self-intersection")
    )


def validate(df: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """is_valid and invalid_reason."""
    out = df.withColumn("invalid_reason", validity(F.col("geometry"))).withColumn("is_valid", F.col("invalid_reason").isNull())
    return out.where("is_valid") if drop_invalid else out


def repair(df: DataFrame) -> DataFrame:
    """Closes rings and takes out repeated vertices; what is still invalid is marked."""
    def clean(ring: Column) -> Column:
        kept = F.filter(F.transform(ring, lambda v, i: F.struct(v.alias("v"), F.get(ring, i - 1).alias("p"), i.alias("i"))), lambda e: (e["i"] == 0) | (e["v"]["x"] != e["p"]["x"]) | (e["v"]["y"] != e["p"]["y"]))
        return F.transform(kept, lambda e: e["v"])

    shape = F.col("geometry")
    rings = F.transform(shape["coords"], lambda part: F.transform(part, lambda r: F.when(g.is_polygon(shape), g.closed(clean(r))).otherwise(clean(r))))
    return validate(df.withColumn("geometry", F.when(shape.isNotNull(), F.struct(shape["type"].alias("type"), rings.alias("coords")))))


def topology_issues(df: DataFrame, min_area: float = 0.0, sliver_ratio: float = 0.01, order: str = "_idx") -> DataFrame:
    """(feature, issue, other): invalid, empty, duplicate, sliver and small features."""
    shape = F.col("geometry")
    size, edge, sound = g.area(shape), g.length(shape), g.is_polygon(shape) & validity(shape).isNull()
    found = F.array_compact(F.array(
        F.when(validity(shape).isNotNull() & (F.size(g.vertices(shape)) > 0), "invalid"), F.when(shape.isNull() | (F.size(g.vertices(shape)) == 0), "empty"),
        F.when(sound & (edge > 0) & (12.566370614359172 * size / (edge * edge) < sliver_ratio), "sliver"), F.when(sound & (size < min_area), "small"),
    ))
    single = df.select(F.col(order).alias("feature"), F.explode(found).alias("issue"), F.lit(None).cast("bigint").alias("other"))
    keyed = df.where("geometry is not null").select(F.col(order).alias("feature"), F.xxhash64(F.to_json("geometry")).alias("k"), F.to_json("geometry").alias("text"))
    first = keyed.groupBy("k", "text").agg(F.min("feature").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = keyed.join(first, ["k", "text"]).where("feature > other").select("feature", F.lit("duplicate").alias("issue"), "other")
    return single.unionByName(twice)
