"""Planar geometry as Column expressions.

A geometry is a struct of its type and its coordinates as parts, rings and
vertices. Points and lines fill one ring; a polygon's first ring is its shell,
the others are holes; a ring repeats its first vertex at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double>"
RING = f"array<{VERTEX}>"
GEOMETRY = f"struct<type:string,coords:array<array<{RING}>>>"
EPS = 1e-12


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    """A point; null if a coordinate is null."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(vertex(x, y)))).alias("coords")))


def line(ring: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(F.array(ring)).alias("coords"))


def polygon(*rings: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*rings)).alias("coords"))


def closed(ring: Column) -> Column:
    """The ring with its first vertex at the end."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.array(first)))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """An axis-parallel rectangle, counter-clockwise."""
    return polygon(F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0)))


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["coords"]))


def x_of(g: Column) -> Column:
    return F.get(vertices(g), 0)["x"]


def y_of(g: Column) -> Column:
    return F.get(vertices(g), 0)["y"]


def bounds(g: Column) -> Column:
    """Struct of minx, miny, maxx, maxy; null for an empty geometry."""
    xs, ys = F.transform(vertices(g), lambda v: v["x"]), F.transform(vertices(g), lambda v: v["y"])
    box = F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    return F.when(F.size(vertices(g)) > 0, box)


def once(value: Column, f) -> Column:
    """f of a value that it uses more than once, worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def segments(ring: Column) -> Column:
    """Pairs (a, b) of neighbouring vertices."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula, positive counter-clockwise."""
    return _sum(F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def ring_length(ring: Column) -> Column:
    return _sum(F.transform(segments(ring), lambda s: F.sqrt((s["b"]["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"]))))


def is_polygon(g: Column) -> Column:
    return g["type"].isin("Polygon", "MultiPolygon")


def is_point(g: Column) -> Column:
    return g["type"].isin("Point", "MultiPoint")


def area(g: Column) -> Column:
    """Shells less holes; 0 for points and lines; null for null."""
    part = lambda rings: _sum(F.transform(rings, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))))
    return F.when(g.isNotNull(), F.when(is_polygon(g), _sum(F.transform(g["coords"], part))).otherwise(0.0))


def length(g: Column) -> Column:
    """Length of lines and of all rings of polygons; 0 for points."""
    total = _sum(F.transform(F.flatten(g["coords"]), ring_length))
    return F.when(g.isNotNull(), F.when(is_point(g), 0.0).otherwise(total))


def centroid(g: Column) -> Column:
    """Struct of x and y: by area for polygons, by length for lines, else the mean of the vertices."""
    def moments(ring: Column, hole: Column) -> Column:
        cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
        sign = F.when(ring_area(ring) < 0, -1.0).otherwise(1.0) * F.when(hole, -1.0).otherwise(1.0)
        x = _sum(F.transform(segments(ring), lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s))) / 6
        y = _sum(F.transform(segments(ring), lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s))) / 6
        return F.struct((sign * ring_area(ring)).alias("w"), (sign * x).alias("x"), (sign * y).alias("y"))

    def pull(ring: Column) -> Column:
        size = lambda s: F.sqrt((s["b"]["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"]))
        return F.struct(ring_length(ring).alias("w"), _sum(F.transform(segments(ring), lambda s: (s["a"]["x"] + s["b"]["x"]) / 2 * size(s))).alias("x"), _sum(F.transform(segments(ring), lambda s: (s["a"]["y"] + s["b"]["y"]) / 2 * size(s))).alias("y"))

    by_area = F.flatten(F.transform(g["coords"], lambda rings: F.transform(rings, lambda r, i: moments(r, i > 0))))
    by_length = F.transform(F.flatten(g["coords"]), pull)
    by_vertex = F.transform(vertices(g), lambda v: F.struct(F.lit(1.0).alias("w"), v["x"].alias("x"), v["y"].alias("y")))
    chosen = F.when(is_polygon(g) & (area(g) > 0), by_area).when(~is_point(g) & (length(g) > 0), by_length).otherwise(by_vertex)
    w = _sum(F.transform(chosen, lambda m: m["w"]))
    return F.when(w != 0, vertex(_sum(F.transform(chosen, lambda m: m["x"])) / w, _sum(F.transform(chosen, lambda m: m["y"])) / w))


def on_segment(s: Column, x: Column, y: Column) -> Column:
    cross = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])
    inside = x.between(F.least(s["a"]["x"], s["b"]["x"]) - EPS, F.greatest(s["a"]["x"], s["b"]["x"]) + EPS) & y.between(F.least(s["a"]["y"], s["b"]["y"]) - EPS, F.greatest(s["a"]["y"], s["b"]["y"]) + EPS)
    return (F.abs(cross) <= EPS) & inside


def on_ring(ring: Column, x: Column, y: Column) -> Column:
    return F.exists(segments(ring), lambda s: on_segment(s, x, y))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting; what it says on the boundary is undefined."""
    def crosses(s: Column) -> Column:
        straddles = (s["a"]["y"] > y) != (s["b"]["y"] > y)
        return straddles & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.when(straddles, s["b"]["y"] - s["a"]["y"]).otherwise(1.0) + s["a"]["x"])

    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def covers(g: Column, x: Column, y: Column) -> Column:
    """Whether a polygon has the point inside or on its shell; a hole's boundary is outside."""
    def part(rings: Column) -> Column:
        shell = F.element_at(rings, 1)
        holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
        return (on_ring(shell, x, y) | ring_contains(shell, x, y)) & ~F.exists(holes, lambda r: on_ring(r, x, y) | ring_contains(r, x, y))

    return is_polygon(g) & F.exists(g["coords"], lambda rings: (F.size(rings) > 0) & part(rings))


def on_boundary(g: Column, x: Column, y: Column) -> Column:
    return F.exists(F.flatten(g["coords"]), lambda r: on_ring(r, x, y))


def contains(g: Column, x: Column, y: Column) -> Column:
    """Strictly inside: the boundary does not count."""
    return covers(g, x, y) & ~on_boundary(g, x, y)


def segment_distance(s: Column, x: Column, y: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / F.when(size > 0, size).otherwise(1.0)))).otherwise(0.0)
    px, py = s["a"]["x"] + t * dx - x, s["a"]["y"] + t * dy - y
    return F.sqrt(px * px + py * py)


def distance(g: Column, x: Column, y: Column) -> Column:
    """Planar distance from a point to a geometry; 0 inside a polygon."""
    to_vertex = F.array_min(F.transform(vertices(g), lambda v: F.sqrt((v["x"] - x) * (v["x"] - x) + (v["y"] - y) * (v["y"] - y))))
    to_edge = F.array_min(F.transform(F.flatten(F.transform(F.flatten(g["coords"]), segments)), lambda s: segment_distance(s, x, y)))
    return F.when(is_point(g), to_vertex).when(covers(g, x, y), 0.0).otherwise(F.coalesce(to_edge, to_vertex))


def regular_polygon(x: Column, y: Column, radius: Column, corners: int) -> Column:
    """A circle as a ring of so many corners, the first to the east."""
    step = 6.283185307179586 / corners
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: vertex(x + radius * F.cos((i % corners) * step), y + radius * F.sin((i % corners) * step)))
    return polygon(ring)


def annulus(x: Column, y: Column, inner: Column, outer: Column, corners: int) -> Column:
    """The ring between two circles; a full disc if the inner radius is 0."""
    disc = lambda r: F.get(F.get(regular_polygon(x, y, r, corners)["coords"], 0), 0)
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.when(inner > 0, F.array(disc(outer), F.reverse(disc(inner)))).otherwise(F.array(disc(outer)))).alias("coords"))


def map_vertices(g: Column, f) -> Column:
    """The geometry with every vertex replaced."""
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), F.transform(g["coords"], lambda rings: F.transform(rings, lambda ring: F.transform(ring, f))).alias("coords")))


RADIUS = 6378137.0


def to_mercator(g: Column) -> Column:
    """Longitude and latitude to spherical Mercator metres."""
    import math

    return map_vertices(g, lambda v: vertex(v["x"] * (math.pi * RADIUS / 180), F.log(F.tan((v["y"] + 90) * (math.pi / 360))) * RADIUS))


def from_mercator(g: Column) -> Column:
    import math

    return map_vertices(g, lambda v: vertex(v["x"] * (180 / (math.pi * RADIUS)), F.atan(F.exp(v["y"] / RADIUS)) * (360 / math.pi) - 90))


#: The ellipsoid (WGS 84), the scale on a zone's meridian, false easting and southern northing.
AXIS, FLATTENING, SCALE, EASTING, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_MERIDIAN = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: The coefficients of Krueger's series in n to the fourth order, forward, back, and of the latitude.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def is_utm(epsg: int) -> bool:
    return epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60


def to_utm(g: Column, epsg: int) -> Column:
    """Longitude and latitude to the metres of a UTM zone (EPSG 326zz north, 327zz south)."""
    import math

    meridian, north = epsg % 100 * 6 - 183, 0.0 if epsg // 100 == 326 else SOUTH
    e = 2 * math.sqrt(_N) / (1 + _N)

    def moved(v: Column) -> Column:
        s, away = F.sin(F.radians(v["y"])), F.radians(v["x"] - meridian)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
        x = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1)), F.lit(0.0))
        y = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1)), F.lit(0.0))
        return vertex(EASTING + SCALE * _MERIDIAN * x, north + SCALE * _MERIDIAN * y)

    return map_vertices(g, moved)


def from_utm(g: Column, epsg: int) -> Column:
    """The metres of a UTM zone to longitude and latitude."""
    meridian, north = epsg % 100 * 6 - 183, 0.0 if epsg // 100 == 326 else SOUTH

    def moved(v: Column) -> Column:
        y, x = (v["y"] - north) / (SCALE * _MERIDIAN), (v["x"] - EASTING) / (SCALE * _MERIDIAN)
        xi = y - sum((b * F.sin(2 * j * y) * F.cosh(2 * j * x) for j, b in enumerate(_BACK, 1)), F.lit(0.0))
        eta = x - sum((b * F.cos(2 * j * y) * F.sinh(2 * j * x) for j, b in enumerate(_BACK, 1)), F.lit(0.0))
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        latitude = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(_LATITUDE, 1)), F.lit(0.0))
        return vertex(F.lit(float(meridian)) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(latitude))

    return map_vertices(g, moved)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371000.0) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def wkt(g: Column) -> Column:
    """Well-known text, numbers as Spark writes doubles."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda v: F.concat(v["x"].cast("string"), F.lit(" "), v["y"].cast("string"))), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    first, kind = F.get(g["coords"], 0), g["type"]
    body = (
        F.when(kind.isin("Point", "LineString"), ring(F.get(first, 0))).when(kind == "Polygon", part(first))
        .when(kind.isin("MultiPoint", "MultiLineString"), F.concat(F.lit("("), F.array_join(F.transform(g["coords"], lambda p: ring(F.get(p, 0))), ", "), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(g["coords"], part), ", "), F.lit(")")))
    )
    return F.when(g.isNotNull(), F.concat(F.upper(kind), F.lit(" "), body))


def geojson(g: Column) -> Column:
    """The GeoJSON text of a geometry."""
    pair = lambda v: F.concat(F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, pair), ","), F.lit("]"))
    part = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, ring), ","), F.lit("]"))
    first, kind = F.get(g["coords"], 0), g["type"]
    body = (
        F.when(kind == "Point", pair(F.get(F.get(first, 0), 0))).when(kind == "LineString", ring(F.get(first, 0))).when(kind == "Polygon", part(first))
        .when(kind == "MultiPoint", F.concat(F.lit("["), F.array_join(F.transform(g["coords"], lambda p: pair(F.get(F.get(p, 0), 0))), ","), F.lit("]")))
        .when(kind == "MultiLineString", F.concat(F.lit("["), F.array_join(F.transform(g["coords"], lambda p: ring(F.get(p, 0))), ","), F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.array_join(F.transform(g["coords"], part), ","), F.lit("]")))
    )
    return F.when(g.isNotNull(), F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}")))


def from_wkt(text: Column) -> Column:
    """A geometry from its well-known text, heights left out; null if it is empty, of another type or malformed."""
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    shape = rf"(?i)^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s*(?:Z|M|ZM)?\s*(\([-+.0-9eE,()\s]*\))\s*$"
    name, body = F.upper(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)
    kind = F.element_at(F.create_map(*[F.lit(v) for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon") for v in (k.upper(), k)]), F.nullif(name, F.lit("")))
    pairs = F.regexp_replace(body, rf"({number})\s+({number})(?:\s+{number}){{0,2}}\s*(?=[,)])", "[$1,$2]")
    nested = F.translate(pairs, "()", "[]")
    # a point's only pair, and pairs of several points in brackets of their own, lose a level
    flat = F.when(kind == "Point", F.regexp_replace(nested, r"^\[\s*(\[[^\[\]]*\])\s*\]$", "$1")).when(kind == "MultiPoint", F.regexp_replace(nested, r"\[\s*(\[[^\[\]]*\])\s*\](?=\s*[,\]])", "$1")).otherwise(nested)
    # JSON has neither plus signs nor bare points
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"(?<![eE])\+", ""), r"(?<![0-9])\.(?=[0-9])", "0."), r"\.(?![0-9])", ".0")
    made = from_geojson(F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), plain, F.lit("}")))
    odd = F.exists(vertices(made), lambda v: v["x"].isNull() | v["y"].isNull())
    return F.when((F.size(vertices(made)) > 0) & ~F.coalesce(odd, F.lit(True)), made)


def from_geojson(text: Column) -> Column:
    """A geometry from its GeoJSON text; null if the type is unknown."""
    kind = F.get_json_object(text, "$.type")
    raw = F.get_json_object(text, "$.coordinates")
    pair = lambda p: vertex(F.get(p, 0), F.get(p, 1))
    ring = lambda r: F.transform(r, pair)
    nested = lambda depth: F.from_json(raw, "array<" * (depth - 1) + "array<double>" + ">" * (depth - 1))
    coords = (
        F.when(kind == "Point", F.array(F.array(F.array(pair(nested(1))))))
        .when(kind == "LineString", F.array(F.array(ring(nested(2))))).when(kind == "MultiPoint", F.transform(nested(2), lambda p: F.array(F.array(pair(p)))))
        .when(kind == "Polygon", F.array(F.transform(nested(3), ring))).when(kind == "MultiLineString", F.transform(nested(3), lambda r: F.array(ring(r))))
        .when(kind == "MultiPolygon", F.transform(nested(4), lambda p: F.transform(p, ring)))
    )
    return F.when(coords.isNotNull(), F.struct(kind.alias("type"), coords.alias("coords")))
