"""Distances, joins, buffers, noding, rings, contours and projections against plain code on odd shapes."""

import math
import random

import pytest
from geoloom.functions import geometry as g
from geoloom.operators import buffers, network, proximity, raster, shapes
from pyspark.sql import functions as F
from test_overlay import area_of, box, holds, layer, parts_of, star


def segments(parts):
    for rings in parts:
        for r in rings:
            yield from (zip(r, r[1:]) if len(r) > 1 else [(r[0], r[0])])


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])


def crosses(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def gap(x, y, x_polygon, y_polygon):
    best = min(0.0 if crosses(a, b, c, d) else min(to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b)) for a, b in segments(x) for c, d in segments(y))
    if y_polygon and any(holds(y, *ring[0][0]) for ring in x) or x_polygon and any(holds(x, *ring[0][0]) for ring in y):
        return 0.0
    return best


def mixed(spark, seed, n):
    """(kind, parts) of points, lines and polygons, and the layer of them."""
    rng = random.Random(seed)
    made = []
    for k in range(n):
        x, y = rng.uniform(0, 40), rng.uniform(0, 40)
        if k % 3 == 0:
            made.append(("Point", [[[(x, y)]]]))
        elif k % 3 == 1:
            made.append(("LineString", [[[(x + rng.uniform(-6, 6), y + rng.uniform(-6, 6)) for _ in range(rng.randrange(2, 6))]]]))
        else:
            made.append(("Polygon", [star(rng, x, y, rng.uniform(0.5, 8), rng.randrange(3, 9), k % 2 == 0)]))
    rows = [(i, f"n{i}", (kind, [[[{"x": float(a), "y": float(b)} for a, b in r] for r in rings] for rings in parts])) for i, (kind, parts) in enumerate(made)]
    return made, spark.createDataFrame(rows, f"_idx bigint, name string, geometry {g.GEOMETRY}")


def test_nearest_of_all_kinds(spark):
    a, left = mixed(spark, 1, 24)
    b, right = mixed(spark, 2, 20)
    want = set()
    for i, (k, x) in enumerate(a):
        near = sorted((round(gap(x, y, k == "Polygon", m == "Polygon"), 9), j) for j, (m, y) in enumerate(b))
        want |= {(i, j, d, r + 1) for r, (d, j) in enumerate(near[:3])}
    got = proximity.nearest(left, right, 3).collect()
    assert {(r.source, r.target, round(r.distance, 9), r.rank) for r in got} == want
    close = {(i, j) for i, (k, x) in enumerate(a) for j, (m, y) in enumerate(b) if gap(x, y, k == "Polygon", m == "Polygon") <= 2}
    assert {(r.source, r.target) for r in proximity.related_pairs(left, right, "dwithin", 2.0).collect()} == close
    touch = {(i, j) for i, (k, x) in enumerate(a) for j, (m, y) in enumerate(b) if gap(x, y, k == "Polygon", m == "Polygon") == 0}
    joined = proximity.spatial_join(left, right, join_type="left").collect()
    assert {r._idx: (r._joined_count, r._target_index) for r in joined} == {i: (sum(x == i for x, _ in touch), min((y for x, y in touch if x == i), default=None)) for i in range(len(a))}
    limited = proximity.nearest_neighbors(left, right, 1, 1.5, distance_field="d").collect()
    assert {r._idx for r in limited} == {i for i, _, d, r in want if r == 1 and d <= 1.5}


def test_within_and_contains(spark):
    target = layer(spark, [[box(0, 0, 10, 10) + [box(4, 4, 6, 6)[0][::-1]]], [box(5, 0, 20, 10)]])
    inside = layer(spark, [[box(1, 1, 2, 2)], [box(3, 3, 7, 7)], [box(0, 0, 3, 3)], [box(6, 1, 9, 3)], [box(4, 4, 6, 6)]])
    pairs = lambda df: {(r.source, r.target) for r in df.collect()}
    assert pairs(proximity.related_pairs(inside, target, "within")) == {(0, 0), (2, 0), (3, 0), (3, 1)}
    assert pairs(proximity.related_pairs(target, inside, "contains")) == {(0, 0), (0, 2), (0, 3), (1, 3)}
    lines = layer(spark, [[[[(1, 1), (3, 1), (3, 3)]]], [[[(0, 0), (10, 0)]]], [[[(0, 0), (0, 2), (2, 2)]]], [[[(1, 5), (9, 5)]]]], "LineString")
    assert pairs(proximity.related_pairs(lines, target, "within")) == {(0, 0), (2, 0)}
    points = layer(spark, [[[[(1, 1)]]], [[[(5, 5)]]], [[[(0, 0)]]], [[[(7, 7)]]]], "Point")
    assert pairs(proximity.related_pairs(points, target, "within")) == {(0, 0), (3, 0), (3, 1)}


def reach(parts, polygon, p):
    return 0.0 if polygon and holds(parts, *p) else min(to_segment(p, a, b) for a, b in segments(parts))


@pytest.mark.parametrize("distance", [1.5, -0.7])
def test_buffers_of_all_kinds(spark, distance):
    made, df = mixed(spark, 7, 9)
    found = {r._idx: parts_of(r.geometry) for r in buffers.buffer(df, distance, quad_segs=16).collect()}
    rng = random.Random(3)
    for i, (kind, parts) in enumerate(made):
        xs, ys = zip(*[v for a, b in segments(parts) for v in (a, b)])
        for _ in range(300):
            p = (rng.uniform(min(xs) - 2, max(xs) + 2), rng.uniform(min(ys) - 2, max(ys) + 2))
            edge = min(to_segment(p, a, b) for a, b in segments(parts))
            if abs(edge - abs(distance)) < 0.02:
                continue  # a circle is a polygon here
            want = reach(parts, kind == "Polygon", p) < distance if distance > 0 else kind == "Polygon" and holds(parts, *p) and edge > -distance
            assert holds(found.get(i, []), *p) == want


def test_caps_joins_and_rings(spark):
    line = layer(spark, [[[[(0, 0), (10, 0), (10, 10)]]]], "LineString")
    area = lambda **o: area_of(parts_of(buffers.buffer(line, 1.0, **o).first().geometry))
    body = 2 * 10 + 2 * 10 - 1  # the two rectangles share a square
    assert area(cap_style="flat", join_style="mitre") == pytest.approx(body + 1)
    assert area(cap_style="flat", join_style="bevel") == pytest.approx(body + 0.5)
    assert area(cap_style="square", join_style="mitre") == pytest.approx(body + 1 + 4)
    assert area(cap_style="flat", join_style="mitre", mitre_limit=1.1) == pytest.approx(body + 0.5)
    disc = 32 / 2 * math.sin(2 * math.pi / 32)
    assert area() == pytest.approx(body + disc + disc / 4)
    square = layer(spark, [[box(0, 0, 4, 4)]])
    rings = {r.ring_index: (r.inner, r.outer, r.label, area_of(parts_of(r.geometry))) for r in buffers.ring_buffers(square, [2.0, 1.0]).collect()}
    assert rings[1][:3] == (0.0, 1.0, "0-1") and rings[1][3] == pytest.approx(16 + 16 + disc)
    assert rings[2][3] == pytest.approx(16 + 3 * disc)
    two = layer(spark, [[[[(0, 0)]]], [[[(1, 0)]]], [[[(9, 9)]]]], "Point")
    assert [r.geometry.type for r in buffers.buffer(two, 1.0, dissolve=True).collect()] == ["MultiPolygon"]
    with pytest.raises(ValueError):
        buffers.buffer(two, 0.0)


def test_crossing_streets_and_path(spark):
    lines = layer(spark, [[[[(0, 0), (10, 10)]]], [[[(0, 10), (10, 0)]]], [[[(5, 5), (5, 20)]]], [[[(20, 20), (30, 20)]]]], "LineString")
    edges = network.build_edges(lines)
    assert edges.count() == 6
    path = {r.step: r.node for r in network.shortest_path(edges, "0.0 0.0", "5.0 20.0").collect()}
    assert path == {0: "5.0 20.0", 1: "5.0 5.0", 2: "0.0 0.0"}
    assert network.shortest_path(edges, "0.0 0.0", "20.0 20.0").count() == 0
    assert network.build_edges(lines, node_crossings=False).count() == 4
    street = layer(spark, [[[[(float(i), 0.0) for i in range(40)]]]], "LineString")
    long = network.shortest_path(network.build_edges(street), "0.0 0.0", "39.0 0.0").collect()
    assert sorted((r.step, r.dist) for r in long) == [(i, 39.0 - i) for i in range(40)]


def test_traced_regions(spark):
    picture = ["1110010", "1010110", "1110001", "0001001", "0000000", "1111111"]
    df = spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(picture) for c, v in enumerate(line)], "row bigint, col bigint, b1 double")
    for connectivity in (4, 8):
        rows = raster.raster_polygons(df, connectivity=connectivity).collect()
        plain = raster.raster_components(df, connectivity=connectivity).collect()
        assert sorted((r.pixel_count, r.area, r.perimeter) for r in rows) == sorted((r.pixel_count, r.area, r.perimeter) for r in plain)
        for r, line in enumerate(picture):
            for c, v in enumerate(line):
                assert sum(holds(parts_of(x.geometry), c + 0.5, -r - 0.5) for x in rows) == int(v)
        for x in rows:
            for rings in parts_of(x.geometry):
                turn = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) > 0 for r in rings]
                assert turn == [True] + [False] * (len(rings) - 1)
    hole = [x for x in raster.raster_polygons(df).collect() if x.pixel_count == 8]
    assert len(hole) == 1 and len(hole[0].geometry.coords[0]) == 2


def test_contour_lines(spark):
    rng = random.Random(5)
    values = [[math.sin(r / 2.0) * 5 + math.cos(c / 1.7) * 5 + rng.uniform(-1, 1) for c in range(14)] for r in range(12)]
    df = spark.createDataFrame([(r, c, v) for r, row in enumerate(values) for c, v in enumerate(row) if (r, c) != (4, 4)], "row bigint, col bigint, b1 double")
    levels = [-3.0, 0.5, 7.5]
    parts = raster.contours(df, levels).select("level", g.length(F.col("geometry")).alias("n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    lines = raster.contour_lines(df, levels).collect()
    for r in parts:
        assert sum(math.dist(a, b) for x in lines if x.level == r.level for a, b in segments(parts_of(x.geometry))) == pytest.approx(r.n)
    assert any(x.closed for x in lines) and any(not x.closed for x in lines)
    for x in lines:
        ring = parts_of(x.geometry)[0][0]
        assert x.closed == (ring[0] == ring[-1])
        if not x.closed:  # it ends at the raster's edge or beside the missing pixel
            for px, py in (ring[0], ring[-1]):
                c, r = px - 0.5, -py - 0.5
                assert min(c, r) < 1e-9 or c > 13 - 1e-9 or r > 11 - 1e-9 or (abs(c - 4) < 1.01 and abs(r - 4) < 1.01)
    hill = spark.createDataFrame([(r, c, 10.0 if (r, c) == (2, 2) else 0.0) for r in range(5) for c in range(5)], "row bigint, col bigint, b1 double")
    ring = parts_of(raster.contour_lines(hill, [5.0]).first().geometry)[0][0]
    assert len(ring) == 5 and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) > 0


def test_two_rasters_and_utm(spark):
    red = spark.createDataFrame([(0, 0, 2.0), (0, 1, None), (1, 0, 1.0)], "row bigint, col bigint, b1 double")
    nir = spark.createDataFrame([(0, 0, 6.0), (0, 1, 3.0), (5, 5, 1.0)], "row bigint, col bigint, b1 double")
    assert {(r.row, r.col): r.value for r in raster.ndvi_from_bands(red, nir).collect()} == {(0, 0): 0.5, (0, 1): None, (1, 0): None, (5, 5): None}
    places = [(2.2945, 48.8584), (9.0, 0.0), (-60.5, -33.2), (51.4, 35.7)]
    df = layer(spark, [[[[p]]] for p in places], "Point")
    at = lambda d: {r._idx: parts_of(r.geometry)[0][0][0] for r in d.collect()}
    east = at(shapes.transform_crs(df, 4326, 32631))
    assert east[0] == pytest.approx((448251.9, 5411943.8), abs=25)
    assert at(shapes.transform_crs(df, 4326, 32632))[1] == pytest.approx((500000, 0), abs=1e-6)
    for zone, i in ((32631, 0), (32632, 1), (32720, 2), (32639, 3)):
        back = at(shapes.transform_crs(shapes.transform_crs(df, 4326, zone), zone, 4326))
        assert back[i] == pytest.approx(places[i], abs=1e-9)
        assert shapes.utm_zone(df.where(F.col("_idx") == i)) == zone
    # a short way in a zone is as long as on the ellipsoid, but for the scale
    north = at(shapes.transform_crs(layer(spark, [[[[(9.0, 45.0)]]], [[[(9.0, 45.001)]]]], "Point"), 4326, 32632))
    e2 = g.FLATTENING * (2 - g.FLATTENING)
    radius = g.AXIS * (1 - e2) / (1 - e2 * math.sin(math.radians(45.0005)) ** 2) ** 1.5
    assert (north[1][1] - north[0][1]) / 0.9996 == pytest.approx(radius * math.radians(0.001), rel=1e-8)
    with pytest.raises(ValueError):
        shapes.transform_crs(df, 4326, 32661)


def test_real_estate_context(spark):
    homes = layer(spark, [[[[(51.40, 35.70)]]], [[[(51.50, 35.71)]]], [[[(10.0, 50.0)]]]], "Point").withColumn("distance_to_metro_m", F.when(F.col("_idx") == 1, F.lit("999")))
    metro = layer(spark, [[[[(51.41, 35.70)]]], [[[(51.9, 35.9)]]]], "Point")
    roads = layer(spark, [[[[(51.39, 35.60), (51.39, 35.80)]]]], "LineString")
    zones = layer(spark, [[box(51.3, 35.6, 51.45, 35.8)]])
    out = {r._idx: r for r in proximity.enrich_real_estate(homes, metro, None, roads, zones).collect()}
    p1 = math.radians(35.70)
    h = math.cos(p1) ** 2 * math.sin(math.radians(0.01) / 2) ** 2
    assert out[0].distance_to_metro_m == str(round(2 * 6371000 * math.asin(math.sqrt(h))))
    assert out[1].distance_to_metro_m == "999" and int(out[2].distance_to_metro_m) > 3_000_000
    assert out[0].distance_to_main_road_m == round(0.01 * 111320 * math.cos(p1))
    assert (out[0].in_allowed_zone, out[1].construction_allowed, out[2].build_zone_allowed) == (True, False, False)
    assert all(r.spatial_enrichment_applied for r in out.values())
    assert proximity.enrich_real_estate(homes).columns == homes.columns
    kept = proximity.enrich_real_estate(homes.withColumn("construction_allowed", F.lit(True)), allowed_zones=zones).collect()
    assert all(r.construction_allowed and r.in_allowed_zone is None and r.spatial_enrichment_applied is None for r in kept)


def test_service_polygons(spark):
    lines = layer(spark, [[[[(0, 0), (10, 0)]]], [[[(10, 0), (10, 10)]]], [[[(0, 0), (0, -4)]]]], "LineString")
    edges = network.build_edges(lines)
    start = spark.createDataFrame([("a", "0.0 0.0")], "origin string, node string")
    out = {r.band: (r.reached_length, area_of(parts_of(r.geometry))) for r in network.service_polygons(edges, start, [3.0, 12.0], 0.5).collect()}
    disc = 32 / 2 * math.sin(2 * math.pi / 32) * 0.25
    assert out[3.0][0] == 6 and out[3.0][1] == pytest.approx(3 + 3 - 0.25 + disc * 1.25, rel=1e-3)
    assert out[12.0][0] == 16 and out[12.0][1] == pytest.approx(16 - 0.5 + disc * 1.5, rel=1e-3)


def test_rotated_rectangle_and_samples(spark):
    from geoloom.operators import attributes

    t = math.radians(30)
    turn = lambda x, y: (x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t))
    rng = random.Random(1)
    spots = [turn(*p) for p in ((0, 0), (8, 0), (8, 3), (0, 3))] + [turn(rng.uniform(0, 8), rng.uniform(0, 3)) for _ in range(40)]
    df = layer(spark, [[[[p]]] for p in spots], "Point").withColumn("name", F.lit("k"))
    r = shapes.rotated_rectangle(df, "name").first()
    assert r.shape_area == pytest.approx(24) and r.feature_count == 44
    many = spark.range(1000).select(F.col("id").alias("_idx"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("s"))
    ids = lambda d: sorted(x._idx for x in d.collect())
    assert ids(attributes.sample_features(many, size=10, method="systematic")) == [100 * i + 99 for i in range(10)]
    picked = ids(attributes.sample_features(many, fraction=0.2, seed=4))
    assert len(picked) == 200 and picked == ids(attributes.sample_features(many.repartition(7), fraction=0.2, seed=4)) != ids(attributes.sample_features(many, fraction=0.2, seed=5))
    hashed = sorted(many.collect(), key=lambda x: x._idx)
    draws = {x._idx: x.h for x in many.select("_idx", F.xxhash64(F.lit(4), "_idx").alias("h")).collect()}
    assert picked == sorted(sorted((x._idx for x in hashed), key=draws.get)[:200])
    strata = attributes.sample_features(many, size=100, stratify_by="s").groupBy("s").count().collect()
    assert {x.s: x["count"] for x in strata} == {None: 10, 0: 30, 1: 30, 2: 30}
