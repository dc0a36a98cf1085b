"""Overlay against point tests on a lattice: a point is in the result exactly if the layers say so."""

import math
import random

import pytest
from geoloom.functions import geometry as g
from geoloom.operators import overlay
from pyspark.sql import functions as F

SCHEMA = f"_idx bigint, name string, geometry {g.GEOMETRY}"


def star(rng, x, y, r, n, hole=False):
    ring = lambda s: [(x + s * r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + s * r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings = [ring(1.0)] + ([ring(0.35)[::-1]] if hole else [])
    return [[*r, r[0]] for r in rings]


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def layer(spark, shapes, kind=None):
    rows = []
    for i, parts in enumerate(shapes):
        name = kind or ("Polygon" if len(parts) == 1 else "MultiPolygon")
        rows.append((i, f"n{i % 2}", (name, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in parts])))
    return spark.createDataFrame(rows, SCHEMA)


def holds(parts, x, y):
    odd = False
    for rings in parts:
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                    odd = not odd
    return odd


def parts_of(shape):
    return [[[(v.x, v.y) for v in ring] for ring in rings] for rings in shape.coords]


def area_of(parts):
    one = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2
    return sum(abs(one(rings[0])) - sum(abs(one(h)) for h in rings[1:]) for rings in parts)


def lattice():
    return [(i * 0.73 + 0.0137, j * 0.71 + 0.0211) for i in range(-2, 30) for j in range(-2, 30)]


@pytest.fixture(scope="module")
def stars(spark):
    rng = random.Random(4)
    a = [[star(rng, rng.uniform(2, 18), rng.uniform(2, 18), rng.uniform(1, 5), rng.randrange(3, 12), k % 2 == 0)] for k in range(10)]
    b = [[star(rng, rng.uniform(2, 18), rng.uniform(2, 18), rng.uniform(1, 5), rng.randrange(3, 12), k % 3 == 0)] for k in range(8)]
    a.append([box(0, 0, 6, 6)[0:1], box(12, 12, 15, 15)[0:1]])
    b.append([box(3, 0, 6, 3)])  # shares two borders with the box
    return a, b, layer(spark, a), layer(spark, b)


@pytest.mark.parametrize("cell", [None, 0.9, 50.0])
def test_clip_and_erase(spark, stars, cell):
    a, b, left, right = stars
    for made, inside in ((overlay.clip_by(left, right, cell=cell), True), (overlay.erase(left, right, cell=cell), False)):
        found = {r._idx: parts_of(r.geometry) for r in made.collect()}
        for i, shape in enumerate(a):
            want = [p for p in lattice() if holds(shape, *p) and any(holds(m, *p) for m in b) == inside]
            assert [p for p in lattice() if holds(found.get(i, []), *p)] == want


def test_union_pieces(spark, stars):
    a, b, left, right = stars
    rows = overlay.union(left, right).collect()
    pieces = [(parts_of(r.geometry), r) for r in rows]
    for p in lattice():
        own = [r for parts, r in pieces if holds(parts, *p)]
        s, t = [i for i, x in enumerate(a) if holds(x, *p)], [i for i, x in enumerate(b) if holds(x, *p)]
        assert len(own) == bool(s or t)
        for r in own:
            assert (r.source_overlap_count, r.target_overlap_count) == (len(s), len(t))
            assert r.source_name == (f"n{min(s) % 2}" if s else None) and r.target_name == (f"n{min(t) % 2}" if t else None)
            assert r.overlay_origin == ("both" if s and t else "source" if s else "target")


def test_regions_and_dissolve(spark, stars):
    a, b, left, right = stars
    pairs = {(r.source, r.target): parts_of(r.geometry) for r in overlay.regions(left, right).collect()}
    groups = {r.name: r for r in overlay.dissolve(left, ["name"], values=["_idx"]).collect()}
    assert groups["n0"]._feature_count == 6 and groups["n0"]._idx_values == [0, 2, 4, 6, 8, 10]
    for p in lattice():
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                assert holds(pairs.get((i, j), []), *p) == (holds(x, *p) and holds(y, *p))
        for k in (0, 1):
            assert holds(parts_of(groups[f"n{k}"].geometry), *p) == any(holds(x, *p) for i, x in enumerate(a) if i % 2 == k)


def test_whole_numbers(spark):
    """Shared borders, corners that touch, holes filled exactly: results known by hand."""
    squares = [[box(x, y, x + 1, y + 1)] for x in range(3) for y in range(3)]
    one = overlay.dissolve(layer(spark, squares).withColumn("name", F.lit("all")), ["name"]).first()
    assert parts_of(one.geometry) in ([[[(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)]]], [[[(3, 0), (3, 3), (0, 3), (0, 0), (3, 0)]]], [[[(3, 3), (0, 3), (0, 0), (3, 0), (3, 3)]]], [[[(0, 3), (0, 0), (3, 0), (3, 3), (0, 3)]]])
    ring = overlay.erase(layer(spark, [[box(0, 0, 3, 3)]]), layer(spark, [[box(1, 1, 2, 2)]])).first()
    assert ring.geometry.type == "Polygon" and len(ring.geometry.coords[0]) == 2 and area_of(parts_of(ring.geometry)) == 8
    full = overlay.union(layer(spark, [[box(0, 0, 3, 3)]]), layer(spark, [[box(1, 1, 2, 2)]])).collect()
    assert sorted((r.overlay_origin, area_of(parts_of(r.geometry))) for r in full) == [("both", 1), ("source", 8)]
    corners = overlay.dissolve(layer(spark, [[box(0, 0, 1, 1)], [box(1, 1, 2, 2)]]).withColumn("name", F.lit("all")), ["name"]).first()
    assert corners.geometry.type == "MultiPolygon" and area_of(parts_of(corners.geometry)) == 2
    assert overlay.erase(layer(spark, [[box(0, 0, 1, 1)]]), layer(spark, [[box(-1, -1, 2, 2)]])).count() == 0
    assert overlay.clip_by(layer(spark, [[box(0, 0, 1, 1)]]), layer(spark, [[box(1, 0, 2, 1)]])).count() == 0
    empty = layer(spark, []).limit(0)
    assert overlay.clip_by(layer(spark, [[box(0, 0, 1, 1)]]), empty).count() == 0
    assert [area_of(parts_of(r.geometry)) for r in overlay.erase(layer(spark, [[box(0, 0, 1, 1)]]), empty).collect()] == [1]


def test_lines_and_points(spark):
    mask = layer(spark, [[box(0, 0, 10, 10)]])
    lines = layer(spark, [[[[(-5, 1), (2, 1), (2, 20)]]], [[[(-1, 5), (11, 5), (11, 6), (-1, 6)]]], [[[(0, 0), (10, 0)]]], [[[(20, 0), (30, 0)]]]], "LineString")
    total = lambda df: {r._idx: round(r.n, 9) for r in df.select("_idx", g.length(F.col("geometry")).alias("n")).collect()}
    assert total(overlay.clip_by(lines, mask)) == {0: 11, 1: 20, 2: 10}
    assert total(overlay.erase(lines, mask)) == {0: 15, 1: 5, 3: 10}
    convex = overlay.clip(lines, g.rectangle(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)))
    assert total(convex) == {0: 11, 1: 20, 2: 10}
    paths = {r._idx: parts_of(r.geometry) for r in convex.collect()}
    assert paths[0] == [[[(0, 1), (2, 1), (2, 10)]]] and len(paths[1]) == 2
    points = layer(spark, [[[[(1, 1)]], [[(11, 1)]]], [[[(10, 10)]]], [[[(-1, 0)]]]], "MultiPoint")
    kept = lambda df: {r._idx: parts_of(r.geometry) for r in df.collect()}
    assert kept(overlay.clip_by(points, mask)) == {0: [[[(1, 1)]]], 1: [[[(10, 10)]]]}
    assert kept(overlay.erase(points, mask)) == {0: [[[(11, 1)]]], 2: [[[(-1, 0)]]]}


def test_rings_over_many_batches(spark, monkeypatch):
    from geoloom.operators import arrangement

    monkeypatch.setattr(arrangement, "BATCH", 7)
    n = 200
    wheel = [[[(10 + 8 * math.cos(2 * math.pi * i / n), 10 + 8 * math.sin(2 * math.pi * i / n)) for i in [*range(n), 0]]]]
    got = overlay.erase(layer(spark, [wheel]), layer(spark, [[box(9, 9, 11, 11)]]))
    parts = parts_of(got.first().geometry)
    assert len(parts) == 1 and len(parts[0]) == 2 and abs(area_of(parts) - (area_of(wheel) - 4)) < 1e-7  # vertices have nine decimals
