import math

import pytest
from geoloom.functions import geometry as g
from geoloom.operators import shapes
from pyspark.sql import functions as F

HOLED = '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}'
LINE = '{"type":"LineString","coordinates":[[0,0],[3,4],[3,8]]}'
POINT = '{"type":"Point","coordinates":[1.5,2]}'
MULTI = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[7,5],[7,7],[5,7],[5,5]]]]}'
BOW = '{"type":"Polygon","coordinates":[[[0,0],[4,4],[4,0],[0,4],[0,0]]]}'


@pytest.fixture(scope="module")
def layer(spark):
    rows = [(i, t) for i, t in enumerate([HOLED, LINE, POINT, MULTI, BOW, None])]
    return spark.createDataFrame(rows, "_idx bigint, t string").withColumn("geometry", g.from_geojson(F.col("t")))


def test_measures(layer):
    out = {r._idx: r for r in shapes.area_perimeter(layer).collect()}
    assert (out[0]._area, out[0]._perimeter) == (96.0, 48.0) and out[1]._length == 9.0 and out[2]._area == 0.0
    assert out[3]._area == 4.5 and out[5]._area is None
    c = {r._idx: (r.x, r.y) for r in shapes.centroids(layer).where("geometry is not null").select("_idx", g.x_of(F.col("geometry")).alias("x"), g.y_of(F.col("geometry")).alias("y")).collect()}
    assert c[0] == (5.0, 5.0) and c[2] == (1.5, 2.0) and c[1] == pytest.approx(((1.5 * 5 + 3 * 4) / 9, (2 * 5 + 6 * 4) / 9))


def test_inside(layer):
    shape = layer.where("_idx = 0")
    def at(x, y):
        return shape.select(g.covers(F.col("geometry"), F.lit(x), F.lit(y)), g.contains(F.col("geometry"), F.lit(x), F.lit(y)), g.distance(F.col("geometry"), F.lit(x), F.lit(y))).first()

    assert tuple(at(1.0, 1.0)) == (True, True, 0.0)
    assert tuple(at(0.0, 5.0))[:2] == (True, False)
    assert tuple(at(5.0, 5.0)) == (False, False, 1.0)
    assert tuple(at(4.0, 5.0))[0] is False
    assert at(13.0, 14.0)[2] == 5.0


def test_text_forms(layer):
    assert [r.w for r in layer.where("_idx < 3").select(g.wkt(F.col("geometry")).alias("w")).collect()][1:] == ["LINESTRING (0.0 0.0, 3.0 4.0, 3.0 8.0)", "POINT (1.5 2.0)"]
    again = layer.where("geometry is not null").withColumn("again", g.from_geojson(g.geojson(F.col("geometry"))))
    assert again.where("again <> geometry or again is null").count() == 0


def test_validity_and_repair(layer, spark):
    out = {r._idx: r.invalid_reason for r in shapes.validate(layer).collect()}
    assert out == {0: None, 1: None, 2: None, 3: None, 4: "self-intersection", 5: "null geometry"}
    open_ring = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[0,0],[4,0],[4,4]]]}')], "_idx bigint, t string").withColumn("geometry", g.from_geojson(F.col("t")))
    assert shapes.validate(open_ring).first().invalid_reason == "ring is not closed"
    assert shapes.repair(open_ring).first().is_valid
    issues = {(r.feature, r.issue) for r in shapes.topology_issues(layer.unionByName(layer.where("_idx = 1").withColumn("_idx", F.lit(9).cast("bigint")))).collect()}
    assert {(4, "invalid"), (5, "empty"), (9, "duplicate")} <= issues


def test_parts_hull_simplify(layer):
    parts = shapes.explode_multipart(layer.where("_idx = 3")).collect()
    assert [(p.part_index, p.geometry.type) for p in parts] == [(0, "Polygon"), (1, "Polygon")]
    hull = shapes.convex_hull(layer.withColumn("k", F.lit(1)).where("_idx in (0, 4)"), "k").first()
    assert (hull.shape_area, hull.feature_count) == (100.0, 2)
    wavy = layer.where("_idx = 1").withColumn("geometry", g.line(F.array(*[g.vertex(F.lit(float(x)), F.lit(y)) for x, y in ((0, 0.0), (1, 0.1), (2, -0.1), (3, 5.0))])))
    assert len(shapes.simplify(wavy, 0.5).first().geometry.coords[0][0]) == 3


def test_buffers_grid_and_crs(layer, spark):
    point = layer.where("_idx = 2")
    disc = shapes.buffer_points(point, 2.0, 8).select(g.area(F.col("geometry"))).first()[0]
    assert disc == pytest.approx(16 * 4 * math.sin(2 * math.pi / 32))
    rings = shapes.ring_buffers(point, [1.0, 2.0]).select("label", g.area(F.col("geometry")).alias("a")).collect()
    assert [r.label for r in rings] == ["0-1", "1-2"] and rings[1].a == pytest.approx(3 * rings[0].a)
    assert shapes.generate_grid(spark, (0, 0, 10, 5), 2.5).count() == 8
    hexes = shapes.generate_grid(spark, (0, 0, 10, 10), 2.0, "hex")
    assert hexes.select(g.area(F.col("geometry")).alias("a")).agg(F.max("a")).first()[0] == pytest.approx(3 * math.sqrt(3) / 2)
    with pytest.raises(ValueError):
        shapes.generate_grid(spark, (0, 0, 10, 10), 0.01, max_cells=100)
    there = shapes.transform_crs(point, 4326, 3857)
    back = shapes.transform_crs(there, 3857, 4326, 9).select(g.x_of(F.col("geometry")), g.y_of(F.col("geometry"))).first()
    assert tuple(back) == (1.5, 2.0)
    with pytest.raises(ValueError):
        shapes.transform_crs(point, 4326, 31256)
