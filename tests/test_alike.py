"""Features with equal geometry are worked on once and all get their rows."""

import pytest
from geoloom.functions import geometry as g
from geoloom.operators import buffers, overlay, proximity
from pyspark.sql import functions as F

COPIES = 40


@pytest.fixture
def plots(spark):
    """Two places with many plots each, and one plot apart."""
    ids = spark.range(2 * COPIES + 1).select(F.col("id").alias("_idx"))
    x = F.when(F.col("_idx") == 2 * COPIES, 50.0).otherwise((F.col("_idx") % 2) * 10.0)
    return ids.withColumn("geometry", g.rectangle(x, F.lit(0.0), x + 4, F.lit(4.0)))


def layer(spark, *boxes):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "_idx bigint, a double, b double, c double, d double").select("_idx", F.concat(F.lit("n"), "_idx").alias("name"), g.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))


@pytest.fixture
def arranged(monkeypatch):
    """How many features each layer of each arrangement has."""
    seen, init = [], overlay.Arrangement.__init__

    def count(self, layers, *args, **named):
        seen.append([df.count() for df in layers])
        init(self, layers, *args, **named)

    monkeypatch.setattr(overlay.Arrangement, "__init__", count)
    return seen


def areas(df):
    return {r._idx: round(r.area, 6) for r in df.select("_idx", g.area(F.col("geometry")).alias("area")).collect()}


def test_clip_and_erase(spark, plots, arranged):
    mask = layer(spark, (1, -1, 12, 9), (1, -1, 12, 9))
    assert areas(overlay.clip_by(plots, mask)) == {i: 12.0 if i % 2 == 0 else 8.0 for i in range(2 * COPIES)}
    assert areas(overlay.erase(plots, mask)) == {i: 4.0 if i % 2 == 0 else 8.0 for i in range(2 * COPIES)} | {2 * COPIES: 16.0}
    assert arranged == [[3, 1], [3, 1]]


def test_clipped_lines(spark, arranged):
    lines = spark.range(COPIES).select(F.col("id").alias("_idx"), g.line(F.array(g.vertex(F.lit(0.0), F.lit(1.0)), g.vertex(F.lit(8.0), F.lit(1.0)))).alias("geometry"))
    out = overlay.clip_by(lines, layer(spark, (2, 0, 5, 3)))
    assert {r._idx: r.n for r in out.select("_idx", g.length(F.col("geometry")).alias("n")).collect()} == dict.fromkeys(range(COPIES), 3.0)
    assert arranged == [[1, 1]]


def test_regions_of_convex_shapes_need_no_arrangement(spark, plots, arranged):
    found = {(r.source, r.target): r.area for r in overlay.regions(plots, layer(spark, (1, 1, 3, 9), (3, 3, 11, 5), (4, 0, 10, 4)), ).select("source", "target", F.col("_intersection_area").alias("area")).collect()}
    want = {(i, 0): 6.0 for i in range(0, 2 * COPIES, 2)} | {(i, 1): 1.0 for i in range(2 * COPIES)}
    assert found == want and not arranged


def test_regions_of_mixed_shapes(spark, arranged):
    corner = F.array(*[g.vertex(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0), (0.0, 0.0))])
    bent = spark.range(7, 9).select(F.col("id").alias("_idx"), F.lit("l").alias("name"), g.polygon(corner).alias("geometry"))
    all_ = layer(spark, (1, 1, 5, 5), (-1, -1, 1, 1)).unionByName(bent)
    found = {(r.source, r.target): round(r.area, 6) for r in overlay.regions(all_, all_).select("source", "target", F.col("_intersection_area").alias("area")).collect()}
    half = {(0, 7): 7.0, (0, 8): 7.0, (1, 7): 1.0, (1, 8): 1.0, (7, 8): 20.0}
    assert found == half | {(b, a): v for (a, b), v in half.items()} | {(0, 0): 16.0, (1, 1): 4.0, (7, 7): 20.0, (8, 8): 20.0}


def test_overlaps_of_equal_plots(plots, arranged):
    found = overlay.check_topology(plots, ["overlap"]).collect()
    assert len(found) == COPIES * (COPIES - 1) and {r.area for r in found} == {16.0} and not arranged


def test_within(spark, plots, arranged):
    found = proximity.related_pairs(plots, layer(spark, (-1, -1, 6, 6), (-1, -1, 6, 6), (40, 0, 60, 4)), "within")
    assert {tuple(r) for r in found.collect()} == {(i, k) for i in range(0, 2 * COPIES, 2) for k in (0, 1)} | {(2 * COPIES, 2)}
    assert arranged == [[3, 2]]


@pytest.fixture
def searched(monkeypatch):
    seen, search = [], proximity.pairs_within

    def count(left, right, *args, **named):
        seen.append((left.count(), right.count()))
        return search(left, right, *args, **named)

    monkeypatch.setattr(proximity, "pairs_within", count)
    return seen


def test_nearest_of_equal_shapes(plots, searched):
    """Of equal targets the smallest ids rank first, also across shapes that are equally far."""
    found = {(r.source, r["rank"]): (r.target, r.distance) for r in proximity.nearest(plots, plots, 3).collect()}
    assert found[(0, 1)] == (0, 0.0) and found[(6, 3)] == (4, 0.0) and found[(5, 2)] == (3, 0.0)
    assert [found[(2 * COPIES, k)] for k in (1, 2, 3)] == [(2 * COPIES, 0.0), (1, 36.0), (3, 36.0)]
    assert len(found) == 3 * (2 * COPIES + 1) and all(max(n) <= 3 for n in searched)


def test_joined_and_within_a_distance(spark, plots, searched):
    near = layer(spark, (4, 0, 5, 1), (4, 0, 5, 1), (15, 0, 16, 1))
    joined = {r._idx: (r._joined_count, r._target_index, r.target_name) for r in proximity.spatial_join(plots, near, join_type="left").collect()}
    assert joined == {i: (2, 0, "n0") if i % 2 == 0 else (0, None, None) for i in range(2 * COPIES)} | {2 * COPIES: (0, None, None)}
    pairs = proximity.related_pairs(plots, near, "dwithin", 1.0)
    assert {tuple(r) for r in pairs.collect()} == {(i, k) for i in range(0, 2 * COPIES, 2) for k in (0, 1)} | {(i, 2) for i in range(1, 2 * COPIES, 2)}
    assert all(n == (3, 2) for n in searched)


def test_buffers_of_equal_shapes(plots, arranged):
    assert areas(buffers.buffer(plots, -1.0)) == dict.fromkeys(range(2 * COPIES + 1), 4.0)
    wide = areas(buffers.buffer(plots, 1.0, join_style="mitre"))
    assert wide == dict.fromkeys(range(2 * COPIES + 1), 36.0)
    assert all(n <= [3 * 9] for n in arranged)


def test_dissolve_of_equal_shapes(plots, arranged):
    out = overlay.dissolve(plots.withColumn("k", F.col("_idx") % 2), ["k"]).select("k", "_feature_count", g.area(F.col("geometry")).alias("area")).collect()
    assert {tuple(r) for r in out} == {(0, COPIES + 1, 32.0), (1, COPIES, 16.0)} and arranged == [[3]]


def test_metres_from_equal_places(spark, monkeypatch):
    seen, parity = [], proximity.net.parity
    monkeypatch.setattr(proximity.net, "parity", lambda probes, *a: seen.append(probes.count()) or parity(probes, *a))
    homes = spark.range(COPIES).select(F.col("id").alias("_idx"), g.point(F.lit(51.0) + F.col("id") % 2, F.lit(35.0)).alias("geometry"))
    stops = spark.range(COPIES).select(F.col("id").alias("_idx"), g.point(F.lit(51.0), F.lit(35.001)).alias("geometry"))
    out = proximity.enrich_real_estate(homes, metro=stops).select("_idx", "distance_to_metro_m").collect()
    assert len(out) == COPIES and {r.distance_to_metro_m for r in out if r._idx % 2 == 0} == {111} and len({r.distance_to_metro_m for r in out}) == 2
    assert seen == [2]
