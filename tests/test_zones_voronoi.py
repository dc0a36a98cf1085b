"""Zones over pixels and Voronoi cells against plain code."""

import math
import random

import pytest
from geoloom.functions import geometry as g
from geoloom.operators import raster, voronoi
from pyspark.sql import functions as F
from test_overlay import area_of, box, holds, layer, parts_of, star


def segments(parts):
    return [s for rings in parts for r in rings for s in zip(r, r[1:])]


def meets_square(parts, c, r):
    """Whether a polygon meets the closed pixel: a border segment does, or the pixel's middle is inside."""
    def clipped(a, b):
        lo, hi = 0.0, 1.0
        for p, d, low in ((a[0], b[0] - a[0], c), (a[1], b[1] - a[1], -r - 1)):
            if d == 0:
                if not low <= p <= low + 1:
                    return False
                continue
            s, t = sorted(((low - p) / d, (low + 1 - p) / d))
            lo, hi = max(lo, s), min(hi, t)
        return lo <= hi

    return any(clipped(a, b) for a, b in segments(parts)) or holds(parts, c + 0.5, -r - 0.5)


@pytest.fixture(scope="module")
def zones(spark):
    rng = random.Random(8)
    shapes = [[star(rng, rng.uniform(3, 17), rng.uniform(-17, -3), rng.uniform(0.2, 6), rng.randrange(3, 10), k % 2 == 0)] for k in range(8)]
    shapes += [[box(2, -8, 6, -3)], [box(0.5, -9.5, 4.5, -5.5) + [box(1.5, -8.5, 3.5, -6.5)[0][::-1]]], [box(30, 30, 31, 31)], [box(1, -2, 2, -1), box(10, -12, 12, -10)]]
    return shapes, layer(spark, shapes)


def test_pixels_of_zones(spark, zones):
    shapes, df = zones
    got = {(r.target, r.row, r.col) for r in raster.zone_pixels(df).collect()}
    for i, parts in enumerate(shapes[:9]):
        assert {(r, c) for t, r, c in got if t == i} == {(r, c) for r in range(-1, 25) for c in range(-5, 25) if holds(parts, c + 0.5, -r - 0.5)}
    # centres on the shell are in, on a hole's border out
    ring = {(r, c) for t, r, c in got if t == 9}
    assert len(ring) == 25 - 9 and (5, 0) in ring and (6, 1) not in ring and (7, 2) not in ring
    touched = {(r.target, r.row, r.col) for r in raster.zone_pixels(df, all_touched=True).collect()}
    for i, parts in enumerate(shapes):
        assert {(r, c) for t, r, c in touched if t == i} == {(r, c) for r in range(-40, 25) for c in range(-5, 40) if meets_square(parts, c, r)}


def test_zonal_and_clip(spark, zones):
    shapes, df = zones
    picture = spark.createDataFrame([(r, c, None if (r + c) % 7 == 0 else float(r * 20 + c)) for r in range(20) for c in range(20)], "row int, col int, b1 double")
    out = {r._idx: r for r in raster.zonal_statistics(picture, df, all_touched=True).collect()}
    for i, parts in enumerate(shapes):
        cells = [(r, c) for r in range(20) for c in range(20) if meets_square(parts, c, r)]
        known = [r * 20 + c for r, c in cells if (r + c) % 7]
        assert (out[i].zonal_count, out[i].zonal_valid_count, out[i].zonal_nodata_count, out[i].zonal_sum) == (len(cells), len(known), len(cells) - len(known), sum(known) if known else None)
    assert out[10].zonal_status == "empty"
    kept = raster.clip_to_zones(picture, df.where("_idx = 11")).collect()
    assert sorted((r.row, r.col) for r in kept) == [(1, 1), (10, 10), (10, 11), (11, 10), (11, 11)]


@pytest.mark.parametrize("rounds", [(12, 48), (2,)])
def test_cells(spark, monkeypatch, rounds):
    monkeypatch.setattr(voronoi, "ROUNDS", rounds)
    rng = random.Random(len(rounds))
    places = [(rng.gauss(10, 6), rng.gauss(5, 3)) for _ in range(70)] + [(float(i), 20.0) for i in range(6)]
    rows = [(i, x, y) for i, (x, y) in enumerate(places)] + [(500, *places[3]), (501, None, 1.0)]
    df = spark.createDataFrame(rows, "_idx bigint, x double, y double")
    cells = {r._idx: parts_of(r.geometry) for r in voronoi.voronoi(df).collect()}
    assert sorted(cells) == list(range(len(places)))
    xs, ys = zip(*places)
    wide, tall = max(xs) - min(xs), max(ys) - min(ys)
    assert sum(map(area_of, cells.values())) == pytest.approx(1.96 * wide * tall)
    for _ in range(500):
        p = (rng.uniform(min(xs) - 0.2 * wide, max(xs) + 0.2 * wide), rng.uniform(min(ys) - 0.2 * tall, max(ys) + 0.2 * tall))
        gaps = sorted((math.dist(p, q), i) for i, q in enumerate(places))
        if gaps[1][0] - gaps[0][0] > 1e-9:
            assert [i for i, c in cells.items() if holds(c, *p)] == [gaps[0][1]]


def test_clipped_cells(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 1.0), (2, 50.0, 1.0)], "_idx bigint, x double, y double")
    got = {r._idx: r.cell_area for r in voronoi.voronoi(df, bbox=(0.0, 0.0, 4.0, 2.0)).collect()}
    assert got == {0: 4.0, 1: 4.0}
    mask = layer(spark, [[box(0, 0, 4, 2) + [box(0.5, 0.5, 1, 1)[0][::-1]]]])
    assert {r._idx: r.cell_area for r in voronoi.voronoi(df, mask).collect()} == {0: 3.75, 1: 4.0}
    with pytest.raises(ValueError):
        voronoi.voronoi(df.where("_idx = 1"))
