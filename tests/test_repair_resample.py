"""Polygons that cross themselves, topology, diagonals through the grid, and resampled rasters."""

import math
import random

import pytest
from geoloom.functions import geometry as g
from geoloom.operators import overlay, raster
from pyspark.sql import functions as F


def shapes_of(spark, rings):
    rows = [(i, None if r is None else ("Polygon", [[[(float(x), float(y)) for x, y in r]]])) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, f"_idx bigint, geometry {g.GEOMETRY}")


STAR = [(10 * math.sin(4 * math.pi * i / 5) + 30, 10 * math.cos(4 * math.pi * i / 5) + 30) for i in range(5)]


def test_repair(spark):
    rings = [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], [*STAR, STAR[0]], [(0, 0), (4, 0), (4, 4)], [(1, 1), (3, 1), (3, 2), (1, 1)], None, [(0, 0), (1, 1), (0, 0)]]
    df = shapes_of(spark, rings).withColumn("is", F.lit(1))
    out = {r._idx: r for r in overlay.repair(df).withColumn("area", g.area(F.col("geometry"))).collect()}
    assert [out[i].is_valid for i in range(6)] == [True, True, True, True, False, False]
    assert [out[i]._repaired for i in range(6)] == [True, True, True, False, False, False]
    assert out[0].area == pytest.approx(8) and len(out[0].geometry.coords) == 2
    # the five points of a star: an even number of turns is around its middle
    inner = 10 * (3 - math.sqrt(5)) / 2
    points = 5 * 0.5 * 2 * inner * math.sin(math.pi / 5) * (10 - inner * math.cos(math.pi / 5))
    assert out[1].area == pytest.approx(points) and len(out[1].geometry.coords) == 5
    assert out[2].area == pytest.approx(8) and out[4].geometry is None
    assert overlay.repair(df, drop_invalid=True).count() == 4


@pytest.mark.parametrize("cell", [0.7, 3.3, 4.0, 50.0])
def test_diagonals(spark, cell):
    """Edges on lines through the corners of cells, whatever the size of the cells."""
    triangle = shapes_of(spark, [[(0, 0), (4, 0), (4, 4), (0, 0)], [(0, 9), (9, 0), (9, 9), (0, 9)]])
    box = shapes_of(spark, [[(2, 0), (8, 0), (8, 8), (2, 8), (2, 0)]])
    left = {r._idx: r.a for r in overlay.erase(triangle, box, cell=cell).select("_idx", g.area(F.col("geometry")).alias("a")).collect()}
    assert left[0] == pytest.approx(2.0)
    kept = {r._idx: r.a for r in overlay.clip_by(triangle, box, cell=cell).select("_idx", g.area(F.col("geometry")).alias("a")).collect()}
    assert kept[0] == pytest.approx(6.0) and kept[1] + left[1] == pytest.approx(40.5)


def test_check_topology(spark):
    rings = [[(0, 0), (6, 0), (6, 6), (0, 0)], [(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)], [(20, 0), (21, 0), (21, 1), (20, 1), (20, 0)], [(20, 0), (21, 0), (21, 1), (20, 1), (20, 0)], [(0, 50), (90, 50), (90, 50.01), (0, 50.01), (0, 50)], [(0, 70), (4, 74), (4, 70), (0, 74), (0, 70)], None, [(8, 0), (9, 0), (9, 1), (8, 1), (8, 0)]]
    df = shapes_of(spark, rings)
    found = {(r.feature, r.issue, r.other): r.area for r in overlay.check_topology(df, min_area=0.95).collect()}
    assert set(found) == {(0, "overlap", 1), (2, "overlap", 3), (3, "duplicate", 2), (4, "sliver", None), (4, "small", None), (5, "invalid", None), (6, "empty", None)}
    assert found[0, "overlap", 1] == pytest.approx(8.0) and found[2, "overlap", 3] == pytest.approx(1.0)
    assert {r.issue for r in overlay.check_topology(df, ["empty", "invalid"]).collect()} == {"empty", "invalid"}
    assert overlay.check_topology(df, ["overlap"], overlap_tolerance=2.0).count() == 1
    assert overlay.check_topology(df, max_issues=2).count() == 2
    for wrong in ({"checks": ["holes"]}, {"min_area": -1.0}):
        with pytest.raises(ValueError):
            overlay.check_topology(df, **wrong)


def resampled(pixels, rows, cols, size, north, fr, fc, half, method):
    """One target pixel from all source pixels, by the definition."""
    if not (0 <= fr < rows and 0 <= fc < cols):
        return None
    keys = lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
    one = {
        "nearest": lambda i, f, h: float(math.floor(f) == i), "bilinear": lambda i, f, h: max(0.0, 1 - abs(f - 0.5 - i)), "cubic": lambda i, f, h: keys(abs(f - 0.5 - i)),
    }.get(method, lambda i, f, h: max(0.0, min(f + h, i + 1) - max(f - h, i)))
    met = [(one(r, fr, half) * one(c, fc, half), v) for (r, c), v in pixels.items() if v is not None]
    met = [(w, v) for w, v in met if abs(w) > 1e-9]
    if not met:
        return None
    if method in ("min", "max"):
        return {"min": min, "max": max}[method](v for _, v in met)
    if method == "mode":
        sums = {}
        for w, v in met:
            sums[v] = sums.get(v, 0.0) + w
        return min(sums, key=lambda v: (-round(sums[v], 9), v))
    return sum(w * v for w, v in met) / sum(w for w, _ in met) if abs(sum(w for w, _ in met)) > 1e-6 else None


@pytest.mark.parametrize("method", raster.RESAMPLING)
def test_resampling(spark, method):
    rng = random.Random(3)
    pixels = {(r, c): rng.choice([None, 1.0, 2.0, 5.0, 9.0]) for r in range(6) for c in range(7)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in pixels.items()], "row bigint, col bigint, b1 double")
    size, west, north, step = 2.0, 10.0, 40.0, 2.6
    out = {(r.row, r.col): r.value for r in raster.reproject_raster(df, 4326, 4326, "b1", method, size, west, north, step).collect()}
    want = {(r, c): resampled(pixels, 6, 7, size, north, (r + 0.5) * step / size, (c + 0.5) * step / size, step / size / 2, method) for r in range(5) for c in range(6)}
    assert set(out) == set(want)
    for k, v in want.items():
        assert out[k] == (None if v is None else pytest.approx(v)), k


def test_reprojection(spark):
    """Rows are unlike in height in the other system: every pixel is the one that its centre comes from."""
    df = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(8) for c in range(5)], "row bigint, col bigint, b1 double")
    out = raster.reproject_raster(df, 4326, 3857, size=5.0, x0=-10.0, y0=60.0).collect()
    assert {r.row for r in out} == set(range(max(r.row for r in out) + 1)) and len(out) >= 30
    radius = 6378137.0
    for r in out:
        lon, lat = math.degrees(r.x / radius), math.degrees(2 * math.atan(math.exp(r.y / radius)) - math.pi / 2)
        row, col = math.floor((60 - lat) / 5), math.floor((lon + 10) / 5)
        assert r.value == (10.0 * row + col if 0 <= row < 8 and 0 <= col < 5 else None)
    assert raster.reproject_raster(df.where("row < 0"), 4326, 3857).count() == 0
    with pytest.raises(ValueError):
        raster.reproject_raster(df, 4326, 3857, resampling="lanczos")
