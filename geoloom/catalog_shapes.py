"""Registered queries over shapes: overlay, buffers, joins and neighbours of lines and polygons, vectorised rasters, noded networks.

Customers and suppliers are plots or lines at their place here, so that plain SQL over rectangles gives the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import CUST, PIX, SQUARES, STRIPS, SUPP, customers, depots, pixels, query, squares, streets, strips, suppliers, table
from .functions import geometry as g
from .functions.numbers import even_round
from .operators import buffers, network, overlay, proximity, raster, shapes, spatial
from .operators import voronoi as voronoi_cells
from .operators.storage import shared_folder
from .sources import files, sinks


def plots(df: DataFrame, wide: float, tall: float, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Layers of points as rectangles from their place to the right and up."""
    x, y = F.col("x") + dx, F.col("y") + dy
    return df.drop("geometry").withColumn("geometry", g.rectangle(x, y, x + wide, y + tall)).drop("x", "y")


def bars(df: DataFrame, length: float) -> DataFrame:
    """Layers of points as lines to the right."""
    return df.withColumn("geometry", g.line(F.array(g.vertex(F.col("x"), F.col("y")), g.vertex(F.col("x") + length, F.col("y"))))).drop("x", "y")


def slats(spark, sf_dir) -> DataFrame:
    """The strips, ten wide and taller than the map."""
    moved = g.map_vertices(F.col("geometry"), lambda v: g.vertex(F.col("_idx") * 20.0 + 7 + (v["x"] - F.col("_idx") * 20.0) / 2, v["y"] * 1.2 - 10))
    return strips(spark, sf_dir).withColumn("geometry", moved)


SLATS = f"(SELECT _idx, r_name, x0+7 AS x0, x0+17 AS x1, -10.0 AS y0, 110.0 AS y1 FROM {STRIPS})"
COVERED = f"(SELECT a._idx, sum(greatest(0, least(a.x+4, b.x1)-greatest(a.x, b.x0)))*4 AS area FROM {CUST} a, {SLATS} b GROUP BY 1)"


def area() -> Column:
    return even_round(g.area(F.col("geometry"))).alias("area")


# overlay

@query(f"SELECT _idx, round_even(area, 6) AS area FROM {COVERED} WHERE area > 1e-7")
def clip_features(spark, sf_dir):
    return overlay.clip_by(plots(customers(spark, sf_dir), 4.0, 4.0), slats(spark, sf_dir)).select("_idx", area())


@query(f"SELECT _idx, round_even(16-area, 6) AS area FROM {COVERED} WHERE area < 16-1e-7")
def erase(spark, sf_dir):
    return overlay.erase(plots(customers(spark, sf_dir), 4.0, 4.0), slats(spark, sf_dir)).select("_idx", area())


@query(f"SELECT _idx, round_even(n, 6) AS length FROM (SELECT a._idx, sum(greatest(0, least(a.x+8, b.x1)-greatest(a.x, b.x0))) AS n FROM {SUPP} a, {SLATS} b GROUP BY 1) WHERE n > 1e-7")
def clip_lines(spark, sf_dir):
    out = overlay.clip_by(bars(suppliers(spark, sf_dir), 8.0), slats(spark, sf_dir))
    return out.select("_idx", even_round(g.length(F.col("geometry"))).alias("length"))


@query(f"""
SELECT 'both' AS overlay_origin, a.n_name AS source_n_name, b.r_name AS target_r_name, 200.0::DOUBLE AS area FROM {SQUARES} a JOIN {SLATS} b ON b.x0 > a.x0 AND b.x1 < a.x1
UNION ALL SELECT 'source', a.n_name, NULL, 20*(b.x0-a.x0) FROM {SQUARES} a JOIN {SLATS} b ON b.x0 > a.x0 AND b.x1 < a.x1
UNION ALL SELECT 'source', a.n_name, NULL, 20*(a.x1-b.x1) FROM {SQUARES} a JOIN {SLATS} b ON b.x0 > a.x0 AND b.x1 < a.x1
UNION ALL SELECT 'target', NULL, r_name, 100.0 FROM {SLATS} UNION ALL SELECT 'target', NULL, r_name, 100.0 FROM {SLATS}""")
def union(spark, sf_dir):
    return overlay.union(squares(spark, sf_dir), slats(spark, sf_dir)).select("overlay_origin", "source_n_name", "target_r_name", area())


@query(f"""
SELECT a._idx AS source, b._idx AS target, round_even((least(a.x+3.05, b.x+5.05)-greatest(a.x, b.x))*(least(a.y+3.05, b.y+5.05)-greatest(a.y, b.y)), 6) AS _intersection_area
FROM {CUST} a JOIN {SUPP} b ON a.x < b.x+5.05 AND b.x < a.x+3.05 AND a.y < b.y+5.05 AND b.y < a.y+3.05""")
def intersect_regions(spark, sf_dir):
    return overlay.regions(plots(customers(spark, sf_dir), 3.05, 3.05), plots(suppliers(spark, sf_dir), 5.05, 5.05)).select("source", "target", "_intersection_area")


@query("""
WITH c AS (SELECT c_nationkey, (c_custkey*7919)%1000 + i.range AS cx, (c_custkey*104729)%1000 + j.range AS cy FROM customer, range(20) i, range(20) j)
SELECT c_nationkey, (SELECT count(*) FROM customer k WHERE k.c_nationkey = c.c_nationkey) AS _feature_count, round_even(count(DISTINCT cx*10000+cy)/100.0::DOUBLE, 6) AS area FROM c GROUP BY 1""")
def dissolve_overlapping(spark, sf_dir):
    return overlay.dissolve(plots(customers(spark, sf_dir), 2.0, 2.0), ["c_nationkey"]).select("c_nationkey", "_feature_count", area())


# buffers

@query(f"SELECT _idx, round_even((1+_idx%5)*(1+_idx%3) + 2*1.5*((1+_idx%5)+(1+_idx%3)) + 16*2.25*sin(2*pi()/32), 6) AS area FROM {SUPP}")
def buffer_polygons(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    df = suppliers(spark, sf_dir).withColumn("geometry", g.rectangle(x, y, x + 1 + F.col("_idx") % 5, y + 1 + F.col("_idx") % 3))
    return buffers.buffer(df, 1.5).select("_idx", area())


@query(f"SELECT _idx, round_even(2*2*(4+_idx%7) + 2*2*4::DOUBLE, 6) AS area FROM {SUPP}")
def buffer_lines(spark, sf_dir):
    df = suppliers(spark, sf_dir).withColumn("geometry", g.line(F.array(g.vertex(F.col("x"), F.col("y")), g.vertex(F.col("x"), F.col("y") + 4 + F.col("_idx") % 7))))
    return buffers.buffer(df, 2.0, cap_style="square").select("_idx", area())


@query(f"SELECT _idx, round_even((3+_idx%4-1)*(5-1)::DOUBLE, 6) AS area FROM {SUPP}")
def buffer_inwards(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    df = suppliers(spark, sf_dir).withColumn("geometry", g.rectangle(x, y, x + 3 + F.col("_idx") % 4, y + 5))
    return buffers.buffer(df, -0.5).select("_idx", area())


@query()
def rotated_rectangles(spark, sf_dir):
    df = customers(spark, sf_dir).withColumn("geometry", g.point(F.col("x"), F.col("y")))
    return shapes.rotated_rectangle(df, "c_nationkey").select("c_nationkey", "feature_count", "shape_area")


# neighbours and joins

TO_BAR = "sqrt(pow(greatest(b.x-a.x, 0, a.x-(b.x+5)), 2) + pow(a.y-b.y, 2))"
TO_PLOT = "sqrt(pow(greatest(b.x-(a.x+1.53), 0, a.x-(b.x+3.05)), 2) + pow(greatest(b.y-(a.y+1.53), 0, a.y-(b.y+3.05)), 2))"


@query(f"SELECT source, target, round_even(d, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT a._idx AS source, b._idx AS target, {TO_BAR} AS d, row_number() OVER (PARTITION BY a._idx ORDER BY round({TO_BAR}, 9), b._idx) AS rank FROM {CUST} a, {SUPP} b) WHERE rank <= 2")
def nearest_lines(spark, sf_dir):
    points = customers(spark, sf_dir).withColumn("geometry", g.point(F.col("x"), F.col("y"))).drop("x", "y")
    return proximity.nearest(points, bars(suppliers(spark, sf_dir), 5.0), 2).select("source", "target", even_round(F.col("distance")).alias("distance"), "rank")


@query(f"SELECT source, target, round_even(d, 6) AS distance FROM (SELECT a._idx AS source, b._idx AS target, {TO_PLOT} AS d, row_number() OVER (PARTITION BY a._idx ORDER BY round({TO_PLOT}, 9), b._idx) AS rank FROM {CUST} a, {SUPP} b) WHERE rank = 1")
def nearest_polygons(spark, sf_dir):
    return proximity.distances(plots(customers(spark, sf_dir), 1.53, 1.53), plots(suppliers(spark, sf_dir), 3.05, 3.05))


@query(f"SELECT a._idx AS c_custkey, count(b._idx) AS _joined_count, min(b._idx) AS target, arg_min(b.s_name, b._idx) AS s_name FROM {CUST} a LEFT JOIN {SUPP} b ON a.x <= b.x+3.05 AND b.x <= a.x+1.53 AND a.y <= b.y+3.05 AND b.y <= a.y+1.53 GROUP BY 1")
def spatial_join_polygons(spark, sf_dir):
    out = proximity.spatial_join(plots(customers(spark, sf_dir), 1.53, 1.53), plots(suppliers(spark, sf_dir), 3.05, 3.05), join_type="left")
    return out.select("c_custkey", "_joined_count", F.col("_target_index").alias("target"), F.col("target_s_name").alias("s_name"))


@query(f"SELECT a._idx AS source, b._idx AS target FROM {CUST} a JOIN {SUPP} b ON sqrt(pow(greatest(b.x-a.x, 0, a.x-(b.x+5)), 2) + pow(a.y-b.y, 2)) <= 1.23")
def dwithin_lines(spark, sf_dir):
    points = customers(spark, sf_dir).withColumn("geometry", g.point(F.col("x"), F.col("y"))).drop("x", "y")
    return proximity.related_pairs(points, bars(suppliers(spark, sf_dir), 5.0), "dwithin", 1.23)


@query(f"SELECT a._idx AS source, b._idx AS target FROM {CUST} a JOIN {SQUARES} b ON a.x >= b.x0 AND a.x+1.53 <= b.x1 AND a.y >= b.y0 AND a.y+1.53 <= b.y1")
def join_within(spark, sf_dir):
    return proximity.related_pairs(plots(customers(spark, sf_dir), 1.53, 1.53), squares(spark, sf_dir), "within")


HOMES = "(SELECT c_custkey, 51 + CAST((c_custkey*7919)%1000 AS DOUBLE)/10/200 AS lon, 35 + CAST((c_custkey*104729)%1000 AS DOUBLE)/10/200 AS lat FROM customer)"
STOPS = "(SELECT s_suppkey, 51 + CAST((s_suppkey*7919)%1000 AS DOUBLE)/10/200 AS lon, 35 + CAST((s_suppkey*104729)%1000 AS DOUBLE)/10/200 AS lat FROM supplier)"


@query(f"""
WITH d AS (SELECT c_custkey, min(2*6371000*asin(least(1, sqrt(pow(sin(radians(b.lat-a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2), 2))))) AS metro,
  min(sqrt(pow(greatest(b.lon-a.lon, 0, a.lon-(b.lon+0.02))*111320*cos(radians(a.lat)), 2) + pow((a.lat-b.lat)*110540, 2))) AS road FROM {HOMES} a, {STOPS} b GROUP BY 1)
SELECT c_custkey, CAST(round_even(metro, 0) AS BIGINT) AS distance_to_metro_m, CAST(round_even(road, 0) AS BIGINT) AS distance_to_main_road_m FROM d""")
def real_estate_spatial_enrich(spark, sf_dir):
    shift = {"x": 51 + F.col("x") / 200, "y": 35 + F.col("y") / 200}
    homes, stops = (df.withColumns(shift) for df in (customers(spark, sf_dir), suppliers(spark, sf_dir)))
    dots = lambda df: df.withColumn("geometry", g.point(F.col("x"), F.col("y"))).drop("x", "y")
    out = proximity.enrich_real_estate(dots(homes), metro=dots(stops), main_roads=bars(stops, 0.02))
    return out.select("c_custkey", "distance_to_metro_m", "distance_to_main_road_m")


# rasters

@query(f"SELECT row, col, round_even(CASE WHEN b1+b2 > 1e-12 THEN (b2-b1)/(b2+b1) END, 6) AS value FROM {PIX}")
def ndvi_from_bands(spark, sf_dir):
    both = pixels(spark, sf_dir)
    return raster.ndvi_from_bands(both.select("row", "col", "b1"), both.select("row", "col", F.col("b2").alias("b1")))


@query(f"""
WITH p AS (SELECT row, col, b2 > 90 AS v FROM {PIX}), k AS (SELECT row, col FROM p WHERE v),
s AS (SELECT k.row, k.col, 4 - count(n.row) AS sides FROM k LEFT JOIN k n ON abs(n.row-k.row)+abs(n.col-k.col) = 1 GROUP BY 1, 2)
SELECT count(*) AS pixels, round_even(count(*)::DOUBLE, 6) AS area, round_even(CAST(sum(sides) AS DOUBLE), 6) AS perimeter FROM s""")
def raster_polygons(spark, sf_dir):
    out = raster.raster_polygons(pixels(spark, sf_dir).withColumn("b4", (F.col("b2") > 90).cast("double")), "b4", [1.0])
    return out.agg(F.sum("pixel_count").alias("pixels"), even_round(F.sum("area")).alias("area"), even_round(F.sum("perimeter")).alias("perimeter"))


MARCH = f"""
WITH q AS (SELECT a.row, a.col, a.b2 AS a, b.b2 AS b, c.b2 AS c, d.b2 AS d, l.lv FROM {PIX} a JOIN {PIX} b ON b.row = a.row AND b.col = a.col+1 JOIN {PIX} c ON c.row = a.row+1 AND c.col = a.col+1 JOIN {PIX} d ON d.row = a.row+1 AND d.col = a.col, (VALUES (100.0::DOUBLE), (200.0::DOUBLE)) l(lv)),
s AS (SELECT *, CASE WHEN (a >= lv) <> (b >= lv) THEN (lv-a)/(b-a) END AS tx, CASE WHEN (b >= lv) <> (c >= lv) THEN (lv-b)/(c-b) END AS ry, CASE WHEN (d >= lv) <> (c >= lv) THEN (lv-d)/(c-d) END AS bx, CASE WHEN (a >= lv) <> (d >= lv) THEN (lv-a)/(d-a) END AS ly FROM q),
n AS (SELECT lv, (tx IS NOT NULL)::INT + (ry IS NOT NULL)::INT + (bx IS NOT NULL)::INT + (ly IS NOT NULL)::INT AS k, ((a+b+c+d)/4 >= lv) = (a >= lv) AS joined,
  sqrt(pow(1-tx, 2)+pow(ry, 2)) AS tr, sqrt(pow(bx, 2)+pow(1-ly, 2)) AS bl, sqrt(pow(tx, 2)+pow(ly, 2)) AS tl, sqrt(pow(1-bx, 2)+pow(1-ry, 2)) AS br, sqrt(1+pow(tx-bx, 2)) AS tb, sqrt(1+pow(ry-ly, 2)) AS rl FROM s)
SELECT lv AS level, round_even(sum(CASE WHEN k = 4 THEN CASE WHEN joined THEN tr+bl ELSE tl+br END WHEN k = 2 THEN coalesce(tr, bl, tl, br, tb, rl) END), 4) AS length FROM n WHERE k > 0 GROUP BY 1"""


@query(MARCH)
def contour_lines(spark, sf_dir):
    out = raster.contour_lines(pixels(spark, sf_dir), [100.0, 200.0], "b2")
    return out.groupBy("level").agg(even_round(F.sum(g.length(F.col("geometry"))), 4).alias("length"))


@query(MARCH)
def contour_segments(spark, sf_dir):
    out = raster.contours(pixels(spark, sf_dir), [100.0, 200.0], "b2")
    return out.groupBy("level").agg(even_round(F.sum(g.length(F.col("geometry"))), 4).alias("length"))


@query(f"""
SELECT b._idx, count(a.row) AS zonal_count, count(a.b1) AS zonal_valid_count, count(a.row)-count(a.b1) AS zonal_nodata_count, sum(a.b1) AS zonal_sum, max(a.b1) AS zonal_max
FROM (SELECT _idx, x+0.23 AS x0, x+5.28 AS x1, y+0.23 AS y0, y+5.28 AS y1 FROM {SUPP}) b LEFT JOIN (SELECT row, col, b1 FROM {PIX}) a ON a.col <= b.x1 AND a.col+1 >= b.x0 AND 100-a.row-1 <= b.y1 AND 100-a.row >= b.y0 GROUP BY 1""")
def zonal_all_touched(spark, sf_dir):
    zones = plots(suppliers(spark, sf_dir), 5.05, 5.05, 0.23, 0.23)
    out = raster.zonal_statistics(pixels(spark, sf_dir), zones, y0=100.0, all_touched=True)
    return out.select("_idx", *[f"zonal_{s}" for s in ("count", "valid_count", "nodata_count", "sum", "max")])


@query(f"""
WITH m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM {SUPP})
SELECT n AS cells, round_even((x1-x0)*1.4*(y1-y0)*1.4, 4) AS area, 0.0::DOUBLE AS overlap FROM m""")
def voronoi(spark, sf_dir):
    """How many cells there are, what they cover together, and how many customers lie in the cell of a supplier that isn't their nearest."""
    sites, homes = suppliers(spark, sf_dir), customers(spark, sf_dir)
    cells = voronoi_cells.voronoi(sites)
    held = spatial.point_pairs(homes, cells, 10.0, "within").select("source", F.col("target").alias("cell"))
    wrong = held.join(spatial.nearest(homes, sites, 1), "source").where("cell <> target and distance > 0").agg(F.count(F.lit(1)).cast("double").alias("overlap"))
    return cells.agg(F.count(F.lit(1)).alias("cells"), even_round(F.sum("cell_area"), 4).alias("area")).crossJoin(wrong)  # tables of one row


# projections

_T = f"(SELECT _idx, sinh(atanh(sin(radians(y/2))) - {2 * g._N**0.5 / (1 + g._N)!r}*atanh({2 * g._N**0.5 / (1 + g._N)!r}*sin(radians(y/2)))) AS t, radians(x/20) AS l FROM {CUST})"
_SUM = {axis: " + ".join(f"{a!r}*{f1}({2 * j}*xi)*{f2}({2 * j}*eta)" for j, a in enumerate(g._FORWARD, 1)) for axis, f1, f2 in (("x", "cos", "sinh"), ("y", "sin", "cosh"))}


@query(f"SELECT _idx, round_even(500000 + {g.SCALE * g._MERIDIAN!r}*(eta + {_SUM['x']}), 4) AS mx, round_even({g.SCALE * g._MERIDIAN!r}*(xi + {_SUM['y']}), 4) AS my FROM (SELECT _idx, atan2(t, cos(l)) AS xi, atanh(sin(l)/sqrt(1+t*t)) AS eta FROM {_T})")
def crs_transform_utm(spark, sf_dir):
    df = customers(spark, sf_dir).withColumn("geometry", g.point(F.col("x") / 20 + 3, F.col("y") / 2))
    out = shapes.transform_crs(df, 4326, 32631, 4)
    return out.select("_idx", g.x_of(F.col("geometry")).alias("mx"), g.y_of(F.col("geometry")).alias("my"))


# networks

@query(f"""
SELECT 2*a._idx AS edge_id, 1 + count(b._idx) AS edges, round_even(30.0::DOUBLE, 6) AS length FROM {SUPP} a LEFT JOIN {SUPP} b ON b.x+0.05 > a.x AND b.x+0.05 < a.x+30 AND a.y > b.y-15.03 AND a.y < b.y+15.03 GROUP BY a._idx
UNION ALL SELECT 2*b._idx+1, 1 + count(a._idx), round_even(30.06::DOUBLE, 6) FROM {SUPP} b LEFT JOIN {SUPP} a ON b.x+0.05 > a.x AND b.x+0.05 < a.x+30 AND a.y > b.y-15.03 AND a.y < b.y+15.03 GROUP BY b._idx""")
def network_crossings(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    df = suppliers(spark, sf_dir)
    across = df.select((2 * F.col("_idx")).alias("_idx"), g.line(F.array(g.vertex(x, y), g.vertex(x + 30, y))).alias("geometry"))
    up = df.select((2 * F.col("_idx") + 1).alias("_idx"), g.line(F.array(g.vertex(x + 0.05, y - 15.03), g.vertex(x + 0.05, y + 15.03))).alias("geometry"))
    return network.build_edges(across.unionByName(up)).groupBy("edge_id").agg(F.count(F.lit(1)).alias("edges"), even_round(F.sum("length")).alias("length"))


@query("SELECT CAST(p_partkey AS BIGINT) AS part, CAST(p_partkey%20 + p_partkey//20 AS DOUBLE) AS steps FROM part")
def shortest_path(spark, sf_dir):
    """Every part's place on the way from the last street corner: of all corners, how long the shortest way from the depot is."""
    edges = network.build_edges(streets(spark, sf_dir), node_crossings=False)
    start = table(spark, sf_dir, "part").where("p_partkey = 0").select(F.lit("depot").alias("origin"), F.lit("0.0 0.0").alias("node"))
    tree = network.predecessors(edges, network.distances_from(edges, start))
    depth = network.depths(tree)
    n = F.col("p_partkey")
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("part"), network.node_key(F.struct((n % 20).cast("double").alias("x"), F.floor(n / 20).cast("double").alias("y"))).alias("node"))
    return named.join(depth, "node").select("part", F.col("steps").cast("double").alias("steps"))


@query()
def service_polygons(spark, sf_dir):
    edges = network.build_edges(streets(spark, sf_dir), node_crossings=False)
    out = network.service_polygons(edges, depots(spark, sf_dir).select("origin", "node"), [1.0, 2.5], 0.25, 2)
    return out.select("origin", "band", "reached_length", area())


# parts, validity, generalised lines

def knots(df: DataFrame) -> DataFrame:
    """Places as polygons: by turns one that crosses itself, one that isn't closed, a sound one."""
    x, y, k = F.col("x"), F.col("y"), F.col("_idx") % 3
    v = lambda a, b: g.vertex(x + a, y + b)
    ring = F.when(k == 0, F.array(v(0, 0), v(4, 4), v(4, 0), v(0, 4), v(0, 0))).when(k == 1, F.array(v(0, 0), v(4, 0), v(4, 3), v(0, 3))).otherwise(F.array(v(0, 0), v(4, 0), v(4, 2), v(0, 2), v(0, 0)))
    return df.withColumn("geometry", g.polygon(ring))


@query(f"SELECT _idx, _idx%3 = 2 AS is_valid, CASE _idx%3 WHEN 0 THEN 'self-intersection' WHEN 1 THEN 'ring is not closed' END AS invalid_reason FROM {CUST}")
def validate_geometries(spark, sf_dir):
    return shapes.validate(knots(customers(spark, sf_dir))).select("_idx", "is_valid", "invalid_reason")


@query(f"SELECT _idx, true AS is_valid, _idx%3 < 2 AS _repaired, CASE _idx%3 WHEN 0 THEN 2 ELSE 1 END AS parts, round_even(CASE _idx%3 WHEN 0 THEN 8.0 WHEN 1 THEN 12.0 ELSE 8.0 END::DOUBLE, 6) AS area FROM {CUST}")
def repair_geometries(spark, sf_dir):
    return overlay.repair(knots(customers(spark, sf_dir))).select("_idx", "is_valid", "_repaired", F.size("geometry.coords").alias("parts"), area())


@query(f"SELECT a._idx AS feature, 'overlap' AS issue, b._idx AS other, round_even((15-abs(a.x-b.x))*(15-abs(a.y-b.y)), 6) AS area FROM {SUPP} a JOIN {SUPP} b ON a._idx < b._idx AND abs(a.x-b.x) < 15-1e-7 AND abs(a.y-b.y) < 15-1e-7")
def check_topology(spark, sf_dir):
    return overlay.check_topology(plots(suppliers(spark, sf_dir), 15.0, 15.0))


@query(f"SELECT _idx, 2 + (_idx%10 > 4)::INT AS vertices, round_even(CASE WHEN _idx%10 > 4 THEN 2*sqrt(1+((_idx%10)/10)**2) ELSE 2 END, 6) AS length FROM {CUST}")
def simplify(spark, sf_dir):
    x, y, up = F.col("x"), F.col("y"), (F.col("_idx") % 10) / 10
    bent = customers(spark, sf_dir).withColumn("geometry", g.line(F.array(g.vertex(x, y), g.vertex(x + 1, y + up), g.vertex(x + 2, y))))
    out = shapes.simplify(bent, 0.45)
    return out.select("_idx", F.size(g.vertices(F.col("geometry"))).alias("vertices"), even_round(g.length(F.col("geometry"))).alias("length"))


@query(f"SELECT _idx AS source_feature_index, CAST(i AS INT) AS part_index, 'Polygon' AS kind, round_even(CAST((i+1)*2 AS DOUBLE), 6) AS area FROM (SELECT _idx, unnest(range(0, 1 + _idx%3)) AS i FROM {CUST})")
def explode_parts(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    ring = lambda i: F.array(F.array(g.vertex(x + 5 * i, y), g.vertex(x + 6 * i + 1, y), g.vertex(x + 6 * i + 1, y + 2), g.vertex(x + 5 * i, y + 2), g.vertex(x + 5 * i, y)))
    several = customers(spark, sf_dir).withColumn("geometry", F.struct(F.lit("MultiPolygon").alias("type"), F.transform(F.sequence(F.lit(0), (F.col("_idx") % 3).cast("int")), ring).alias("coords")))
    return shapes.explode_multipart(several).select("source_feature_index", "part_index", F.col("geometry.type").alias("kind"), area())


# files

@query(f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal, x, y FROM {CUST}")
def csv_points(spark, sf_dir):
    """Customers through a file with semicolons, decimal commas and no types."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    local = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    customers(spark, sf_dir).select("c_custkey", "c_name", local("c_acctbal").alias("c_acctbal"), local("x").alias("Lon"), local("y").alias("Lat")).write.option("header", True).option("sep", ";").csv(path)
    return files.read_csv_points(spark, path, wgs84=False).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal", "x", "y")


@query(f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'Polygon' AS kind, x, y, round_even(6.0::DOUBLE, 6) AS area FROM {CUST}")
def csv_shapes(spark, sf_dir):
    """Customers' plots through a file with well-known text."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_table(plots(customers(spark, sf_dir), 3.0, 2.0).select("c_custkey", "geometry"), path, include_geometry="wkt")
    first = F.get(F.get(F.get(F.col("geometry.coords"), 0), 0), 0)
    return files.read_csv_points(spark, path, wkt_field="wkt").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("geometry.type").alias("kind"), first["x"].alias("x"), first["y"].alias("y"), area())


@query(f"SELECT c_name, c_acctbal, x, y FROM {CUST}")
def geojson_features(spark, sf_dir):
    """Customers through a file of features, a line each."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.ndjson"
    points = customers(spark, sf_dir).select("c_name", "c_acctbal", g.point(F.col("x"), F.col("y")).alias("geometry"))
    sinks.write_geojson(points, path)
    return files.read_geojson(spark, path).select("c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), g.x_of(F.col("geometry")).alias("x"), g.y_of(F.col("geometry")).alias("y"))


# resampled rasters

@query(f"""
WITH p AS {PIX}, s AS (SELECT max(row) AS r1, max(col) AS c1 FROM p), n AS (SELECT r1, c1, CAST(ceil((r1+1)/0.8-1e-9) AS BIGINT) AS nr, CAST(ceil((c1+1)/0.8-1e-9) AS BIGINT) AS nc FROM s),
t AS (SELECT r.range AS row, c.range AS col, (r.range+0.5)*0.8 AS fr, (c.range+0.5)*0.8 AS fc FROM n, range(0, nr) r, range(0, nc) c WHERE (r.range+0.5)*0.8 < r1+1 AND (c.range+0.5)*0.8 < c1+1)
SELECT t.row, t.col, round_even(sum(p.b1*(1-abs(fr-0.5-p.row))*(1-abs(fc-0.5-p.col)))/sum(CASE WHEN p.b1 IS NOT NULL THEN (1-abs(fr-0.5-p.row))*(1-abs(fc-0.5-p.col)) END), 6) AS value
FROM t JOIN (SELECT 0 AS i UNION ALL SELECT 1) a ON true JOIN (SELECT 0 AS j UNION ALL SELECT 1) b ON true LEFT JOIN p ON p.row = CAST(floor(fr-0.5) AS BIGINT)+i AND p.col = CAST(floor(fc-0.5) AS BIGINT)+j GROUP BY 1, 2""")
def reproject_bilinear(spark, sf_dir):
    """Every pixel of the raster on a finer grid; places without a known pixel around are null."""
    out = raster.reproject_raster(pixels(spark, sf_dir), 4326, 4326, "b1", "bilinear", resolution=0.8)
    last = pixels(spark, sf_dir).agg(F.max("row").alias("r1"), F.max("col").alias("c1"))
    inside = out.crossJoin(last).where(((F.col("row") + 0.5) * 0.8 < F.col("r1") + 1) & ((F.col("col") + 0.5) * 0.8 < F.col("c1") + 1))  # one row
    return inside.select("row", "col", even_round(F.col("value")).alias("value"))
