import math
import random
import statistics as st

import pytest
from geoloom.functions import geometry as g
from geoloom.operators import aggregates, attributes, network, raster, scoring, spatial
from geoloom.plans.spec import Operation, QuerySpec, SpecError, run
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, "x", "10"), (1, "x", "30"), (2, "y", "5"), (3, "y", None), (4, "z", "oops")], "_idx bigint, d string, p string")


def test_aggregate_table(rows):
    out = {r.d: r for r in aggregates.aggregate_table(rows, [{"field": "p", "op": "sum"}, {"field": "p", "op": "mean"}, {"op": "count"}], ["d"], "p_sum").collect()}
    assert [out[k].p_sum for k in "xyz"] == [40.0, 5.0, None] and out["x"].p_mean == 20.0 and out["y"]["count"] == 2
    assert list(out) == ["x", "y", "z"]
    assert aggregates.aggregate_table(rows, [{"field": "p", "op": "sum"}]).first().p_sum == 45.0
    assert aggregates.aggregate_table(rows.limit(0), [{"op": "count"}]).count() == 0


def test_points_in_boxes(spark):
    boxes = spark.createDataFrame([(0, "A", 0.0, 0.0, 10.0, 10.0), (1, "B", 10.0, 0.0, 20.0, 10.0), (2, "C", 50.0, 50.0, 60.0, 60.0)], "_idx bigint, name string, a double, b double, c double, d double")
    boxes = boxes.withColumn("geometry", g.rectangle(*[F.col(c) for c in "abcd"])).drop(*"abcd")
    points = spark.createDataFrame([(0, 1.0, 1.0, 10.0), (1, 2.0, 2.0, 30.0), (2, 15.0, 5.0, 7.0), (3, 10.0, 5.0, 100.0), (4, 99.0, 99.0, 1.0), (5, None, 1.0, 1.0)], "_idx bigint, x double, y double, v double")
    out = {r.name: r for r in spatial.aggregate_points(points, boxes, 7.0, "v", density=True).collect()}
    assert [out[k].point_count for k in "ABC"] == [3, 2, 0] and out["A"].v_sum == 140.0 and out["A"].density == 0.03 and out["C"].v_sum is None
    assert {r._idx for r in spatial.filter_points_in_polygon(points, boxes, 7.0, "outside").collect()} == {4, 5}
    left = {r._idx: r for r in spatial.spatial_join(points, boxes, 7.0, join_type="left").collect()}
    assert left[3]._joined_count == 2 and left[3].target_name == "A" and left[4]._join_status == "unmatched"
    assert spatial.spatial_join(points, boxes, 7.0, cardinality="one_to_many").count() == 5


@pytest.mark.parametrize("k, cell", [(1, None), (3, None), (5, 0.7)])
def test_nearest_equals_brute_force(spark, k, cell):
    rng = random.Random(k)
    a = [(i, rng.choice([rng.uniform(0, 100), 1e4]), rng.uniform(0, 100)) for i in range(60)]
    b = [(i, round(rng.gauss(20, 9)), round(rng.gauss(20, 9))) for i in range(150)]
    df, dt = spark.createDataFrame(a, "_idx bigint, x double, y double"), spark.createDataFrame([(i, float(x), float(y)) for i, x, y in b], "_idx bigint, x double, y double")
    got = {(r.source, r["rank"]): r.target for r in spatial.nearest(df, dt, k, cell=cell).collect()}
    for i, x, y in a:
        want = sorted((math.hypot(x - u, y - v), j) for j, u, v in b)[:k]
        assert [got[i, n + 1] for n in range(k)] == [j for _, j in want]
    assert spatial.nearest(df, dt.limit(0)).count() == 0


def test_hotspots_and_errors(spark):
    pts = [(i, float(i % 10), float(i // 10), 100.0 if i % 10 < 3 and i // 10 < 3 else 1 + 0.1 * ((7 * (i // 10) + 3 * (i % 10)) % 5)) for i in range(100)]
    df = spark.createDataFrame(pts, "_idx bigint, x double, y double, v double")
    out = {r._idx: r.gi_bin for r in spatial.hotspots(df, "v", "distance", distance=1.5).collect()}
    assert out[11] >= 2 and len(out) == 100
    with pytest.raises(ValueError):
        spatial.hotspots(df.limit(5), "v")


def test_clusters(spark):
    pts = [(i, 0.5 * i, 0.0) for i in range(30)] + [(40 + i, 100 + 0.1 * i, 5.0) for i in range(6)] + [(99, 50.0, 50.0)]
    df = spark.createDataFrame([(i, float(x), y) for i, x, y in pts], "_idx bigint, x double, y double")
    out = {r._idx: (r.cluster_id, r.cluster_size) for r in spatial.dbscan(df, 0.6, 3).collect()}
    assert {out[i] for i in range(30)} == {(0, 30)} and {out[40 + i] for i in range(6)} == {(1, 6)} and out[99] == (-1, None)


def test_attributes(spark, rows):
    assert [r._idx for r in attributes.filter_features(rows, {"d": {"in": ["X", "y"]}}, "p", True, 2, 1).collect()] == [1, 0]
    assert [r.f for r in attributes.calculate_field(rows, "f", "float(p) * 2").collect()] == [20.0, 60.0, 10.0, None, None]
    made = attributes.map_schema(rows, {"p": "q"}, {"q": "int"}, {"q": -1}, ["d"])
    assert [r.q for r in made.collect()] == [10, 30, 5, -1, -1]
    marked = attributes.deduplicate(rows, ["d"], "last", mark_only=True).orderBy("_idx").collect()
    assert [r.is_duplicate for r in marked] == [True, False, True, False, False]
    many = spark.range(1000).select(F.col("id").alias("_idx"), (F.col("id") % 7).alias("g"), (F.col("id") % 101).cast("double").alias("v"))
    assert attributes.sample_features(many, size=100, stratify_by="g").count() == 100
    one, two = (sorted(r._idx for r in attributes.sample_features(df, fraction=0.05, seed=3).collect()) for df in (many, many.repartition(5)))
    assert one == two and len(one) == 50
    text = spark.createDataFrame([("كتابً  ي 12", 0)], "t string, _idx int")
    assert attributes.normalize_persian_text(text, digits="persian").first().t == "کتاب ی ۱۲"
    assert attributes.jenks([1, 2, 3, 10, 11, 12, 50], 3) == [3, 12, 50]
    classes = attributes.classify_breaks(many, "v", "manual", breaks=[0, 10, 50]).groupBy("class").count().collect()
    assert {r["class"] for r in classes} == {1, 2, None}
    numbered = attributes.number_rows(many, "v", "_idx", name="n").collect()
    assert [r.n for r in sorted(numbered, key=lambda r: (r.v, r._idx))] == list(range(1000))
    out = attributes.enrich_properties(rows, [{"target": "k", "first_existing": ["zz", "p"], "default": "none"}, {"target": "k", "source": "k", "transform": "upper"}])
    assert [r.k for r in out.orderBy("_idx").collect()] == ["10", "30", "5", "NONE", "OOPS"]


def test_scores(spark):
    df = spark.createDataFrame([(0, 100.0, "high", True), (1, 900.0, "low", False), (2, None, "0.1", None)], "_idx bigint, d double, r string, b boolean")
    factors = [{"type": "inverse_distance", "field": "d", "max_distance": 1000}, {"type": "risk_level", "field": "r"}, {"type": "boolean", "field": "b", "weight": 2}]
    assert [r.score for r in scoring.score_features(df, factors).orderBy("_idx").collect()] == [78.75, 21.25, 22.5]
    assert [r["rank"] for r in scoring.rank_features(df, "d").orderBy("_idx").collect()] == [2, 1, 3]
    tops = scoring.rank_topsis(df, [{"field": "d"}]).orderBy("_idx").collect()
    assert [(r.topsis_score, r.topsis_rank) for r in tops] == [(0.0, 2), (1.0, 1), (None, None)]
    ahp = scoring.ahp_weights(["a", "b", "c"], {("a", "b"): 3, ("a", "c"): 5, ("b", "c"): 5 / 3})
    assert ahp["consistent"] and ahp["weights"]["a"] == pytest.approx(15 / 23)


def test_rasters(spark):
    df = spark.range(25).select(F.floor(F.col("id") / 5).alias("row"), (F.col("id") % 5).alias("col"), (F.col("id") + 1).cast("double").alias("b1"))
    hole = df.withColumn("b1", F.when(F.col("b1") != 13, F.col("b1")))
    focal = {(r.row, r.col): r.value for r in raster.focal_statistics(hole, "sum").collect()}
    assert focal[2, 2] == 7 + 8 + 9 + 12 + 14 + 17 + 18 + 19 and focal[0, 0] == 1 + 2 + 6 + 7
    slope = {(r.row, r.col): r.slope for r in raster.slope_aspect(df).collect()}
    assert slope[0, 0] is None and slope[2, 2] == pytest.approx(math.degrees(math.atan(math.hypot(1, 5))), abs=1e-6)
    assert raster.raster_statistics(hole, ["b1"]).first().valid_count == 24
    marks = df.withColumn("m", F.col("b1").isin(1.0, 2.0, 6.0, 8.0, 20.0, 25.0).cast("double"))
    sizes = sorted(r.pixel_count for r in raster.raster_components(marks, "m").collect())
    assert sizes == [1, 2, 3] and sorted(r.pixel_count for r in raster.raster_components(marks, "m", connectivity=8).collect()) == [2, 4]
    lines = raster.contours(df, [10.5]).select(F.sum(g.length(F.col("geometry")))).first()[0]
    assert lines == pytest.approx(4 * math.hypot(1, 0.2))
    assert raster.reproject_nearest(df, "b1", 2, 2, 2.0, 0.0, 0.0, lambda x, y: (x, y), 1.0, 0.0, 0.0).agg(F.sum("value")).first()[0] == 7 + 9 + 17 + 19


def test_networks(spark, monkeypatch):
    n = 6
    lines = [((i, j), (i + 1, j)) for i in range(n - 1) for j in range(n)] + [((i, j), (i, j + 1)) for i in range(n) for j in range(n - 1)]
    df = spark.createDataFrame([(k, *map(float, a + b), "0" if a == (2, 2) else None) for k, (a, b) in enumerate(lines)], "_idx bigint, a double, b double, c double, d double, w string")
    df = df.withColumn("geometry", g.line(F.array(g.vertex(F.col("a"), F.col("b")), g.vertex(F.col("c"), F.col("d")))))
    edges = network.build_edges(df)
    path = network.shortest_path(edges, "0.0 0.0", "5.0 5.0").collect()
    assert len(path) == 11 and path[0].dist == 10.0
    assert network.build_edges(df, "w").count() == edges.count() - 2
    origins = spark.createDataFrame([("o", "0.0 0.0"), ("p", "3.0 2.0")], "origin string, node string")
    direct = {tuple(r) for r in network.distances_from(edges, origins, 4.0).collect()}
    assert len(direct) == sum(i + j <= 4 for i in range(n) for j in range(n)) + sum(abs(i - 3) + abs(j - 2) <= 4 for i in range(n) for j in range(n))
    monkeypatch.setattr(network, "DISTRICT_ARCS", 20)
    monkeypatch.setattr(network, "BATCH_ORIGINS", 1)
    assert network.districts(network.directed(edges)).select("district").distinct().count() > 3
    assert {tuple(r) for r in network.distances_from(edges, origins, 4.0).collect()} == direct
    share = network.service_area(edges, origins.where("origin = 'o'"), [1.5]).agg(F.sum("share")).first()[0]
    assert share == 4.0
    snapped = network.snap(spark.createDataFrame([(1, 0.2, 0.9)], "_idx bigint, x double, y double"), network.nodes_of(edges)).first()
    assert snapped.node == "0.0 1.0"


def test_distances_between_districts(spark, monkeypatch):
    """A network of odd costs against all ways by Bellman and Ford; nodes apart, without numbers and unknown to it."""
    rng = random.Random(7)
    spots = [f"{rng.randrange(-500, 500)}.5 {rng.randrange(-90, 90)}.0" for _ in range(60)] + ["depot"]
    ways = [(k, *rng.sample(spots, 2), rng.random() * 10 + 0.01) for k in range(110)] + [(200, "9000.0 1.0", "9001.0 1.0", 1.0)]
    edges = spark.createDataFrame(ways, "edge_id bigint, u string, v string, cost double")
    starts = [(f"o{i}", spots[i * 3]) for i in range(12)] + [("o0", "depot"), ("far", "9000.0 1.0"), ("alone", "5.0 5.0"), ("none", None)]
    want = {}
    for origin in {o for o, node in starts if node}:
        dist = {node: 0.0 for o, node in starts if o == origin}
        for _ in range(len(spots)):
            for _, u, v, cost in ways:
                for a, b in ((u, v), (v, u)):
                    if a in dist and dist[a] + cost < dist.get(b, math.inf):
                        dist[b] = dist[a] + cost
        want |= {(origin, node): d for node, d in dist.items()}
    monkeypatch.setattr(network, "DISTRICT_ARCS", 30)
    monkeypatch.setattr(network, "BATCH_ORIGINS", 4)
    found = network.distances_from(edges, spark.createDataFrame(starts, "origin string, node string"))
    assert {(r.origin, r.node): r.dist for r in found.collect()} == want
    via = network.predecessors(edges, found).where("via is not null")
    assert via.count() == sum(d > 0 for d in want.values())


def test_specs(spark, rows):
    steps = (Operation("kept", "filter_attribute", {"vector": "in"}, {"where": {"d": "x"}}), Operation("n", "aggregate_table", {"vector": "kept"}, {"aggregations": [{"op": "count"}]}))
    assert run(QuerySpec(steps, "n"), {"in": rows}).first()["count"] == 2
    for broken in (QuerySpec(steps, "zz"), QuerySpec((Operation("a", "nope", {}),), "a"), QuerySpec((Operation("a", "explode", {"vector": "b"}),), "a"), QuerySpec((Operation("a", "spatial_join", {"source": "in"}),), "a")):
        with pytest.raises(SpecError):
            run(broken, {"in": rows})


def test_words_of_truth_and_comparisons(spark):
    df = spark.createDataFrame([(0, "inside", 2.0, "a"), (1, "on", 0.0, "5"), (2, None, None, None)], "_idx int, w string, n double, t string")

    def scores(**factor):
        return [r.s for r in df.withColumn("s", scoring.factor_score(df, factor)).orderBy("_idx").collect()]

    assert scores(type="boolean", field="w") == [1.0, 0.0, 0.0] and scores(type="boolean", field="n") == [1.0, 0.0, 0.0]
    assert scores(type="threshold", field="t", op="eq", value="a") == [1.0, 0.0, 0.0]
    assert scores(type="threshold", field="t", op="==", value=5) == [0.0, 0.0, 0.0]
    assert scores(type="threshold", field="t", op="gte", value=5) == [0.0, 1.0, 0.0]
    assert scores(type="threshold", field="n", op="ne", value=2) == [0.0, 1.0, 1.0]
    assert scores(type="threshold", field="n", op="lt", value="x") == [0.0, 0.0, 0.0]


def test_persian_text_keeps_lines(spark):
    lines = spark.createDataFrame([("\n a  b \n\n c۝ ‌ d⁧ ",), (None,), ("",)], "t string")
    assert [r.t for r in attributes.normalize_persian_text(lines).collect()] == ["a b \n\n c‌d", None, ""]


def test_kernel_density_is_north_up(spark):
    points = spark.createDataFrame([(0.0, 0.0), (10.0, 30.0), (10.0, 30.0), (None, 1.0)], "x double, y double")
    got = {(r.row, r.col): r.density for r in spatial.kernel_density(points, 2.0, 1.0, kernel="epanechnikov").collect()}
    assert set(got) == {(0, 5), (15, 0)} and got[(0, 5)] == pytest.approx(4 / math.pi, abs=1e-8) and got[(15, 0)] == pytest.approx(2 / math.pi, abs=1e-8)
    assert spatial.kernel_density(points.limit(0), 2.0, 1.0).count() == 0
    assert spatial.kernel_density(points, 2.0, 1.0, bbox=(-1.0, -1.0, 1.0, 1.0)).select("row", "col").distinct().collect() == [(0, 0)]


def test_parameters_are_checked(spark):
    df = spark.range(3).select(F.col("id").alias("_idx"), F.col("id").cast("double").alias("score"))
    for params in ({"field": "d"}, {"field": "d", "expression": "1", "overwrit": True}):
        with pytest.raises(SpecError):
            run(QuerySpec((Operation("a", "calculate_field", {"vector": "v"}, params),), "a"), {"v": df})


def test_layers_of_several_roles(spark):
    one = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0)], "row bigint, col bigint, b1 double")
    merged = run(QuerySpec((Operation("m", "mosaic", {"rasters": ["a", "b"]}, {"method": "max"}),), "m"), {"a": one, "b": one.withColumn("col", F.col("col") + 1)})
    assert {(r.row, r.col): r.value for r in merged.collect()} == {(0, 0): 2, (0, 1): 4, (0, 2): 4}
    homes = spark.createDataFrame([(0, 51.0, 35.0)], "_idx bigint, x double, y double").withColumn("geometry", g.point(F.col("x"), F.col("y")))
    out = run(QuerySpec((Operation("e", "real_estate_spatial_enrich", {"vector": "homes", "metro": "homes"}),), "e"), {"homes": homes}).first()
    assert out.distance_to_metro_m == 0 and out.spatial_enrichment_applied
    with pytest.raises(SpecError):
        run(QuerySpec((Operation("e", "real_estate_spatial_enrich", {"vector": "homes", "towers": "homes"}),), "e"), {"homes": homes})
    text = run(QuerySpec((Operation("t", "export_geojson", {"vector": "homes"}),), "t"), {"homes": homes.drop("x", "y")}).first().feature
    assert text == '{"type":"Feature","geometry":{"type":"Point","coordinates":[51.0,35.0]},"properties":{"_idx":0}}'
    box = homes.withColumn("geometry", g.rectangle(F.lit(0.0), F.lit(0.0), F.lit(2.5), F.lit(1.0)))
    grid = run(QuerySpec((Operation("g", "generate_grid", {"vector": "box"}, {"cell_size": 1.0, "clip_to_features": True}),), "g"), {"box": box})
    assert {r.cell_id for r in grid.collect()} == {"0_0", "0_1", "0_2"}


def test_windows_across_tiles(spark, monkeypatch):
    """Tiles of any size give what plain windows give, also with holes and missing pixels."""
    rng = random.Random(2)
    cells = {(r, c): None if rng.random() < 0.1 else float(rng.randrange(50)) for r in range(-3, 14) for c in range(20) if rng.random() < 0.9}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, b1 double")
    monkeypatch.setattr(raster, "TILE", 6)
    made = {"mean": st.fmean, "median": st.median, "min": min, "max": max, "sum": sum, "std": st.pstdev, "range": lambda v: max(v) - min(v)}
    for shape, radius in (("square", 1), ("circle", 2), ("square", 7)):
        for name, f in made.items():
            got = {(r.row, r.col): r.value for r in raster.focal_statistics(df, name, radius, shape).collect()}
            assert got.keys() == cells.keys()
            for (r, c), value in got.items():
                near = [v for (a, b), v in cells.items() if v is not None and abs(a - r) <= radius and abs(b - c) <= radius and (shape == "square" or (a - r) ** 2 + (b - c) ** 2 <= radius**2)]
                assert value == (pytest.approx(f(near), abs=1e-6) if near else None)
    got = {(r.row, r.col): r.slope for r in raster.slope_aspect(df).collect()}
    for (r, c), slope in got.items():
        n = [[cells.get((r + i, c + j)) for j in (-1, 0, 1)] for i in (-1, 0, 1)]
        outer = [n[i][j] for i in range(3) for j in range(3) if (i, j) != (1, 1)]
        if n[1][1] is None or any(v is None for v in outer):
            assert slope is None
        else:
            dx = ((n[0][2] + 2 * n[1][2] + n[2][2]) - (n[0][0] + 2 * n[1][0] + n[2][0])) / 8
            dy = ((n[2][0] + 2 * n[2][1] + n[2][2]) - (n[0][0] + 2 * n[0][1] + n[0][2])) / 8
            assert slope == pytest.approx(math.degrees(math.atan(math.hypot(dx, dy))), abs=1e-5)
