import json

import pytest
from geoloom.functions import geometry as g
from geoloom.sources import files, sinks
from pyspark.sql import functions as F


def test_geojson_round_trip(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 2 * i]}, "properties": {"name": f"n{i}", "v": i, "ok": True}} for i in range(5)] + [{"type": "Feature", "geometry": None, "properties": {"name": "=x"}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = files.read_geojson(spark, f"{tmp_path}/a.geojson")
    assert dict(df.dtypes)["v"] == "bigint" and dict(df.dtypes)["ok"] == "boolean" and df.count() == 6
    sinks.write_geojson(df.drop("_idx"), f"{tmp_path}/out.ndjson")
    again = files.read_geojson(spark, f"{tmp_path}/out.ndjson")
    assert sorted(r.name for r in again.collect()) == sorted(r.name for r in df.collect())
    assert len(json.loads(sinks.feature_collection(df))["features"]) == 6
    with pytest.raises(ValueError):
        sinks.feature_collection(df, most=3)
    table = sinks.table_columns(df, "centroid")
    assert table.where("name = \"'=x\"").count() == 1 and "geometry" not in table.columns
    assert sinks.layer_summary(df)["geometry_counts"] == {"Point": 5, "null": 1}
    assert sinks.static_map(df.select(g.x_of(F.col("geometry")).alias("x"), g.y_of(F.col("geometry")).alias("y"), "v"), "v").count("<circle") == 5


def test_csv_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,lon,lat,code,v\na,۱۲٫۵,\"3,5\",007,1\nb,200,1,008,2\nc,,1,009,x\nd,1,2,010,\n", encoding="utf-8")
    df = files.read_csv_points(spark, f"{tmp_path}/p.csv")
    got = {r.name: (r.x, r.y, r.code, r.v) for r in df.collect()}
    assert got == {"a": (12.5, 3.5, "007", 1.0), "d": (1.0, 2.0, "010", None)}
    with pytest.raises(ValueError):
        files.read_csv_points(spark, f"{tmp_path}/p.csv", delimiter=";")


def test_tables(spark):
    spark.range(5).withColumn("k", F.col("id") * 2).createOrReplaceTempView("numbers")
    assert files.query_table(spark, "numbers", ["k"], "id > 2").count() == 2
    assert files.query_sql(spark, "select count(*) n from numbers").first().n == 5
    for bad in (lambda: files.query_table(spark, "numbers; x"), lambda: files.query_table(spark, "numbers", where="1=1; drop table x"), lambda: files.query_sql(spark, "delete from numbers"), lambda: files.query_table(spark, "numbers", limit=10**6)):
        with pytest.raises(ValueError):
            bad()


def test_lookups(spark):
    assert files.dem_tiles(spark, (0.0, 0.0, 10.0, 10.0), 4).count() == 2
    assert files.dem_tiles(spark, (-10.0, -10.0, 10.0, 10.0), max_tiles=16).count() <= 16
    scenes = spark.createDataFrame([(1, 5.0), (2, None), (3, 80.0)], "id int, cloud_cover double")
    assert {r.id for r in files.filter_scenes(scenes, 20).collect()} == {1, 2}
    places = spark.createDataFrame([(1, "Tehran", 51.4, 35.7), (2, "tehran ", 0.0, 0.0)], "_idx int, name string, x double, y double")
    asked = spark.createDataFrame([(" TEHRAN",), ("zz",)], "query string")
    assert [r.x for r in files.geocode(asked, places).orderBy("query").collect()] == [51.4, None]


def test_csv_details(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("id\tshape\tn\n1\tPOINT (1 2)\t1,234,567\n2\tpolygon((0 0,4 0,4 +3.,0 .3e1,0 0))\t12,5\n3\tPOINT EMPTY\t1\n4\tnonsense\t2\n\t\t\n5\tMULTIPOINT Z ((1 2 9),(3 4 9))\t3\n6\tLINESTRING (1 1)x\t4\n", encoding="utf-8")
    df = files.read_csv_points(spark, f"{tmp_path}/w.tsv", wkt_field="Shape")
    assert {r.id: (r.geometry.type, r.n) for r in df.collect()} == {1.0: ("Point", 1234567.0), 2.0: ("Polygon", 12.5), 5.0: ("MultiPoint", 3.0)}
    assert df.where("id = 2").select(g.area(F.col("geometry"))).first()[0] == 12.0
    assert files.read_csv_points(spark, f"{tmp_path}/w.tsv", wkt_field="shape", max_rows=2).count() == 2
    for wrong in ({"on_invalid": "raise"}, {"on_invalid": "drop"}, {"max_rows": 0}, {"delimiter": ";;"}):
        with pytest.raises(ValueError):
            files.read_csv_points(spark, f"{tmp_path}/w.tsv", wkt_field="shape", **wrong)
    (tmp_path / "old.csv").write_bytes("name;lat;lon\nتهران كي;35,6;51,4\n".encode("windows-1256"))
    row = files.read_csv_points(spark, f"{tmp_path}/old.csv").first()
    assert (row.name, row.x, row.y) == ("تهران کی", 51.4, 35.6)
    (tmp_path / "bom.csv").write_bytes("x,lon,lat\n7,1,2\n8,,2\n".encode("utf-8-sig"))
    row = files.read_csv_points(spark, f"{tmp_path}/bom.csv").collect()
    assert [(r.x, r.y) for r in row] == [(1.0, 2.0)]


@pytest.mark.parametrize("text", ["POINT (1 2)", "LINESTRING (1 2, 3 4.5, -1e3 0)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"])
def test_wkt_round_trip(spark, text):
    once = spark.createDataFrame([(text,)], "t string").select(g.from_wkt(F.col("t")).alias("geometry"))
    again = once.select("geometry", g.from_wkt(g.wkt(F.col("geometry"))).alias("again")).first()
    assert again.geometry is not None and again.geometry == again.again


@pytest.mark.parametrize("text", [None, "", "POINT EMPTY", "POINT (1)", "CIRCLE (1 2)", "LINESTRING (1 2, 3)", "POINT (1 2"])
def test_wkt_of_nothing(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(g.from_wkt(F.col("t")).alias("geometry")).first().geometry is None


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from geoloom.operators.storage import shared_folder

    conf = SimpleNamespace(get=lambda key: None)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://a:7077", getCheckpointDir=lambda: None, getConf=lambda: conf)))
