"""Feature layers to files. Data are written by the executors, a part file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import is_boolean, is_text


def feature_json(df: DataFrame) -> Column:
    """A feature as GeoJSON text: the geometry column, all others as properties."""
    rest = [c for c in df.columns if c != "geometry"]
    properties = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(g.geojson(F.col("geometry")), F.lit("null")), F.lit(',"properties":'), properties, F.lit("}"))


def geojson_rows(df: DataFrame) -> DataFrame:
    """The features as lines of GeoJSON text in ``feature``; nothing is written."""
    return df.select(feature_json(df).alias("feature"))


def write_geojson(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Newline-delimited features, which stay splittable at any size."""
    df.select(feature_json(df).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def feature_collection(df: DataFrame, most: int = 10_000) -> str:
    """A FeatureCollection for display; refused for more than ``most`` features."""
    rows = df.select(feature_json(df).alias("f")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features; use write_geojson")
    return '{"type":"FeatureCollection","features":[' + ",".join(r["f"] for r in rows) + "]}"


def table_columns(df: DataFrame, include_geometry: str = "none") -> DataFrame:
    """Text that starts like a formula is quoted, booleans are words, geometry is left out, WKT or its centroid."""
    out = []
    for c in df.columns:
        if c == "geometry":
            continue
        if is_text(df, c):
            out.append(F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c))
        else:
            out.append((F.col(c).cast("string") if is_boolean(df, c) else F.col(c)).alias(c))
    if include_geometry == "wkt":
        out.append(g.wkt(F.col("geometry")).alias("wkt"))
    elif include_geometry == "centroid":
        centre = g.centroid(F.col("geometry"))
        out += [centre["x"].alias("x"), centre["y"].alias("y")]
    return df.select(*out)


def write_table(df: DataFrame, path: str, kind: str = "csv", include_geometry: str = "none", overwrite: bool = False) -> None:
    writer = table_columns(df, include_geometry).write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "json":
        writer.json(path)
    else:
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)


def write_layer(df: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = False) -> None:
    """The columnar exchange format: Parquet with the geometry struct."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "create", allowed: tuple[str, ...] = ("public",)) -> None:
    schema, _, name = table.rpartition(".")
    if (schema or "public") not in allowed or not name.isidentifier():
        raise ValueError(f"{table} may not be written")
    wkt = df.withColumn("geometry", g.wkt(F.col("geometry"))) if "geometry" in df.columns else df
    wkt.write.jdbc(url, table, mode={"create": "errorifexists", "append": "append", "replace": "overwrite"}[mode], properties=properties)


def static_map(df: DataFrame, value: str, width: int = 800, height: int = 600, classes: int = 5, most: int = 5000) -> str:
    """An SVG of points (x, y) coloured by equal classes of a value; refused for more than ``most`` points."""
    low, high, x0, x1, y0, y1 = df.agg(F.min(value), F.max(value), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    rows = df.select("x", "y", value).where("x is not null and y is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points")
    shades = [f"rgb({255 - 40 * i},{220 - 45 * i},{120})" for i in range(classes)]
    place = lambda v, a, b, size: size / 2 if b == a else (v - a) / (b - a) * size
    dots = []
    for r in rows:
        at = 0 if r[value] is None or high == low else min(classes - 1, int((r[value] - low) / (high - low) * classes))
        dots.append(f'<circle cx="{place(r["x"], x0, x1, width):.2f}" cy="{height - place(r["y"], y0, y1, height):.2f}" r="3" fill="{shades[at]}"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(dots)}</svg>'


def layer_summary(df: DataFrame) -> dict:
    """Counts by geometry type, bounds, columns and five rows: one aggregation and a small limit."""
    b = g.bounds(F.col("geometry"))
    n, x0, y0, x1, y1 = df.agg(F.count(F.lit(1)), F.min(b["minx"]), F.min(b["miny"]), F.max(b["maxx"]), F.max(b["maxy"])).first()
    kinds = {r["t"]: r["n"] for r in df.groupBy(F.coalesce("geometry.type", F.lit("null")).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"feature_count": n, "geometry_counts": kinds, "bbox": [x0, y0, x1, y1], "property_keys": [c for c in df.columns if c != "geometry"], "sample": [r.asDict() for r in df.drop("geometry").limit(5).collect()]}
