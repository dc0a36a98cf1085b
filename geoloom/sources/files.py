"""Feature layers from files and databases."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.numbers import LATIN_DIGITS, LOCAL_DIGITS


def read_geojson(spark: SparkSession, path: str, schema: str | None = None, max_features: int | None = None) -> DataFrame:
    """Features with their place in the file (_idx), properties as columns, and geometry.

    Newline-delimited features are split over tasks; a FeatureCollection is one
    document a file. ``schema`` gives the properties in DDL; without it they are
    inferred from a scan.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<features:array<string>>")["features"]).alias("f")) if not path.endswith((".ndjson", ".geojsonl")) else spark.read.text(path).select(F.col("value").alias("f"))
    rows = raw.select(F.monotonically_increasing_id().alias("_idx"), g.from_geojson(F.get_json_object("f", "$.geometry")).alias("geometry"), F.get_json_object("f", "$.properties").alias("p"))
    if max_features is not None:
        rows = rows.orderBy("_idx").limit(max_features)
    if schema is None:
        schema = _inferred(rows)
    return rows.select("_idx", "geometry", F.from_json("p", schema).alias("p")).select("_idx", "geometry", "p.*") if schema else rows.drop("p")


def _inferred(rows: DataFrame) -> str:
    """All property names; a number or boolean only if every value is one."""
    values = rows.select(F.explode(F.from_json("p", "map<string,string>")).alias("k", "v")).where("v is not null")
    number, flag = F.col("v").try_cast("double").isNotNull() & ~F.col("v").rlike("^-?0[0-9]"), F.col("v").isin("true", "false")
    kinds = values.groupBy("k").agg(F.bool_and(F.col("v").try_cast("bigint").isNotNull()).alias("i"), F.bool_and(number).alias("n"), F.bool_and(flag).alias("b")).orderBy("k")
    return ", ".join(f"`{r['k']}` {'bigint' if r['i'] else 'double' if r['n'] else 'boolean' if r['b'] else 'string'}" for r in kinds.collect())


def local_number(name: str) -> F.Column:
    """A number written with Latin, Persian or Arabic digits; one comma without a point is a decimal comma, others group thousands."""
    text = F.regexp_replace(F.translate(F.trim(F.col(name)), LOCAL_DIGITS, LATIN_DIGITS), "[\u066c ]", "")
    comma = ~F.contains(text, F.lit(".")) & (F.length(text) - F.length(F.replace(text, F.lit(","))) == 1)
    plain = F.when(comma, F.replace(text, F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(",")))
    return F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


#: Names of coordinate columns, the first that is there counts; delimiters that are told apart; letters that windows-1256 lacks.
X_NAMES = ("lon", "lng", "long", "longitude", "x", "easting", "lon_dd", "طول", "طول_جغرافیایی", "longitude_deg")
Y_NAMES = ("lat", "latitude", "y", "northing", "lat_dd", "عرض", "عرض_جغرافیایی", "latitude_deg")
DELIMITERS = (",", ";", "\t", "|")
ARABIC_LETTERS, PERSIAN_LETTERS = "يك", "یک"


def delimiter_of(spark: SparkSession, path: str) -> str:
    """The delimiter of a file's first lines (100 at most)."""
    lines = [r["value"] for r in spark.read.text(path).limit(100).collect()]
    head = lines[0] if lines else ""
    try:
        return csv.Sniffer().sniff("\n".join(lines)[:8192], "".join(DELIMITERS)).delimiter
    except csv.Error:
        return max(DELIMITERS, key=head.count)


def read_csv_points(
    spark: SparkSession, path: str, x_field: str | None = None, y_field: str | None = None, delimiter: str | None = None, encoding: str | None = None, wgs84: bool = True, infer_types: bool = True,
    wkt_field: str | None = None, on_invalid: str = "skip", max_rows: int | None = None, multi_line: bool = False,
) -> DataFrame:
    """Points, or the geometries of ``wkt_field``, from delimited files; rows without a usable place go, or are refused.

    Without an encoding, files with bytes that aren't UTF-8 count as windows-1256. A column is numeric if every value that is there
    parses and none has a leading zero; that takes one aggregation over the files. Values that
    span lines need ``multi_line``, which makes each file one task's work. Blank rows are no rows.
    """
    if on_invalid not in ("skip", "raise"):
        raise ValueError("on_invalid is skip or raise")
    if max_rows is not None and max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    if delimiter is not None and len(delimiter) != 1:
        raise ValueError("a delimiter is a single character")
    if encoding is None:
        encoding = "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "windows-1256"
    # the reader has no such charsets: bytes are read one to one and their letters put in afterwards
    page = {"windows-1256": "cp1256", "cp1256": "cp1256", "cp1252": "cp1252", "windows-1252": "cp1252"}.get(encoding)
    high = bytes(range(128, 256)).decode("latin-1") if page else ""
    letters = high.encode("latin-1").decode(page, "replace") if page else ""
    if page == "cp1256":
        letters = letters.translate(str.maketrans(ARABIC_LETTERS, PERSIAN_LETTERS))
    raw = spark.read.csv(path, header=True, sep=delimiter or delimiter_of(spark, path), encoding="ISO-8859-1" if high else {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}.get(encoding, encoding), mode="PERMISSIVE", multiLine=multi_line, escape='"')
    clean = [c.lstrip("\ufeff").strip().translate(str.maketrans(high, letters)) for c in raw.columns]
    raw = raw.toDF(*clean)
    if page:
        raw = raw.select(*[F.translate(F.col(f"`{c}`"), high, letters).alias(c) for c in clean])
    key = lambda c: c.strip().lower().replace(" ", "_")
    named = {key(c): c for c in raw.columns}

    def pick(asked: str | None, names: tuple[str, ...], what: str) -> str:
        found = next((named[key(n)] for n in ([asked] if asked else names) if key(n) in named), None)
        if found is None:
            raise ValueError(f"no column {asked or what}")
        return found

    taken = [pick(wkt_field, (), "wkt")] if wkt_field else [pick(x_field, X_NAMES, "x"), pick(y_field, Y_NAMES, "y")]
    blank = F.coalesce(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in raw.columns])) == "", F.lit(True))
    raw = raw.where(~blank)
    if wkt_field:
        out = raw.withColumn("geometry", g.from_wkt(F.col(f"`{taken[0]}`")))
        good = F.col("geometry").isNotNull()
    else:
        out = raw.withColumns({"x": local_number(f"`{taken[0]}`"), "y": local_number(f"`{taken[1]}`")}).withColumn("geometry", g.point(F.col("x"), F.col("y")))
        good = F.col("x").isNotNull() & F.col("y").isNotNull()
        if wgs84:
            good = F.coalesce(good & F.col("x").between(-180, 180) & F.col("y").between(-90, 90), F.lit(False))
    if on_invalid == "raise" and not out.where(~good).isEmpty():
        raise ValueError("there are rows without a usable place")
    out = out.withColumn("_idx", F.monotonically_increasing_id()).where(good)
    rest = [c for c in raw.columns if c not in (*taken, "x", "y", "geometry")]
    trimmed = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`")))
    tests = [F.bool_and(F.when(trimmed(c).isNotNull(), local_number(f"`{c}`").isNotNull() & ~F.trim(F.translate(F.col(f"`{c}`"), LOCAL_DIGITS, LATIN_DIGITS)).rlike("^[+-]?0[0-9]"))).alias(f"t{i}") for i, c in enumerate(rest)]
    numeric = out.agg(*tests).first() if tests and infer_types else [False] * len(rest)
    out = out.withColumns({c: local_number(f"`{c}`") if numeric[i] else trimmed(c) for i, c in enumerate(rest)}) if rest else out
    return out.orderBy("_idx").limit(max_rows) if max_rows is not None else out


def load_csv(path: str, **options) -> DataFrame:
    """``read_csv_points`` of the active session, for query specifications."""
    return read_csv_points(SparkSession.active(), path, **options)


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
READ_ONLY = re.compile(r"^\s*(select|with)\b", re.I)
FORBIDDEN = re.compile(r"(;|--|/\*|\b(insert|update|delete|drop|alter|create|grant|truncate|copy|execute)\b)", re.I)
MOST_ROWS = 100_000


def query_table(spark: SparkSession, table: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """A table of the session's catalog: checked names, a checked condition, and all rows or those of an asked limit (at most 100,000)."""
    for name in [*table.split("."), *(columns or [])]:
        if not NAME.fullmatch(name):
            raise ValueError(f"{name} is not a plain name")
    if limit is not None and not 0 < limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    df = spark.table(table)
    if where:
        if FORBIDDEN.search(where):
            raise ValueError("the condition isn't a plain one")
        df = df.where(where)
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def query_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """A read-only query over the session's views and tables: all rows, or those of an asked limit."""
    if not READ_ONLY.match(sql) or FORBIDDEN.search(sql):
        raise ValueError("only a single select is allowed")
    df = spark.sql(sql)
    return df if limit is None else df.limit(limit)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric column if one is given."""
    if partition_column and bounds:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def dem_tiles(spark: SparkSession, bbox: tuple[float, float, float, float], zoom: int | None = None, max_tiles: int = 64) -> DataFrame:
    """(zoom, x, y) of the web map tiles that cover a box; without a zoom the largest within ``max_tiles``."""
    import math

    def span(z: int) -> tuple[int, int, int, int]:
        n = 1 << z
        column = lambda lon: min(n - 1, max(0, int((lon + 180) / 360 * n)))
        row = lambda lat: min(n - 1, max(0, int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)))
        return column(bbox[0]), column(bbox[2]), row(bbox[3]), row(bbox[1])

    size = lambda z: (span(z)[1] - span(z)[0] + 1) * (span(z)[3] - span(z)[2] + 1)
    z = zoom if zoom is not None else max((z for z in range(16) if size(z) <= max_tiles), default=0)
    x0, x1, y0, y1 = span(z)
    tiles = spark.range(x0, x1 + 1).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))
    return tiles.select(F.lit(z).alias("zoom"), "x", "y")


def filter_scenes(scenes: DataFrame, max_cloud_cover: float | None = None, limit: int = 20) -> DataFrame:
    """Scenes whose cloud cover is low enough or unknown."""
    kept = scenes if max_cloud_cover is None else scenes.where(F.col("cloud_cover").isNull() | (F.col("cloud_cover") <= max_cloud_cover))
    return kept.limit(limit)


def geocode(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Queries (query) with the place (name, x, y) of that name, case and outer spaces aside; first by order (_idx)."""
    key = F.lower(F.trim(F.col("name")))
    places = gazetteer.groupBy(key.alias("__k")).agg(F.min_by(F.struct("name", "x", "y"), "_idx").alias("place"))
    return queries.join(places, F.lower(F.trim(F.col("query"))) == F.col("__k"), "left").select(*queries.columns, "place.*")
