"""All registered queries of the feature, raster and network operators, each with SQL that gives the same rows.

Layers come from the tables: customers and suppliers are points, regions are
vertical strips, nations are squares, orders are pixels, parts are a lattice of
streets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions.numbers import even_round
from .operators import aggregates, attributes, network, overlay, raster, scoring, shapes, spatial
from .plans.spec import Operation, QuerySpec
from .plans.spec import run as run_spec

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is some."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str) -> dict:
    return {"x": F.col(key) * 7919 % 1000 / 10.0, "y": F.col(key) * 104729 % 1000 / 10.0}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumns({"_idx": F.col("c_custkey"), **place("c_custkey")})


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumns({"_idx": F.col("s_suppkey"), **place("s_suppkey")})


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey") * 20.0
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("_idx"), "r_name", g.rectangle(k, F.lit(0.0), k + 20, F.lit(100.0)).alias("geometry"))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("n_nationkey") % 5 * 20.0, F.floor(F.col("n_nationkey") / 5) * 20.0
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("_idx"), "n_name", "n_regionkey", g.rectangle(x, y, x + 20, y + 20).alias("geometry"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, price = F.col("o_orderkey"), F.col("o_totalprice").cast("bigint")
    bands = {"b1": F.when(price % 17 != 0, (price % 256).cast("double")), "b2": (F.col("o_custkey") % 256).cast("double"), "b3": (id_ * 7 % 5).cast("double")}
    return table(spark, sf_dir, "orders").select(F.floor(id_ / 100).alias("row"), (id_ % 100).alias("col"), *[c.alias(n) for n, c in bands.items()])


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a crossing of a lattice 20 wide, with streets to the right and above."""
    n = F.col("p_partkey")
    col, row = n % 20, F.floor(n / 20)
    parts = table(spark, sf_dir, "part").select("p_partkey", col.alias("col"), row.alias("row"), F.col("p_size").alias("size"))
    last = parts.agg(F.max("row").alias("last"))
    ends = F.array(F.when(F.col("col") < 19, F.struct((F.col("col") + 1).alias("c"), F.col("row").alias("r"), F.lit(0).alias("k"))), F.when(F.col("row") < F.col("last"), F.struct(F.col("col").alias("c"), (F.col("row") + 1).alias("r"), F.lit(1).alias("k"))))
    arcs = parts.crossJoin(last).select("p_partkey", "col", "row", "size", F.explode(F.array_compact(ends)).alias("e"))
    return arcs.select((F.col("p_partkey") * 2 + F.col("e.k")).alias("_idx"), "size", g.line(F.array(g.vertex(F.col("col"), F.col("row")), g.vertex(F.col("e.c"), F.col("e.r")))).alias("geometry"))


CUST = "(SELECT c_custkey AS _idx, *, CAST((c_custkey*7919)%1000 AS DOUBLE)/10 AS x, CAST((c_custkey*104729)%1000 AS DOUBLE)/10 AS y FROM customer)"
SUPP = "(SELECT s_suppkey AS _idx, *, CAST((s_suppkey*7919)%1000 AS DOUBLE)/10 AS x, CAST((s_suppkey*104729)%1000 AS DOUBLE)/10 AS y FROM supplier)"
STRIPS = "(SELECT CAST(r_regionkey AS BIGINT) AS _idx, r_name, r_regionkey*20.0 AS x0, 0.0 AS y0, r_regionkey*20.0+20 AS x1, 100.0 AS y1 FROM region)"
SQUARES = "(SELECT CAST(n_nationkey AS BIGINT) AS _idx, n_name, n_regionkey, CAST((n_nationkey%5)*20 AS DOUBLE) AS x0, CAST((n_nationkey//5)*20 AS DOUBLE) AS y0, CAST((n_nationkey%5)*20+20 AS DOUBLE) AS x1, CAST((n_nationkey//5)*20+20 AS DOUBLE) AS y1 FROM nation)"
PIX = "(SELECT o_orderkey//100 AS row, o_orderkey%100 AS col, CASE WHEN CAST(trunc(o_totalprice) AS BIGINT)%17 <> 0 THEN CAST(CAST(trunc(o_totalprice) AS BIGINT)%256 AS DOUBLE) END AS b1, CAST(o_custkey%256 AS DOUBLE) AS b2, CAST((o_orderkey*7)%5 AS DOUBLE) AS b3 FROM orders)"
GAP = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"


# attributes

@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND NOT contains(c_name, '7')")
def filter_attribute(spark, sf_dir):
    where = {"and": [{"c_mktsegment": {"in": ["building", "MACHINERY"]}}, {"field": "c_acctbal", "op": "between", "value": [0, 5000]}, {"not": {"c_name": {"contains": "7"}}}]}
    return attributes.filter_features(customers(spark, sf_dir), where).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_acctbal FROM {CUST} ORDER BY nullif(c_acctbal, 0) DESC NULLS LAST, _idx LIMIT 50 OFFSET 10")
def sort_limit(spark, sf_dir):
    return attributes.filter_features(customers(spark, sf_dir), None, "c_acctbal", True, 50, 10).select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN round_even(l_extendedprice * (1 - l_discount), 6) ELSE floor(l_quantity / 3) END AS v, l_quantity - floor(l_quantity / 7) * 7 AS m, coalesce(l_returnflag IN ('A', 'R'), false) AS f FROM lineitem")
def calculate_field(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    for name, text in {"v": "round(l_extendedprice * (1 - l_discount), 6) if l_quantity > 10 else l_quantity // 3", "m": "l_quantity % 7", "f": "l_returnflag in ['A', 'R']"}.items():
        df = attributes.calculate_field(df, name, text)
    return df.select("l_orderkey", "l_linenumber", F.col("v").cast("double").alias("v"), "m", "f")


@query("SELECT event_id, event_type AS kind, CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS whole, coalesce(nullif(trim(props), ''), 'none') AS props FROM events")
def map_schema(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return attributes.map_schema(df, {"event_type": "kind", "value": "whole"}, {"whole": "int", "props": "str"}, {"props": "none"}, ["ts", "user_id"]).select("event_id", "kind", "whole", "props")


BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"""
WITH a AS (SELECT doc_id, translate(text, 'يىكةۀ0123456789٠١٢٣٤٥٦٧٨٩', 'ییکهه۰۱۲۳۴۵۶۷۸۹۰۱۲۳۴۵۶۷۸۹') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '[\x{{64b}}-\x{{65f}}\x{{670}}\x{{6d6}}-\x{{6ed}}\x{{640}}\x{{200b}}\x{{200d}}-\x{{200f}}\x{{2066}}-\x{{2069}}\x{{feff}}]', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}]+', ' ', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM b)
SELECT doc_id, md5(regexp_replace(t, '{BLANK}*\x{{200c}}{BLANK}*', chr(8204), 'g')) AS h FROM c""")
def normalize_text(spark, sf_dir):
    out = attributes.normalize_persian_text(table(spark, sf_dir, "documents"), ["text"], digits="persian")
    return out.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))


@query("SELECT event_id, 'v1' AS source_tag, coalesce(json_extract_string(props, '$.k'), 'none') AS k, lower(event_type) AS kind FROM events")
def enrich_properties(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("parsed", F.from_json("props", "struct<k:string,z:string>"))
    rules = [{"target": "source_tag", "value": "v1"}, {"target": "k", "first_existing": ["parsed.z", "parsed.k"], "default": "none"}, {"target": "kind", "source": "event_type", "transform": "lower"}]
    return attributes.enrich_properties(df, rules).select("event_id", "source_tag", "k", "kind")


@query("SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN 'very_high' WHEN c_acctbal < 0 THEN 'high' ELSE 'low' END AS flood FROM customer JOIN nation ON c_nationkey = n_nationkey")
def enrich_risk(spark, sf_dir):
    over = customers(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey = 2").select("c_custkey", F.lit("very_high").alias("flood"))
    return attributes.enrich_risk(customers(spark, sf_dir), {"flood": "low"}, [{"where": {"c_acctbal": {"lt": 0}}, "set": {"flood": "high"}}], over, "c_custkey").select("c_custkey", "flood")


@query("SELECT c_custkey, o.o_orderkey AS last_order, o.o_totalprice AS last_price FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def join_properties(spark, sf_dir):
    right = table(spark, sf_dir, "orders").withColumn("_idx", F.col("o_orderkey"))
    return attributes.join_properties(customers(spark, sf_dir), right, "c_custkey", "o_custkey", {"o_orderkey": "last_order", "o_totalprice": "last_price"}).select("c_custkey", "last_order", "last_price")


@query("SELECT l_suppkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def deduplicate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("_idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return attributes.deduplicate(df, ["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag", F.col("_idx").alias("first_line"))


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS nr, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE floor(nr * least(20, n) / n) > floor((nr - 1) * least(20, n) / n)")
def sample_systematic(spark, sf_dir):
    return attributes.sample_features(customers(spark, sf_dir), stratify_by="c_mktsegment", per_stratum=20, method="systematic").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT greatest(1, (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM orders)))")
def sample_random(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("_idx", F.col("o_orderkey"))
    return attributes.sample_features(df, fraction=0.1, stratify_by="o_orderpriority", seed=5).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total, greatest(1, round_even(sum(n) * 0.1, 0)) AS want FROM s), w AS (SELECT p, n, want, n * want / total AS share FROM s, t),
r AS (SELECT p, n, floor(share) AS low, row_number() OVER (ORDER BY share - floor(share) DESC, p) AS place, want - sum(floor(share)) OVER () AS extra FROM w)
SELECT p AS o_orderpriority, CAST(low + (place <= extra)::INT AS BIGINT) AS n, CAST(low + (place <= extra)::INT AS BIGINT) AS unlike FROM r""")
def sample_strata(spark, sf_dir):
    """How many of each stratum a sample takes, and how many of them are orders of the table, each counted once."""
    df = table(spark, sf_dir, "orders").withColumn("_idx", F.col("o_orderkey"))
    taken = attributes.sample_features(df, fraction=0.1, stratify_by="o_orderpriority", seed=5)
    known = taken.select("o_orderpriority", "o_orderkey").join(df.select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], "left_semi")
    return known.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("unlike"))


@query("WITH s AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, value < a - 1.5*(b-a) OR value > b + 1.5*(b-a) AS is_outlier, round_even(greatest(a - 1.5*(b-a) - value, value - (b + 1.5*(b-a)), 0.0), 6) AS outlier_score FROM events JOIN s USING (event_type)")
def outliers_iqr(spark, sf_dir):
    return attributes.detect_outliers(table(spark, sf_dir, "events"), "value", "iqr", group_by="event_type").select("event_id", "is_outlier", "outlier_score")


@query("WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m) SELECT event_id, 0.6745*abs(value-m)/d > 3.5 AS is_outlier, round_even(0.6745*abs(value-m)/d, 6) AS outlier_score FROM events, m, d")
def outliers_modified(spark, sf_dir):
    return attributes.detect_outliers(table(spark, sf_dir, "events"), "value", "modified_zscore").select("event_id", "is_outlier", "outlier_score")


@query("WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, CAST(1 + (c_acctbal > lo + (hi-lo)*1/5)::INT + (c_acctbal > lo + (hi-lo)*2/5)::INT + (c_acctbal > lo + (hi-lo)*3/5)::INT + (c_acctbal > lo + (hi-lo)*4/5)::INT AS INT) AS class FROM customer, r")
def classify_equal(spark, sf_dir):
    return attributes.classify_breaks(customers(spark, sf_dir), "c_acctbal", "equal_interval").select("c_custkey", "class")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders) SELECT o_orderkey, CAST(1 + (o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT AS INT) AS class FROM orders, q")
def classify_quantile(spark, sf_dir):
    return attributes.classify_breaks(table(spark, sf_dir, "orders"), "o_totalprice", "quantile", 4).select("o_orderkey", "class")


@query()
def classify_natural(spark, sf_dir):
    return attributes.classify_breaks(table(spark, sf_dir, "orders"), "o_totalprice", "natural_breaks", 5).select("o_orderkey", "class", "class_label")


# aggregation

@query("SELECT o_orderdate AS x, round_even(sum(o_totalprice), 2) AS y FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def chart_line(spark, sf_dir):
    return aggregates.chart_data(table(spark, sf_dir, "orders"), "line", "o_orderdate", "o_totalprice").select("x", even_round(F.col("y"), 2).alias("y"))


@query("SELECT c_mktsegment AS x, count(*) AS y FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def chart_pie(spark, sf_dir):
    return aggregates.chart_data(customers(spark, sf_dir), "pie", "c_mktsegment")


@query("SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL")
def chart_scatter(spark, sf_dir):
    return aggregates.chart_data(customers(spark, sf_dir), "scatter", "c_acctbal", "c_nationkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round_even(sum(l_quantity), 2) AS qty, round_even(avg(l_discount), 6) AS disc, round_even(median(l_extendedprice), 4) AS med, round_even(stddev_pop(l_tax), 6) AS tax_sd, count(DISTINCT l_suppkey) AS suppliers, arg_min(l_partkey, l_orderkey*10+l_linenumber) AS first_part FROM lineitem GROUP BY 1, 2")
def aggregate_table(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("_idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    asked = [{"op": "count", "as": "n"}, {"field": "l_quantity", "op": "sum", "as": "qty"}, {"field": "l_discount", "op": "mean", "as": "disc"}, {"field": "l_extendedprice", "op": "median", "as": "med"}, {"field": "l_tax", "op": "std", "as": "tax_sd"}, {"field": "l_suppkey", "op": "unique_count", "as": "suppliers"}, {"field": "l_partkey", "op": "first", "as": "first_part"}]
    out = aggregates.aggregate_table(df, asked, ["l_returnflag", "l_linestatus"])
    return out.withColumns({"qty": even_round(F.col("qty"), 2), "disc": even_round(F.col("disc")), "med": even_round(F.col("med"), 4), "tax_sd": even_round(F.col("tax_sd"))})


@query("""
WITH c AS (
  SELECT c_mktsegment AS group_value, 'c_acctbal' AS field, CAST(c_acctbal AS DOUBLE) AS v FROM customer
  UNION ALL SELECT c_mktsegment, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)
SELECT group_value, field, count(*) AS n, count(v) AS non_null_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count, count(v) AS numeric_count,
  round_even(min(v), 6) AS min, round_even(max(v), 6) AS max, round_even(sum(v), 4) AS sum, round_even(avg(v), 6) AS mean, round_even(median(v), 6) AS median, round_even(stddev_samp(v), 6) AS sample_stdev, round_even(stddev_pop(v), 6) AS population_stdev
FROM c GROUP BY 1, 2""")
def attribute_statistics(spark, sf_dir):
    return aggregates.attribute_statistics(customers(spark, sf_dir), ["c_acctbal", "c_nationkey"], "c_mktsegment").drop("top_values").withColumn("sum", even_round(F.col("sum"), 4))


@query("""
WITH k AS (SELECT event_type AS text, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, event_type) AS nr FROM events GROUP BY 1)
SELECT 'event_type' AS field, string_agg(text || '=' || k, ';' ORDER BY nr) AS top_values FROM k WHERE nr <= 10""")
def top_values(spark, sf_dir):
    return aggregates.attribute_statistics(table(spark, sf_dir, "events"), ["event_type"]).select("field", "top_values")


@query("WITH r AS (SELECT min(value) AS lo, (max(value)-min(value))/10 AS w FROM events) SELECT CAST(least(floor((value-lo)/w), 9) AS INT) AS bin, count(*) AS n FROM events, r GROUP BY 1")
def chart_histogram(spark, sf_dir):
    return aggregates.chart_data(table(spark, sf_dir, "events"), "histogram", "value").select("bin", "n")


@query("SELECT o_orderpriority AS x, round_even(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def chart_bar(spark, sf_dir):
    return aggregates.chart_data(table(spark, sf_dir, "orders"), "bar", "o_orderpriority", "o_totalprice").withColumn("y", even_round(F.col("y"), 2))


# ranking and scoring

@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS INT) AS rank FROM customer")
def rank_features(spark, sf_dir):
    return scoring.rank_features(customers(spark, sf_dir), "c_acctbal").select("c_custkey", "rank")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("_idx", F.col("o_orderkey"))
    return scoring.rank_features(df, "o_totalprice", limit=25).select("o_orderkey", "rank")


@query("SELECT p_partkey, round_even(least(greatest(0.0 + greatest(0, least(1, 1 - p_size/50.0)) * (2/3.5::DOUBLE) + (CASE WHEN p_retailprice >= 1200 THEN 1.0 ELSE 0.0 END) * (1/3.5::DOUBLE) + least(greatest(p_size/100.0, 0.0), 1.0) * (0.5/3.5::DOUBLE), 0), 1) * 100, 6) AS score FROM part")
def score_features(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("share", F.col("p_size") / 100.0)
    factors = [{"type": "inverse_distance", "field": "p_size", "max_distance": 50, "weight": 2}, {"type": "threshold", "field": "p_retailprice", "op": ">=", "value": 1200}, {"type": "direct", "field": "share", "weight": 0.5}]
    return scoring.score_features(df, factors).select("p_partkey", "score")


@query("""
WITH n AS (SELECT sqrt(sum(p_size::DOUBLE*p_size)) AS a, sqrt(sum(p_retailprice*p_retailprice)) AS b, min(p_size)::DOUBLE AS a0, max(p_size)::DOUBLE AS a1, min(p_retailprice) AS b0, max(p_retailprice) AS b1 FROM part),
d AS (SELECT p_partkey, sqrt(pow((p_size-a1)/a*0.6,2)+pow((p_retailprice-b0)/b*0.4,2)) AS near, sqrt(pow((p_size-a0)/a*0.6,2)+pow((p_retailprice-b1)/b*0.4,2)) AS far FROM part, n)
SELECT p_partkey, round_even(far/(near+far), 6) AS topsis_score FROM d""")
def topsis(spark, sf_dir):
    criteria = [{"field": "p_size", "weight": 0.6}, {"field": "p_retailprice", "weight": 0.4, "direction": "cost"}]
    return scoring.rank_topsis(table(spark, sf_dir, "part"), criteria).select("p_partkey", "topsis_score")


def properties(spark, sf_dir) -> DataFrame:
    risk = lambda m: F.when(F.col("p_partkey") % m == 0, "high").otherwise("low")
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("distance_to_metro_m"), F.col("p_retailprice").alias("distance_to_mall_m"), (F.col("p_size") * 5).alias("distance_to_main_road_m"), (F.col("p_partkey") % 3 > 0).alias("in_allowed_zone"), risk(4).alias("flood_risk"), risk(5).alias("earthquake_risk"), risk(7).alias("fire_risk"))


PROPERTY_SQL = """
SELECT p_partkey, CAST((CASE WHEN least(p_size*20, p_retailprice) <= 500 THEN 25 ELSE 0 END) + (CASE WHEN p_size*5 <= 150 THEN 20 ELSE 0 END) + (CASE WHEN p_partkey%3 > 0 THEN 25 ELSE 0 END)
  + (CASE WHEN p_partkey%4=0 THEN 0 ELSE 10 END) + (CASE WHEN p_partkey%5=0 THEN 0 ELSE 10 END) + (CASE WHEN p_partkey%7=0 THEN 0 ELSE 10 END) AS DOUBLE) AS investment_score,
  least(p_size*20, p_retailprice) <= 500 AND p_size*5 <= 150 AND p_partkey%3 > 0 AND p_partkey%4 > 0 AND p_partkey%5 > 0 AND p_partkey%7 > 0 AS eligible FROM part"""


@query(PROPERTY_SQL)
def real_estate_score(spark, sf_dir):
    return scoring.score_properties(properties(spark, sf_dir)).select("p_partkey", "investment_score", "eligible")


@query(f"SELECT p_partkey, CAST(row_number() OVER (ORDER BY investment_score DESC, p_partkey) AS INT) AS rank FROM ({PROPERTY_SQL}) WHERE eligible ORDER BY investment_score DESC, p_partkey LIMIT 20")
def real_estate_pipeline(spark, sf_dir):
    steps = (Operation("scored", "real_estate_score", {"vector": "plots"}), Operation("kept", "filter_attribute", {"vector": "scored"}, {"where": {"eligible": True}}), Operation("ranked", "top_n", {"vector": "kept"}, {"score_field": "investment_score", "limit": 20, "order": "p_partkey"}))
    return run_spec(QuerySpec(steps, "ranked"), {"plots": properties(spark, sf_dir)}).select("p_partkey", "rank")


# joins in space

INSIDE = "a.x >= b.x0 AND a.x <= b.x1 AND a.y >= b.y0 AND a.y <= b.y1"


@query(f"SELECT a._idx AS source, b._idx AS target FROM {CUST} a JOIN {SQUARES} b ON {INSIDE}")
def spatial_join_pairs(spark, sf_dir):
    return spatial.point_pairs(customers(spark, sf_dir), squares(spark, sf_dir), 20.0)


@query(f"SELECT a._idx AS c_custkey, min(b._idx) AS zone, count(b._idx) AS _joined_count, arg_min(b.n_name, b._idx) AS zone_name FROM {CUST} a LEFT JOIN {SQUARES} b ON a.x > b.x0 AND a.x < b.x1 AND a.y > b.y0 AND a.y < b.y1 GROUP BY 1")
def spatial_join(spark, sf_dir):
    out = spatial.spatial_join(customers(spark, sf_dir), squares(spark, sf_dir), 20.0, "within", join_type="left")
    return out.select("c_custkey", F.col("_target_index").alias("zone"), "_joined_count", F.col("target_n_name").alias("zone_name"))


@query(f"SELECT a._idx AS source, b._idx AS target FROM {CUST} a JOIN {STRIPS} b ON sqrt(pow(greatest(b.x0-a.x, 0, a.x-b.x1), 2) + pow(greatest(b.y0-a.y, 0, a.y-b.y1), 2)) <= 2.5")
def spatial_join_dwithin(spark, sf_dir):
    return spatial.point_pairs(customers(spark, sf_dir), strips(spark, sf_dir), 10.0, "dwithin", 2.5)


@query(f"SELECT c_custkey FROM {CUST} a WHERE EXISTS (SELECT 1 FROM {STRIPS} b WHERE a.x BETWEEN b.x0+3 AND b.x0+13)")
def filter_points_in_polygon(spark, sf_dir):
    narrow = strips(spark, sf_dir).withColumn("geometry", g.map_vertices(F.col("geometry"), lambda v: g.vertex(F.col("_idx") * 20.0 + 3 + (v["x"] - F.col("_idx") * 20.0) / 2, v["y"])))
    return spatial.filter_points_in_polygon(customers(spark, sf_dir), narrow, 20.0).select("c_custkey")


@query(f"SELECT b._idx, b.n_name, count(a._idx) AS point_count, round_even(sum(a.c_acctbal), 2) AS c_acctbal_sum, round_even(avg(a.c_acctbal), 4) AS c_acctbal_mean, min(a.c_acctbal) AS c_acctbal_min, max(a.c_acctbal) AS c_acctbal_max, round_even(count(a._idx)/400.0::DOUBLE, 6) AS density FROM {SQUARES} b LEFT JOIN {CUST} a ON {INSIDE} GROUP BY 1, 2")
def aggregate_points(spark, sf_dir):
    out = spatial.aggregate_points(customers(spark, sf_dir), squares(spark, sf_dir), 20.0, "c_acctbal", density=True).drop("geometry", "n_regionkey")
    return out.withColumns({"c_acctbal_sum": even_round(F.col("c_acctbal_sum"), 2), "c_acctbal_mean": even_round(F.col("c_acctbal_mean"), 4), "density": even_round(F.col("density"))})


KNN = f"SELECT a._idx AS source, b._idx AS target, {GAP} AS d, row_number() OVER (PARTITION BY a._idx ORDER BY {GAP}, b._idx) AS rank FROM {CUST} a, {SUPP} b"


@query(f"SELECT source, target, round_even(d, 6) AS distance, CAST(rank AS INT) AS rank FROM ({KNN}) WHERE rank <= 3")
def nearest_neighbors(spark, sf_dir):
    return spatial.nearest(customers(spark, sf_dir), suppliers(spark, sf_dir), 3).select("source", "target", even_round(F.col("distance")).alias("distance"), "rank")


@query(f"SELECT source, target, round_even(d, 6) AS distance FROM ({KNN}) WHERE rank = 1 AND d <= 3")
def filter_by_distance(spark, sf_dir):
    out = spatial.nearest_neighbors(customers(spark, sf_dir), suppliers(spark, sf_dir), 1, 3.0, distance_field="distance")
    return out.select(F.col("_idx").alias("source"), F.col("_target_index").alias("target"), "distance")


@query(f"SELECT a._idx AS source, b._idx AS target, round_even({GAP}, 6) AS distance FROM {CUST} a, {SUPP} b")
def distance_matrix(spark, sf_dir):
    return spatial.distances(customers(spark, sf_dir), suppliers(spark, sf_dir), "pairwise")


@query(f"SELECT source, round_even(d, 6) AS length FROM ({KNN}) WHERE rank = 1")
def connection_lines(spark, sf_dir):
    near = spatial.nearest(customers(spark, sf_dir), suppliers(spark, sf_dir), 1)
    to = suppliers(spark, sf_dir).select(F.col("_idx").alias("target"), F.col("x").alias("target_x"), F.col("y").alias("target_y"))
    lines = spatial.connection_lines(near.join(to, "target").join(customers(spark, sf_dir).select(F.col("_idx").alias("source"), "x", "y"), "source"))
    return lines.select("source", even_round(g.length(F.col("geometry"))).alias("length"))


@query(f"""
WITH near AS (SELECT source, d FROM ({KNN}) WHERE rank = 1),
s AS (SELECT source, round_even(least(greatest(0.0 + greatest(0, least(1, 1 - round_even(d, 6)/10.0)) * (3/4.0::DOUBLE) + (CASE WHEN c_acctbal >= 1000 THEN 1.0 ELSE 0.0 END) * (1/4.0::DOUBLE), 0), 1) * 100, 6) AS score FROM near JOIN customer ON c_custkey = source)
SELECT source AS c_custkey, score, CAST(row_number() OVER (ORDER BY score DESC, source) AS INT) AS rank FROM s""")
def accessibility(spark, sf_dir):
    factors = [{"type": "inverse_distance", "field": "metro_m", "max_distance": 10, "weight": 3}, {"type": "threshold", "field": "c_acctbal", "op": ">=", "value": 1000, "weight": 1}]
    steps = (Operation("near", "spatial_nearest", {"source": "sites", "target": "metro"}, {"distance_field": "metro_m"}), Operation("scored", "score_features", {"vector": "near"}, {"factors": factors}), Operation("ranked", "rank_features", {"vector": "scored"}, {}))
    return run_spec(QuerySpec(steps, "ranked"), {"sites": customers(spark, sf_dir), "metro": suppliers(spark, sf_dir)}).select("c_custkey", "score", "rank")


# spatial statistics

BAND = f"SELECT a._idx AS i, b._idx AS j, b.s_acctbal AS v FROM {SUPP} a, {SUPP} b WHERE {GAP} <= 25"


@query(f"""
WITH m AS (SELECT count(*)::DOUBLE AS n, avg(s_acctbal) AS mean, stddev_pop(s_acctbal) AS sd FROM supplier),
w AS (SELECT i, sum(v) AS s, count(*)::DOUBLE AS w FROM ({BAND}) GROUP BY 1)
SELECT i AS _idx, round_even((s - mean*w)/(sd*sqrt((n*w - w*w)/(n-1))), 6) AS gi_z FROM w, m""")
def hotspots(spark, sf_dir):
    return spatial.hotspots(suppliers(spark, sf_dir), "s_acctbal", "distance", distance=25.0).select("_idx", "gi_z")


@query(f"""
WITH p AS (SELECT i, j FROM ({BAND}) WHERE i <> j), d AS (SELECT s_suppkey AS id, s_acctbal - (SELECT avg(s_acctbal) FROM supplier) AS z FROM supplier),
n AS (SELECT count(*)::DOUBLE AS n FROM supplier), s0 AS (SELECT count(*)::DOUBLE AS s0 FROM p), deg AS (SELECT i, count(*)::DOUBLE AS k FROM p GROUP BY 1),
c AS (SELECT sum(a.z*b.z) AS c FROM p JOIN d a ON a.id = i JOIN d b ON b.id = j), m2 AS (SELECT sum(z*z) AS m2 FROM d), s2 AS (SELECT sum(4*k*k) AS s2 FROM deg),
q AS (SELECT n/s0*c/m2 AS v, -1/(n-1) AS e, (n*n*2*s0 - n*s2 + 3*s0*s0)/(s0*s0*(n*n-1)) - (1/(n-1))*(1/(n-1)) AS var, n FROM n, s0, c, m2, s2)
SELECT round_even(v, 6) AS morans_i, round_even(e, 6) AS expected_i, round_even(var, 9) AS variance, round_even((v-e)/sqrt(var), 6) AS z_score, CAST(n AS BIGINT) AS n FROM q""")
def spatial_autocorrelation(spark, sf_dir):
    return spatial.morans_i(suppliers(spark, sf_dir), "s_acctbal", "distance", distance=25.0, row_standardize=False)


@query(f"""
WITH b AS (SELECT min(x)-8::DOUBLE AS west, max(y)+8::DOUBLE AS north, max(x)+8::DOUBLE AS east, min(y)-8::DOUBLE AS south FROM {SUPP}),
c AS (SELECT r.range AS row, k.range AS col, west+(k.range+0.5::DOUBLE)*5 AS cx, north-(r.range+0.5::DOUBLE)*5 AS cy FROM range(100) r, range(100) k, b WHERE r.range < ceil((north-south)/5) AND k.range < ceil((east-west)/5)),
e AS (SELECT row, col, (pow(x-cx,2)+pow(y-cy,2))/64.0::DOUBLE AS d2 FROM c, {SUPP} WHERE (pow(x-cx,2)+pow(y-cy,2))/64.0::DOUBLE <= 1)
SELECT row, col, round_even(sum(3/pi()*pow(1-d2,2)/64.0::DOUBLE), 9) AS density FROM e GROUP BY 1, 2""")
def kernel_density(spark, sf_dir):
    return spatial.kernel_density(suppliers(spark, sf_dir), 5.0, 8.0, kernel="quartic")


@query(f"""
WITH c AS (SELECT r.range AS row, k.range AS col, k.range*10+5.0::DOUBLE AS x, 100-(r.range*10+5.0::DOUBLE) AS y FROM range(10) r, range(10) k),
e AS (SELECT a.row, a.col, b.s_acctbal AS v, {GAP} AS d, row_number() OVER (PARTITION BY a.row, a.col ORDER BY {GAP}, b._idx) AS n FROM c a, {SUPP} b)
SELECT row, col, round_even(coalesce(avg(v) FILTER (WHERE d < 1e-12), sum(v/(d*d)) FILTER (WHERE d >= 1e-12) / sum(1/(d*d)) FILTER (WHERE d >= 1e-12)), 6) AS value FROM e WHERE n <= 6 GROUP BY 1, 2""")
def idw(spark, sf_dir):
    return spatial.interpolate_idw(suppliers(spark, sf_dir), "s_acctbal", 10.0, (0.0, 0.0, 100.0, 100.0), neighbors=6)


@query(f"""
WITH RECURSIVE near AS (SELECT a._idx AS i, b._idx AS j FROM {SUPP} a JOIN {SUPP} b ON a._idx <> b._idx AND sqrt((a.x-b.x)**2+(a.y-b.y)**2) <= 6), core AS (SELECT i FROM near GROUP BY 1 HAVING count(*) >= 2),
reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, n.j FROM reach r JOIN near n ON n.i = r.j JOIN core c ON c.i = n.j), label AS (SELECT i, min(j) AS label FROM reach GROUP BY 1),
border AS (SELECT n.i, min(n.j) AS c FROM near n JOIN core k ON k.i = n.j WHERE n.i NOT IN (SELECT i FROM core) GROUP BY 1), member AS (SELECT i, label FROM label UNION ALL SELECT b.i, l.label FROM border b JOIN label l ON l.i = b.c),
size AS (SELECT label, count(*) AS cluster_size, row_number() OVER (ORDER BY label) - 1 AS k FROM member GROUP BY 1)
SELECT s.s_suppkey, CAST(coalesce(k, -1) AS INT) AS cluster_id, CAST(cluster_size AS DOUBLE) AS cluster_size FROM {SUPP} s LEFT JOIN member m ON m.i = s._idx LEFT JOIN size z USING (label)""")
def cluster_dbscan(spark, sf_dir):
    return spatial.dbscan(suppliers(spark, sf_dir), 6.0, 3).select("s_suppkey", "cluster_id", F.col("cluster_size").cast("double").alias("cluster_size"))


@query()
def cluster_kmeans(spark, sf_dir):
    return spatial.kmeans(customers(spark, sf_dir), 6, seed=3).select("c_custkey", "cluster_id", "distance_to_center")


# shapes

@query(f"SELECT _idx, round_even((x1-x0)*(y1-y0), 6) AS _area, round_even(2*(x1-x0)+2*(y1-y0), 6) AS _perimeter, 0.0::DOUBLE AS _length FROM {SQUARES}")
def area_perimeter(spark, sf_dir):
    return shapes.area_perimeter(squares(spark, sf_dir)).select("_idx", "_area", "_perimeter", "_length")


@query(f"SELECT _idx, round_even((x0+x1)/2, 8) AS cx, round_even((y0+y1)/2, 8) AS cy FROM {SQUARES}")
def centroids(spark, sf_dir):
    return shapes.centroids(squares(spark, sf_dir)).select("_idx", g.x_of(F.col("geometry")).alias("cx"), g.y_of(F.col("geometry")).alias("cy"))


@query(f"SELECT c_nationkey, count(*) AS feature_count, round_even((max(x)-min(x))*(max(y)-min(y)), 6) AS shape_area FROM {CUST} GROUP BY 1")
def envelope(spark, sf_dir):
    df = customers(spark, sf_dir).withColumn("geometry", g.point(F.col("x"), F.col("y")))
    return shapes.envelope(df, ["c_nationkey"]).select("c_nationkey", "feature_count", "shape_area")


@query()
def convex_hull(spark, sf_dir):
    df = customers(spark, sf_dir).withColumn("geometry", g.point(F.col("x"), F.col("y")))
    return shapes.convex_hull(df, "c_nationkey").select("c_nationkey", "feature_count", "shape_area", F.size(g.vertices(F.col("geometry"))).alias("corners"))


@query(f"SELECT _idx, round_even(16*9*sin(2*pi()/32), 6) AS area FROM {SUPP}")
def buffer(spark, sf_dir):
    df = suppliers(spark, sf_dir).withColumn("geometry", g.point(F.col("x"), F.col("y")))
    return shapes.buffer_points(df, 3.0).select("_idx", even_round(g.area(F.col("geometry"))).alias("area"))


@query(f"SELECT _idx, ring_index, round_even(16*(o*o-i*i)*sin(2*pi()/32), 6) AS area FROM {SUPP}, (VALUES (1, 0.0, 2.0), (2, 2.0, 5.0)) r(ring_index, i, o)")
def ring_buffers(spark, sf_dir):
    df = suppliers(spark, sf_dir).withColumn("geometry", g.point(F.col("x"), F.col("y")))
    return shapes.ring_buffers(df, [5.0, 2.0]).select("_idx", "ring_index", even_round(g.area(F.col("geometry"))).alias("area"))


@query(f"SELECT _idx, round_even((x/2)*(pi()*6378137/180), 4) AS mx, round_even(ln(tan((y/2+90)*(pi()/360)))*6378137, 4) AS my FROM {CUST}")
def crs_transform(spark, sf_dir):
    df = customers(spark, sf_dir).withColumn("geometry", g.point(F.col("x") / 2, F.col("y") / 2))
    out = shapes.transform_crs(df, 4326, 3857, 4)
    return out.select("_idx", g.x_of(F.col("geometry")).alias("mx"), g.y_of(F.col("geometry")).alias("my"))


@query(f"SELECT _idx, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' AS wkt FROM {SQUARES}")
def export_wkt(spark, sf_dir):
    from .sources.sinks import table_columns

    return table_columns(squares(spark, sf_dir), "wkt").select("_idx", "wkt")


@query(f"SELECT c_custkey, CAST(floor(x/10) AS BIGINT) AS cx, CAST(floor(y/10) AS BIGINT) AS cy, count(*) OVER (PARTITION BY floor(x/10), floor(y/10)) AS n FROM {CUST}")
def grid_counts(spark, sf_dir):
    df = customers(spark, sf_dir).withColumn("c", spatial.cell_of(F.col("x"), F.col("y"), 10.0))
    counts = df.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return df.join(counts, "c").select("c_custkey", "c.cx", "c.cy", "n")


@query(f"SELECT _idx, round_even((least(x1, 55)-greatest(x0, 10))*(least(y1, 73)-greatest(y0, 15)), 6) AS area FROM {SQUARES} WHERE least(x1, 55) > greatest(x0, 10) AND least(y1, 73) > greatest(y0, 15)")
def clip(spark, sf_dir):
    out = overlay.clip(squares(spark, sf_dir), g.rectangle(F.lit(10.0), F.lit(15.0), F.lit(55.0), F.lit(73.0)))
    return out.select("_idx", even_round(g.area(F.col("geometry"))).alias("area"))


MOVED = f"(SELECT _idx, x0+7 AS x0, x1+7 AS x1, y0, y1 FROM {STRIPS})"


@query(f"SELECT a._idx AS source, b._idx AS target, round_even((least(a.x1, b.x1)-greatest(a.x0, b.x0))*(a.y1-a.y0), 6) AS _intersection_area FROM {SQUARES} a JOIN {MOVED} b ON least(a.x1, b.x1) > greatest(a.x0, b.x0)")
def intersect_pairs(spark, sf_dir):
    moved = strips(spark, sf_dir).withColumn("geometry", g.map_vertices(F.col("geometry"), lambda v: g.vertex(v["x"] + 7, v["y"])))
    return overlay.intersections(squares(spark, sf_dir), moved, 20.0).select("source", "target", "_intersection_area")


@query(f"SELECT a._idx, arg_min(b._idx, -(least(a.x1, b.x1)-greatest(a.x0, b.x0))) AS _target_index FROM {SQUARES} a JOIN {MOVED} b ON least(a.x1, b.x1) > greatest(a.x0, b.x0) GROUP BY 1")
def intersect_filter(spark, sf_dir):
    moved = strips(spark, sf_dir).withColumn("geometry", g.map_vertices(F.col("geometry"), lambda v: g.vertex(v["x"] + 7, v["y"])))
    return overlay.intersect_filter(squares(spark, sf_dir), moved, 20.0).select("_idx", "_target_index")


@query(f"SELECT n_regionkey, count(*) AS _feature_count, round_even(sum((x1-x0)*(y1-y0)), 6) AS area, min(n_name) AS n_name_first FROM {SQUARES} GROUP BY 1")
def dissolve(spark, sf_dir):
    out = overlay.dissolve(squares(spark, sf_dir), ["n_regionkey"], [{"field": "n_name", "op": "first"}], "n_name")
    return out.select("n_regionkey", "_feature_count", even_round(g.area(F.col("geometry"))).alias("area"), "n_name_first")


# rasters

@query(f"SELECT row, col, round_even(CASE WHEN b1+b2 > 1e-12 THEN (b2-b1)/(b2+b1) END, 6) AS value FROM {PIX}")
def ndvi(spark, sf_dir):
    return raster.ndvi(pixels(spark, sf_dir))


@query(f"SELECT row, col, round_even((b2-b1)*1.5/(b2+b1+0.5), 6) AS value FROM {PIX}")
def spectral_savi(spark, sf_dir):
    return raster.spectral_index(pixels(spark, sf_dir), "SAVI", {"nir": "b2", "red": "b1"})


@query(f"SELECT row, col, round_even(CASE WHEN b1 IS NULL THEN NULL WHEN b2 > 100 THEN least(greatest(b1*2-b2, 0), 255) ELSE b1/8 END, 6) AS value FROM {PIX}")
def band_math(spark, sf_dir):
    return raster.band_math(pixels(spark, sf_dir), "clip(b1 * 2 - b2, 0, 255) if b2 > 100 else safe_div(b1, 8)")


@query(f"SELECT row, col, CASE WHEN b1 IS NULL THEN NULL WHEN b1 >= 50 AND b1 <= 120 THEN 1 ELSE 0 END AS value FROM {PIX}")
def raster_threshold(spark, sf_dir):
    return raster.threshold(pixels(spark, sf_dir), "b1", "between", low=50, high=120)


@query(f"SELECT row, col, CASE WHEN b1 IS NULL THEN NULL WHEN b1 = 7 THEN 9.0 WHEN b1 >= 0 AND b1 < 100 THEN 1.0 WHEN b1 IN (100, 150, 200) THEN 2.0 ELSE b1 END AS value FROM {PIX}")
def raster_reclassify(spark, sf_dir):
    return raster.reclassify(pixels(spark, sf_dir), "b1", [{"equals": 7, "new": 9}, {"min": 0, "max": 100, "new": 1}, {"values": [100.0, 150.0, 200.0], "new": 2}], keep_unmatched=True)


@query(f"SELECT row, col, b1 FROM {PIX} WHERE col+0.5 BETWEEN 10 AND 60 AND -(row+0.5) BETWEEN -20 AND -5")
def raster_clip(spark, sf_dir):
    return raster.clip_raster(pixels(spark, sf_dir), (10.0, -20.0, 60.0, -5.0)).select("row", "col", "b1")


@query(f"SELECT row, col, avg(v) AS value FROM (SELECT row, col, b1 AS v FROM {PIX} UNION ALL SELECT row, col+50, b1 FROM {PIX}) WHERE v IS NOT NULL GROUP BY 1, 2")
def raster_mosaic(spark, sf_dir):
    one = pixels(spark, sf_dir)
    return raster.mosaic([one, one.withColumn("col", F.col("col") + 50)], method="mean")


@query(f"SELECT row, col, round_even(CASE WHEN b1 IS NOT NULL THEN ((b1-(SELECT min(b1) FROM {PIX}))/(SELECT max(b1)-min(b1) FROM {PIX})*2 + (1-(b2-(SELECT min(b2) FROM {PIX}))/(SELECT max(b2)-min(b2) FROM {PIX}))*1)/3*100 END, 6) AS value FROM {PIX}")
def weighted_overlay(spark, sf_dir):
    one = pixels(spark, sf_dir)
    return raster.weighted_overlay([one, one.select("row", "col", F.col("b2").alias("b1"))], [2.0, 1.0], ["benefit", "cost"])


NINE = f"""(SELECT a.row, a.col, {', '.join(f"max(CASE WHEN b.row-a.row={r} AND b.col-a.col={c} THEN b.b2 END) AS n{r + 1}{c + 1}" for r in (-1, 0, 1) for c in (-1, 0, 1))}
FROM {PIX} a JOIN {PIX} b ON abs(b.row-a.row) <= 1 AND abs(b.col-a.col) <= 1 GROUP BY 1, 2)"""


@query(f"""
WITH h AS (SELECT row, col, ((n02+2*n12+n22)-(n00+2*n10+n20))/8 AS dx, ((n20+2*n21+n22)-(n00+2*n01+n02))/8 AS dy FROM {NINE}), s AS (SELECT *, sqrt(dx*dx+dy*dy) AS rise, degrees(atan2(-dx, dy)) AS t FROM h)
SELECT row, col, round_even(degrees(atan(rise)), 6) AS slope, round_even(CASE WHEN rise <= 1e-12 THEN -1 WHEN rise IS NOT NULL THEN CASE WHEN t < 0 THEN t+360 ELSE t END END, 6) AS aspect FROM s""")
def slope_aspect(spark, sf_dir):
    return raster.slope_aspect(pixels(spark, sf_dir), "b2")


PAD = ", ".join(f"coalesce(n{r}{c}, n11) AS n{r}{c}" for r in range(3) for c in range(3))


@query(f"""
WITH p AS (SELECT row, col, {PAD} FROM {NINE}), h AS (SELECT row, col, ((n02+2*n12+n22)-(n00+2*n10+n20))/8 AS dx, ((n20+2*n21+n22)-(n00+2*n01+n02))/8 AS dy FROM p),
s AS (SELECT row, col, atan(sqrt(dx*dx+dy*dy)) AS sl, atan2(dy, -dx) AS a FROM h)
SELECT row, col, round_even(greatest(0, least(255, 255*(cos(radians(45))*cos(sl)+sin(radians(45))*sin(sl)*cos(radians(135)-a)))), 6) AS value FROM s""")
def hillshade(spark, sf_dir):
    return raster.hillshade(pixels(spark, sf_dir), band="b2")


@query(f"SELECT a.row, a.col, round_even(avg(b.b1), 6) AS value FROM {PIX} a JOIN {PIX} b ON abs(b.row-a.row) <= 1 AND abs(b.col-a.col) <= 1 GROUP BY 1, 2")
def focal_mean(spark, sf_dir):
    return raster.focal_statistics(pixels(spark, sf_dir), "mean", 1)


@query(f"SELECT a.row, a.col, round_even(max(b.b1)-min(b.b1), 6) AS value FROM {PIX} a JOIN {PIX} b ON abs(b.row-a.row) <= 2 AND abs(b.col-a.col) <= 2 AND pow(b.row-a.row,2)+pow(b.col-a.col,2) <= 4 GROUP BY 1, 2")
def focal_range_circle(spark, sf_dir):
    return raster.focal_statistics(pixels(spark, sf_dir), "range", 2, "circle")


@query(f"SELECT row, col, CASE WHEN b2-b1 > 20 THEN 1.0 WHEN b2-b1 < -20 THEN -1.0 WHEN b1 IS NOT NULL THEN 0.0 END AS value FROM {PIX}")
def raster_change(spark, sf_dir):
    one = pixels(spark, sf_dir)
    return raster.raster_change(one, one.select("row", "col", F.col("b2").alias("b1")), threshold=20.0)


@query(f"SELECT row, col, col+0.5 AS x, -(row+0.5) AS y, b1 AS value FROM {PIX} WHERE b1 >= 40 AND row % 2 = 0 AND col % 2 = 0")
def raster_to_points(spark, sf_dir):
    return raster.raster_to_points(pixels(spark, sf_dir), low=40, step=2)


@query(f"SELECT row, col, b3 AS value, 1.0::DOUBLE AS area FROM {PIX} WHERE b3 IN (1, 2)")
def raster_cells(spark, sf_dir):
    return raster.raster_cells(pixels(spark, sf_dir), "b3", [1.0, 2.0]).select("row", "col", "value", even_round(g.area(F.col("geometry"))).alias("area"))


@query()
def raster_components(spark, sf_dir):
    return raster.raster_components(pixels(spark, sf_dir).withColumn("b4", (F.col("b2") > 90).cast("double")), "b4", [1.0])


@query(f"""
WITH c AS (SELECT 'b1' AS band, b1 AS v FROM {PIX} UNION ALL SELECT 'b3', b3 FROM {PIX}), k AS (SELECT band, v, count(*) AS k FROM c WHERE v IS NOT NULL GROUP BY 1, 2),
m AS (SELECT band, first(v ORDER BY k DESC, v) AS majority, first(v ORDER BY k, v) AS minority FROM k GROUP BY 1)
SELECT band, count(*) AS count, count(v) AS valid_count, count(*)-count(v) AS nodata_count, min(v) AS min, max(v) AS max, sum(v) AS sum, round_even(avg(v), 6) AS mean, round_even(median(v), 6) AS median, round_even(quantile_cont(v, 0.25), 6) AS p25, round_even(quantile_cont(v, 0.75), 6) AS p75,
 round_even(stddev_samp(v), 6) AS sample_stdev, round_even(stddev_pop(v), 6) AS population_stdev, count(DISTINCT v) AS unique_count, any_value(majority) AS majority, any_value(minority) AS minority FROM c JOIN m USING (band) GROUP BY 1""")
def raster_statistics(spark, sf_dir):
    return raster.raster_statistics(pixels(spark, sf_dir), ["b1", "b3"])


@query(f"WITH r AS (SELECT min(b1) AS lo, (max(b1)-min(b1))/8 AS w FROM {PIX}) SELECT CAST(least(floor((b1-lo)/w), 7) AS INT) AS bin, count(*) AS n FROM {PIX}, r WHERE b1 IS NOT NULL GROUP BY 1")
def raster_histogram(spark, sf_dir):
    return raster.histogram(pixels(spark, sf_dir), "b1", 8)


@query(f"""
SELECT b._idx, count(a.row) AS zonal_count, count(a.b1) AS zonal_valid_count, sum(a.b1) AS zonal_sum, round_even(avg(a.b1), 6) AS zonal_mean, min(a.b1) AS zonal_min, max(a.b1) AS zonal_max, round_even(median(a.b1), 6) AS zonal_median
FROM {SQUARES} b LEFT JOIN (SELECT col+0.5 AS x, 100-(row+0.5) AS y, row, b1 FROM {PIX}) a ON {INSIDE} GROUP BY 1""")
def zonal_statistics(spark, sf_dir):
    out = raster.zonal_statistics(pixels(spark, sf_dir), squares(spark, sf_dir), y0=100.0)
    return out.select("_idx", *[f"zonal_{s}" for s in ("count", "valid_count", "sum", "mean", "min", "max", "median")])


@query(f"SELECT a._idx, p.b2 AS raster_value FROM {CUST} a LEFT JOIN {PIX} p ON p.row = CAST(floor(100-a.y) AS BIGINT) AND p.col = CAST(floor(a.x) AS BIGINT)")
def sample_raster(spark, sf_dir):
    return raster.sample_raster(pixels(spark, sf_dir), customers(spark, sf_dir), "b2", y0=100.0).select("_idx", "raster_value")


@query()
def contours(spark, sf_dir):
    out = raster.contours(pixels(spark, sf_dir), [100.0, 200.0], "b2")
    return out.select("level", "row", "col", even_round(g.length(F.col("geometry"))).alias("length"))


# networks

def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their street corner."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", network.node_key(F.struct((n % 20).cast("double").alias("x"), F.floor(n / 20).cast("double").alias("y"))).alias("node"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers at the street corner of the part of their number."""
    at = corners(spark, sf_dir).select(F.col("p_partkey").alias("s_suppkey"), "node")
    return table(spark, sf_dir, "supplier").join(at, "s_suppkey").select(F.col("s_suppkey").cast("string").alias("origin"), "node", F.col("s_acctbal").alias("amount"))


PARTS = "(SELECT p_partkey AS k, p_partkey%20 AS c, p_partkey//20 AS r, p_size, p_retailprice FROM part)"
DEPOTS = "(SELECT s_suppkey AS k, s_suppkey%20 AS c, s_suppkey//20 AS r, s_acctbal FROM supplier JOIN part ON p_partkey = s_suppkey)"
STEPS = "(abs(a.c-b.c)+abs(a.r-b.r))"


@query(f"SELECT CAST(a.k AS VARCHAR) AS origin, CAST(b.k AS BIGINT) AS part, CAST({STEPS} AS DOUBLE) AS cost FROM {DEPOTS} a JOIN {PARTS} b ON {STEPS} <= 8")
def network_distances(spark, sf_dir):
    edges = network.build_edges(streets(spark, sf_dir), node_crossings=False)
    found = network.distances_from(edges, depots(spark, sf_dir).select("origin", "node"), 8.0)
    return corners(spark, sf_dir).join(found, "node").select("origin", F.col("p_partkey").cast("bigint").alias("part"), even_round(F.col("dist")).alias("cost"))


@query(f"SELECT CAST(a.k AS VARCHAR) AS origin, CAST(b.k AS VARCHAR) AS destination, CAST(CASE WHEN {STEPS} <= 12 THEN {STEPS} END AS DOUBLE) AS cost FROM {DEPOTS} a, (SELECT n_nationkey AS k, n_nationkey%20 AS c, n_nationkey//20 AS r FROM nation JOIN part ON p_partkey = n_nationkey) b")
def od_matrix(spark, sf_dir):
    at = corners(spark, sf_dir).select(F.col("p_partkey").alias("n_nationkey"), "node")
    ends = table(spark, sf_dir, "nation").join(at, "n_nationkey").select(F.col("n_nationkey").cast("string").alias("destination"), "node")
    return network.od_matrix(network.build_edges(streets(spark, sf_dir), node_crossings=False), depots(spark, sf_dir).select("origin", "node"), ends, 12.0)


@query(f"""
WITH e AS (SELECT p_partkey*2 AS edge_id, p_partkey%20 AS c, p_partkey//20 AS r, p_partkey%20+1 AS c2, p_partkey//20 AS r2 FROM part WHERE p_partkey%20 < 19
  UNION ALL SELECT p_partkey*2+1, p_partkey%20, p_partkey//20, p_partkey%20, p_partkey//20+1 FROM part WHERE p_partkey//20 < (SELECT max(p_partkey//20) FROM part)),
s AS (SELECT CAST(a.k AS VARCHAR) AS origin, b.band, e.edge_id, greatest(0, least(1, b.band-abs(a.c-e.c)-abs(a.r-e.r))) + greatest(0, least(1, b.band-abs(a.c-e.c2)-abs(a.r-e.r2))) AS share FROM {DEPOTS} a, e, (VALUES (2.0::DOUBLE), (4.5::DOUBLE)) b(band))
SELECT origin, band, CAST(edge_id AS BIGINT) AS edge_id, round_even(least(1, share), 6) AS share FROM s WHERE share > 0""")
def service_area(spark, sf_dir):
    return network.service_area(network.build_edges(streets(spark, sf_dir), node_crossings=False), depots(spark, sf_dir).select("origin", "node"), [2.0, 4.5]).select("origin", "band", "edge_id", "share")


@query(f"""
WITH p AS (SELECT a.k AS s, b.k AS d, a.s_acctbal AS sa, b.p_retailprice AS da FROM {DEPOTS} a, {PARTS} b WHERE {STEPS} <= 6), l AS (SELECT s, any_value(sa)/sum(da) AS ratio FROM p GROUP BY 1)
SELECT b.k AS demand, round_even(coalesce(sum(ratio), 0)*1000, 6) AS accessibility, count(ratio) AS facilities_in_reach FROM {PARTS} b LEFT JOIN p ON p.d = b.k LEFT JOIN l USING (s) GROUP BY 1""")
def accessibility_2sfca(spark, sf_dir):
    demand = corners(spark, sf_dir).select(F.col("p_partkey").alias("demand"), "node", F.col("p_retailprice").alias("amount"))
    return network.accessibility_2sfca(network.build_edges(streets(spark, sf_dir), node_crossings=False), depots(spark, sf_dir), demand, 6.0)


from . import catalog_shapes  # noqa: E402, F401  its queries register themselves here
