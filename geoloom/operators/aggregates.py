"""Grouped aggregates, attribute profiles, charts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import even_round, loose, strict

OPERATIONS = ("count", "non_null_count", "sum", "mean", "median", "min", "max", "std", "first", "last", "unique_count")


def aggregate_of(df: DataFrame, op: str, field: str | None, order: str) -> Column:
    """One aggregate; numeric ones read numbers from text too, std is of the population."""
    if op == "count":
        return F.count(F.lit(1))
    if op in ("first", "last"):
        return (F.min_by if op == "first" else F.max_by)(F.col(field), F.col(order))
    if op == "non_null_count":
        return F.count(F.col(field))
    if op == "unique_count":
        return F.count_distinct(F.col(field))
    number = loose(df, field)
    return {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_pop}[op](number)


def aggregate_table(df: DataFrame, aggregations: list[dict], group_by: list[str] | None = None, sort_by: str | None = None, descending: bool = True, limit: int | None = None, order: str = "_idx") -> DataFrame:
    """``aggregations`` are {field, op, as}; null groups stay, an empty layer gives no row; nulls sort last."""
    names = [a.get("as") or (a["op"] if a["op"] == "count" and not a.get("field") else f"{a['field']}_{a['op']}") for a in aggregations]
    made = [aggregate_of(df, a["op"], a.get("field"), order).alias(n) for a, n in zip(aggregations, names, strict=True)]
    out = df.groupBy(*(group_by or [])).agg(*made, F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first") if order in df.columns else F.lit(0).alias("__first"))
    out = out.where("__n > 0")
    if sort_by:
        key = F.col(sort_by)
        out = out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "__first")
    out = out.drop("__n", "__first")
    return out if limit is None else out.limit(limit)


def attribute_statistics(df: DataFrame, fields: list[str], group_by: str | None = None, max_top_values: int = 10, precision: int = 6) -> DataFrame:
    """One row for each group and field: counts, moments and most frequent values.

    Fields are unpivoted, so all of them share one aggregation; top values come
    from counts, never from a collected group.
    """
    group = F.col(group_by).cast("string") if group_by else F.lit(None).cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text"), strict(df, f).alias("number")) for f in fields]))
    long = df.select(group.alias("group_value"), cells.alias("c")).select("group_value", "c.*")
    r = lambda c: even_round(c, precision)
    stats = long.groupBy("group_value", "field").agg(
        F.count(F.lit(1)).alias("n"), F.count("text").alias("non_null_count"), (F.count(F.lit(1)) - F.count("text")).alias("null_count"),
        (F.count_distinct("text") + F.max(F.col("text").isNull().cast("int"))).alias("unique_count"), F.count("number").alias("numeric_count"),
        r(F.min("number")).alias("min"), r(F.max("number")).alias("max"), r(F.sum("number")).alias("sum"), r(F.avg("number")).alias("mean"), r(F.median("number")).alias("median"),
        r(F.when(F.count("number") > 1, F.stddev_samp("number"))).alias("sample_stdev"), r(F.stddev_pop("number")).alias("population_stdev"),
    )
    counts = long.groupBy("group_value", "field", "text").agg(F.count(F.lit(1)).alias("k"))
    place = F.row_number().over(Window.partitionBy("group_value", "field").orderBy(F.col("k").desc(), F.col("text").asc_nulls_first()))
    top = counts.withColumn("at", place).where(F.col("at") <= max_top_values).groupBy("group_value", "field")
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text", "k"))), lambda t: F.concat(F.coalesce(t["text"], F.lit("null")), F.lit("="), t["k"].cast("string"))), ";").alias("top_values"))
    same = stats["group_value"].eqNullSafe(top["group_value"]) & (stats["field"] == top["field"])
    return stats.join(top, same).select(stats["*"], top["top_values"])


def chart_data(df: DataFrame, kind: str, x: str, y: str | None = None, aggregate: str = "sum", top_n: int | None = None, bins: int = 10) -> DataFrame:
    """The rows behind a bar, line, pie, scatter or histogram chart."""
    if kind == "histogram":
        value = loose(df, x)
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is None:
            return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n bigint")
        width = (high - low) / bins or 1.0
        place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        return df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_end"), "n")
    if kind == "scatter":
        return df.select(loose(df, x).alias("x"), loose(df, y).alias("y")).where("x is not null and y is not null")
    made = aggregate_of(df, aggregate if y else "count", y, x)
    out = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(made.alias("y"))
    if kind in ("bar", "pie"):
        out = out.orderBy(F.col("y").desc_nulls_last(), "x")
    else:
        out = out.orderBy("x")
    return out.limit(top_n) if top_n else out


def report(df: DataFrame, score_field: str = "score", name_field: str = "name", rows: int = 50, order: str = "_idx") -> dict:
    """Summary numbers and the best rows, as a dict: two aggregates and one bounded sort."""
    score = loose(df, score_field)
    total, top, low, mean, median = df.agg(F.count(F.lit(1)), F.max(score), F.min(score), F.avg(score), F.median(score)).first()
    best = df.orderBy(score.desc_nulls_last(), order).limit(min(rows, 50))
    table = [r.asDict(recursive=True) for r in best.collect()]
    rounded = lambda x: None if x is None else round(x, 2)
    return {"summary": {"total": total, "top_score": rounded(top), "min_score": rounded(low), "avg_score": rounded(mean), "median_score": rounded(median), "top_name": table[0].get(name_field) if table else None}, "rows": table}
