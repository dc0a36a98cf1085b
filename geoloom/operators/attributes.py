"""Operators on the attributes of a feature layer.

A layer is a DataFrame. Where an operator depends on row order it takes the
name of the column that carries it (``order``), and every tie ends there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expression import compile_expression
from ..functions.numbers import even_round, is_text, local
from ..functions.predicate import condition, path

LIMIT = 10_000


def filter_features(df: DataFrame, where: dict | None = None, sort_by: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0, case_sensitive: bool = False, order: str = "_idx") -> DataFrame:
    """Rows that meet the condition; sorted with nulls last in both directions, then offset and limit."""
    if limit is not None and not 0 <= limit <= LIMIT:
        raise ValueError(f"limit must be from 0 to {LIMIT}")
    out = df.where(condition(df, where, case_sensitive)) if where else df
    if sort_by:
        key = path(df, sort_by)
        out = out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(order))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def calculate_field(df: DataFrame, field: str, expression: str, overwrite: bool = True) -> DataFrame:
    """Adds a field that an expression gives; what can't be calculated is null."""
    if field in df.columns and not overwrite:
        raise ValueError(f"{field} exists")
    return df.withColumn(field, compile_expression(expression, {c: F.col(f"`{c}`") for c in df.columns}))


#: Words of truth and falsehood.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1", "t", "بله", "آری", "درست"), ("false", "no", "n", "0", "f", "خیر", "نه", "نادرست")


def _cast(df: DataFrame, name: str, kind: str) -> Column:
    column = F.col(name)
    if is_text(df, name):
        column = F.when(F.trim(column) != "", F.trim(column))
    if kind == "float":
        return column.try_cast("double")
    if kind == "int":
        number = column.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    if kind == "bool":
        word = F.lower(column.cast("string"))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return column.cast("string")


def map_schema(df: DataFrame, mapping: dict | None = None, cast: dict | None = None, defaults: dict | None = None, drop: list | None = None, keep_only: list | None = None) -> DataFrame:
    """Renames, casts, fills nulls, drops and selects, in this order."""
    for old, new in (mapping or {}).items():
        if new in df.columns and new != old:
            raise ValueError(f"{new} exists")
    out = df.withColumnsRenamed(mapping or {})
    out = out.withColumns({c: _cast(out, c, kind) for c, kind in (cast or {}).items() if c in out.columns})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v) for c, v in (defaults or {}).items()})
    out = out.drop(*(drop or []))
    return out.select([c for c in out.columns if c in keep_only]) if keep_only else out


#: Arabic letters and their Persian forms; diacritics, invisible characters, spaces of a line.
ARABIC, PERSIAN = "يىكةۀ", "ییکهه"
DIACRITICS, INVISIBLE, JOINER = "[\u064b-\u065f\u0670\u06d6-\u06ed\u0640]", "[\u200b\u200d\u200e\u200f\u2066-\u2069\ufeff]", "\u200c"
SPACES = "[ \t\u00a0\u2000-\u200a\u202f]"
#: All white space, with line ends.
BLANK = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PERSIAN_DIGITS, ARABIC_DIGITS, LATIN = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"


def normalize_persian_text(df: DataFrame, fields: list[str] | None = None, digits: str = "keep", arabic_to_persian: bool = True, remove_diacritics: bool = True, clean_spaces: bool = True, remove_zero_width: bool = True, suffix: str = "") -> DataFrame:
    """Unifies letters, digits and spaces of text columns; with a suffix into new columns. Line ends inside a text stay."""
    out = {}
    for name in fields or [c for c in df.columns if is_text(df, c)]:
        text = F.col(name)
        if arabic_to_persian:
            text = F.translate(text, ARABIC, PERSIAN)
        if digits == "persian":
            text = F.translate(text, ARABIC_DIGITS + LATIN, PERSIAN_DIGITS * 2)
        elif digits == "english":
            text = F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, LATIN * 2)
        if remove_diacritics:
            text = F.regexp_replace(text, DIACRITICS, "")
        if remove_zero_width:
            text = F.regexp_replace(text, INVISIBLE, "")
        if clean_spaces:
            # runs are matched from their start only, which keeps the cost linear
            text = F.regexp_replace(F.regexp_replace(text, f"{SPACES}+", " "), rf"^{BLANK}+|(?<!{BLANK}){BLANK}++\z", "")
            text = F.regexp_replace(text, f"(?<!{BLANK}){BLANK}++{JOINER}{BLANK}*+|{JOINER}{BLANK}*+", JOINER)
        out[name + suffix] = text
    return df.withColumns(out)


def enrich_properties(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Sets targets rule by rule from a value, a path, the first path that has one, or a default."""
    transforms = {"float": lambda c: c.try_cast("double"), "int": lambda c: c.try_cast("double").try_cast("bigint"), "str": lambda c: c.cast("string"), "bool": lambda c: c.try_cast("boolean"), "lower": F.lower, "upper": F.upper}
    for rule in rules:
        if "value" in rule:
            value = F.lit(rule["value"])
        else:
            found = [c for p in rule.get("first_existing", [rule.get("source", "")]) if (c := path(df, p)) is not None]
            value = F.coalesce(*found) if found else F.lit(None)
            if "default" in rule:
                value = F.coalesce(value, F.lit(rule["default"]))
        target, _, inner = rule["target"].partition(".")
        value = transforms[rule["transform"]](value) if rule.get("transform") else value
        df = df.withColumn(target, F.col(target).withField(inner, value) if inner else value)
    return df


LEVELS = ("very_low", "low", "medium", "high", "very_high")


def risk_level(value: Column) -> Column:
    """A level from its name or, below .2, .4, .6 and .8, from a number."""
    word = F.regexp_replace(F.lower(F.trim(value.cast("string"))), "[ -]+", "_")
    number = word.try_cast("double")
    by_number = F.when(number < 0.2, LEVELS[0]).when(number < 0.4, LEVELS[1]).when(number < 0.6, LEVELS[2]).when(number < 0.8, LEVELS[3]).when(number.isNotNull(), LEVELS[4])
    return F.when(word.isin(*LEVELS), word).when(word == "moderate", "medium").otherwise(by_number)


def enrich_risk(df: DataFrame, default_risks: dict[str, str] | None = None, rules: list[dict] | None = None, overrides: DataFrame | None = None, id_field: str = "id", overwrite: bool = False) -> DataFrame:
    """Default levels, then rules ({where, set}), then a table of (id, risk columns) that always wins."""
    for name, level in (default_risks or {}).items():
        df = df.withColumn(name, F.lit(level) if overwrite or name not in df.columns else F.coalesce(F.col(name), F.lit(level)))
    for rule in rules or []:
        hit = condition(df, rule["where"])
        df = df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in rule["set"].items()})
    if overrides is not None:
        names = [c for c in overrides.columns if c != id_field]
        other = overrides.select(F.col(id_field).cast("string").alias("__id"), *[F.col(c).alias(f"__{c}") for c in names])
        joined = df.join(other, df[id_field].cast("string") == other["__id"], "left")
        df = joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c) if c in df.columns else F.lit(None)) for c in names}).drop("__id", *[f"__{c}" for c in names])
    return df


def join_properties(left: DataFrame, right: DataFrame, left_key: str, right_key: str, fields: list[str] | dict[str, str] | None = None, prefix: str = "", overwrite: bool = False, unmatched: str = "keep", order: str = "_idx") -> DataFrame:
    """Equi join on keys as text; of equal right keys the last row counts, so rows never fan out."""
    names = fields if isinstance(fields, dict) else {c: prefix + c for c in (fields or [c for c in right.columns if c not in (right_key, order)])}
    packed = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).cast("string").alias("__key")).agg(F.max_by(F.struct(*names), F.col(order)).alias("__right"))
    joined = left.join(packed, left[left_key].cast("string") == F.col("__key"), "inner" if unmatched == "drop" else "left")
    out = {}
    for old, new in names.items():
        value = F.col("__right").getField(old)
        out[new] = (F.when(F.col("__key").isNotNull(), value).otherwise(F.col(new)) if overwrite else F.coalesce(F.col(new), value)) if new in left.columns else value
    return joined.withColumns(out).drop("__key", "__right")


def deduplicate(df: DataFrame, fields: list[str] | None = None, keep: str = "first", mark_only: bool = False, order: str = "_idx") -> DataFrame:
    """One row of each key, the first or last in order; or all, with is_duplicate."""
    keys = fields or [c for c in df.columns if c != order]
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    if mark_only:
        return numbered.withColumn("is_duplicate", F.col("__n") > 1).drop("__n")
    return numbered.where("__n = 1").drop("__n")


def sample_features(df: DataFrame, size: int | None = None, fraction: float | None = None, stratify_by: str | None = None, per_stratum: int | None = None, method: str = "random", seed: int = 0, order: str = "_idx") -> DataFrame:
    """A random or systematic sample; strata get shares by largest remainder, or a fixed number each.

    Rows are ranked in their stratum by a draw, or by order. The ranks are counted
    range by range: within a range by a window, before it by the ranges' counts, so a
    stratum of any size is dealt over many tasks.
    """
    strata = F.col(stratify_by) if stratify_by else F.lit(1)
    counts = df.groupBy(strata.alias("__s")).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy()
    total = F.sum("__n").over(whole)
    if per_stratum is not None:
        quotas = counts.withColumn("__q", F.least(F.lit(per_stratum), F.col("__n")))
    else:
        wanted = F.lit(size) if size is not None else F.greatest(F.lit(1), F.bround(total * fraction).cast("bigint"))
        exact = F.least(wanted, total) * F.col("__n") / total
        part = counts.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact")).withColumn("__want", F.least(wanted, total))
        rank = F.row_number().over(Window.partitionBy().orderBy((F.col("__exact") - F.col("__floor")).desc(), "__s"))
        extra = F.col("__want") - F.sum("__floor").over(whole)
        quotas = part.withColumn("__q", F.col("__floor") + F.when(rank <= extra, 1).otherwise(0))
    draw = F.xxhash64(F.lit(seed), F.col(order)) if method == "random" else F.col(order)
    joined = df.withColumn("__s", strata).join(quotas.select(F.col("__s").alias("__k"), "__q", "__n"), F.col("__s").eqNullSafe(F.col("__k")))
    from .storage import durable

    ranged = durable(joined.withColumn("__d", draw).repartitionByRange("__s", "__d", order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col("__s").alias("__k"), F.col("__p").alias("__kp")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("__k").orderBy("__kp").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__size")
    joined = ranged.drop("__k").join(starts, F.col("__s").eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__kp")))
    at = F.row_number().over(Window.partitionBy("__s", "__p").orderBy("__d", order)) + F.col("__before")
    if method == "systematic":
        chosen = F.floor(at * F.col("__q") / F.col("__n")) > F.floor((at - 1) * F.col("__q") / F.col("__n"))
    else:
        chosen = at <= F.col("__q")
    return joined.withColumn("__take", chosen).where("__take").drop("__s", "__k", "__q", "__n", "__take", "__d", "__p", "__kp", "__before")


def detect_outliers(df: DataFrame, field: str, method: str = "iqr", threshold: float | None = None, group_by: str | None = None) -> DataFrame:
    """is_outlier and outlier_score by fences, z-score or modified z-score; unscored rows have nulls."""
    value, group = local(df, field), F.col(group_by) if group_by else F.lit(1)
    base = df.withColumn("__v", value).withColumn("__g", group)
    limit = F.lit(threshold if threshold is not None else {"iqr": 1.5, "zscore": 3.0, "modified_zscore": 3.5}[method])
    stats = base.groupBy(F.col("__g").alias("__k")).agg(F.percentile("__v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__sd"))
    joined = base.join(stats, F.col("__g").eqNullSafe(F.col("__k")))
    v, q = F.col("__v"), F.col("__q")
    if method == "iqr":
        low, high = q[0] - limit * (q[2] - q[0]), q[2] + limit * (q[2] - q[0])
        score = F.greatest(low - v, v - high, F.lit(0.0))
        flag = (v < low) | (v > high)
    elif method == "zscore":
        score = F.when(F.col("__sd") > 0, F.abs(v - F.col("__m")) / F.col("__sd")).otherwise(0.0)
        flag = score > limit
    else:
        spread = joined.groupBy(F.col("__g").alias("__k2")).agg(F.percentile(F.abs(v - q[1]), 0.5).alias("__mad"))
        joined = joined.join(spread, F.col("__g").eqNullSafe(F.col("__k2"))).drop("__k2")
        off = F.abs(v - q[1])
        score = F.when(F.col("__mad") > 0, 0.6745 * off / F.col("__mad")).otherwise(F.when(off == 0, 0.0).otherwise(1e12))
        flag = score > limit
    known = v.isNotNull()
    out = joined.withColumn("is_outlier", F.when(known, flag)).withColumn("outlier_score", F.when(known, even_round(score)))
    return out.drop("__v", "__g", "__k", "__q", "__m", "__sd", "__mad")


def jenks(values: list[float], classes: int) -> list[float]:
    """Upper limits of natural breaks, by dynamic programming over sorted values."""
    n, k = len(values), min(classes, len(set(values)))
    sums, squares = [0.0], [0.0]
    for v in values:
        sums.append(sums[-1] + v)
        squares.append(squares[-1] + v * v)
    cost = lambda i, j: squares[j] - squares[i] - (sums[j] - sums[i]) ** 2 / (j - i)
    best, cuts = [0.0] + [cost(0, j) for j in range(1, n + 1)], []
    for _ in range(1, k):
        row, cut = [float("inf")] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            row[j], cut[j] = min(((best[i] + cost(i, j), i) for i in range(1, j)), default=(float("inf"), 0))
        best = row
        cuts.append(cut)
    limits, j = [values[-1]], n
    for cut in reversed(cuts):
        j = cut[j]
        limits.append(values[j - 1])
    return limits[::-1]


def quantiles(df: DataFrame, value: Column, fractions: list[float]) -> list[float]:
    """The values at fractions of all rows in order, in proportion between two rows, as ``percentile`` has them.

    Distinct values are counted and sorted in ranges; only the rows that are asked for come to the driver.
    """
    import numpy as np
    import pyarrow as pa

    from .storage import durable

    counted = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = durable(counted.repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id()))
    starts, total = {}, 0
    for r in sorted(ranged.groupBy("p").agg(F.sum("n").alias("n")).collect()):
        starts[r.p] = total
        total += r.n
    places = [(total - 1) * f for f in fractions]
    asked = np.unique(np.array([[math.floor(x), math.ceil(x)] for x in places], np.int64))

    def pick(batches):
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            at = starts[b["p"][0].as_py()] if at is None else at
            ends = at + np.cumsum(b["n"].to_numpy())
            ranks = asked[(asked >= at) & (asked < ends[-1])]
            yield pa.RecordBatch.from_arrays([pa.array(ranks), b["v"].take(pa.array(np.searchsorted(ends, ranks, "right")))], ["rank", "v"])
            at = int(ends[-1])

    found = {r.rank: r.v for r in ranged.mapInArrow(pick, "rank bigint, v double").collect()}
    between = lambda x, low, high: found[low] if low == high or found[low] == found[high] else (high - x) * found[low] + (x - low) * found[high]
    return [between(x, math.floor(x), math.ceil(x)) for x in places]


def classify_breaks(df: DataFrame, field: str, method: str = "natural_breaks", classes: int = 5, breaks: list[float] | None = None, sample: int = 1000, order: str = "_idx") -> DataFrame:
    """A class from 1, right-closed, and its label. Breaks are a few numbers that aggregates give.

    Natural breaks are fitted to at most ``sample`` values, the quantiles at
    equal steps; every row is classified.
    """
    value = local(df, field)
    stats = df.agg(F.min(value), F.max(value), F.avg(value), F.stddev_pop(value), F.count(value)).first()
    low, high, mean, sd, n = stats
    if not n:
        return df.withColumns({"class": F.lit(None).cast("int"), "class_label": F.lit(None).cast("string")})
    if method == "manual":
        edges = sorted(breaks or [])
    elif method == "equal_interval":
        edges = [low + (high - low) * i / classes for i in range(classes + 1)]
    elif method == "std_dev":
        edges = [low, *[x for x in (mean + sd * i for i in (-2, -1, 0, 1, 2)) if low < x < high], high]
    else:
        steps = classes if method == "quantile" else min(sample, n) - 1 or 1
        points = quantiles(df, value, [i / steps for i in range(steps + 1)])
        edges = points if method == "quantile" else [low, *jenks(sorted(points), classes)]
    edges = sorted(set(edges))
    edges = edges if len(edges) > 1 else edges * 2
    uppers = edges[1:]
    number = sum((F.when(value > F.lit(u), 1).otherwise(0) for u in uppers), F.lit(1))
    inside = value.between(F.lit(edges[0]), F.lit(edges[-1]))
    label = F.element_at(F.array(*[F.lit(f"{a:.6g} – {b:.6g}") for a, b in zip(edges, uppers, strict=False)]), number)
    return df.withColumn("class", F.when(inside, number)).withColumn("class_label", F.when(inside, label))


def number_rows(df: DataFrame, *keys: str, name: str = "_idx") -> DataFrame:
    """Numbers rows from 0 by unique keys, partition by partition, without one task for all.

    Rows are range-partitioned by the keys; each partition's count is added up
    on the driver (one number a partition), and rows count on from there.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id())
    from .storage import durable

    ranged = durable(ranged)
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return ranged.withColumn(name, (offsets[F.col("__p")] + within).cast("bigint")).drop("__p")


