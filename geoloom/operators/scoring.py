"""Ranking and multi-criteria scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import even_round, is_text, local, loose
from .attributes import LEVELS, risk_level


def rank_features(df: DataFrame, score_field: str = "score", rank_field: str = "rank", descending: bool = True, limit: int | None = None, order: str = "_idx") -> DataFrame:
    """Numbers rows from 1 by score, nulls last either way, ties by order.

    With a limit only that many rows are sorted to the end; without one, rows
    are range-partitioned by score and each partition counts on from the ones
    before it, so no task holds them all.
    """
    score = loose(df, score_field)
    if limit is not None:
        by = [score.desc_nulls_last() if descending else score.asc_nulls_last(), F.col(order)]
        return df.orderBy(*by).limit(limit).withColumn(rank_field, F.row_number().over(Window.orderBy(*by)))
    from .attributes import number_rows

    keyed = df.withColumn("__none", score.isNull()).withColumn("__score", F.when(score.isNotNull(), -score if descending else score))
    numbered = number_rows(keyed, "__none", "__score", order, name=rank_field)
    return numbered.withColumn(rank_field, (F.col(rank_field) + 1).cast("int")).drop("__none", "__score")


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


#: Words that count as true.
TRUTHS = ("true", "yes", "y", "1", "ok", "pass", "passed", "inside", "within", "low", "مجاز", "داخل", "بله")
ALIASES = {"eq": "==", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
COMPARISONS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def truth(df: DataFrame, field: str) -> Column:
    """Words of truth, and numbers other than zero; null is false."""
    column = F.col(field)
    true = F.lower(F.trim(column)).isin(*TRUTHS) if is_text(df, field) else column.cast("double") != 0
    return F.coalesce(true, F.lit(False))


def compared(df: DataFrame, field: str, op: str, value: object) -> Column:
    """Equality is of the values as they are, text never equal to a number; order is of numbers, and false without two."""
    op = ALIASES.get(op, op)
    if op in ("==", "!="):
        text, plain = is_text(df, field), F.col(field)
        if value is not None and isinstance(value, str) != text:
            same: Column = F.lit(False)
        else:
            same = plain.eqNullSafe(F.lit(value)) if text or value is None else plain.cast("double").eqNullSafe(F.lit(float(value)))
        return same if op == "==" else ~same
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op}")
    return F.coalesce(COMPARISONS[op](loose(df, field), F.lit(value).try_cast("double")), F.lit(False))


def factor_score(df: DataFrame, factor: dict) -> Column:
    """The 0 to 1 score of a factor by its type; a factor without one is an error."""
    kind, field = factor["type"], factor["field"]
    number = loose(df, field)
    if kind in ("boolean", "boolean_bonus"):
        return F.when(truth(df, field), 1.0).otherwise(0.0)
    if kind == "inverse_distance":
        return F.coalesce(clamp(1 - number / F.lit(float(factor["max_distance"]))), F.lit(0.0))
    if kind in ("risk_level", "inverse_level"):
        level = risk_level(F.col(field))
        table = F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, 1 - i / 4)])
        return F.coalesce(F.when(number.isNotNull(), clamp(1 - number)).otherwise(table[level]), F.lit(0.0))
    if kind in ("threshold", "condition"):
        return F.when(compared(df, field, factor.get("op", ">="), factor["value"]), 1.0).otherwise(0.0)
    if kind in ("direct", "numeric"):
        return clamp(F.coalesce(number, F.lit(0.0)))
    if kind == "inverse_numeric":
        return clamp(1 - F.coalesce(number, F.lit(1.0)))
    raise ValueError(f"unknown factor type {kind}")


def score_features(df: DataFrame, factors: list[dict], output_field: str = "score", scale: float = 100.0, normalize_weights: bool = True, details: bool = False) -> DataFrame:
    """Weighted sum of factor scores, clamped to 0 to 1, times the scale, to six places."""
    weights = [float(f.get("weight", 1.0)) for f in factors]
    whole = sum(w for w in weights if w > 0) if normalize_weights else 1.0
    total = sum((factor_score(df, f) * F.lit(w / (whole or 1.0)) for f, w in zip(factors, weights, strict=True)), F.lit(0.0))
    out = df.withColumn(output_field, even_round(clamp(total) * F.lit(float(scale or 100.0))))
    if details:
        rows = [F.struct(F.lit(f["field"]).alias("field"), F.lit(w).alias("weight"), factor_score(df, f).alias("score")) for f, w in zip(factors, weights, strict=True)]
        out = out.withColumn("__score_details__", F.array(*rows))
    return out


def rank_topsis(df: DataFrame, criteria: list[dict], score_field: str = "topsis_score", rank_field: str = "topsis_rank") -> DataFrame:
    """Closeness to the ideal over vector-normalised, weighted criteria {field, weight, direction}.

    Norms, ideals and the number of better rows for each distinct score are
    aggregates; only rows with all criteria are scored.
    """
    values = [local(df, c["field"]) for c in criteria]
    whole = sum(c.get("weight", 1.0) for c in criteria)
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    norms = df.where(complete).agg(F.count(F.lit(1)), *[F.sqrt(F.sum(v * v)) for v in values], *[f(v) for v in values for f in (F.min, F.max)]).first()
    n, k = norms[0], len(values)
    if n < 2:
        raise ValueError("needs two complete rows")
    near, far = F.lit(0.0), F.lit(0.0)
    for i, (c, v) in enumerate(zip(criteria, values, strict=True)):
        norm, w = norms[1 + i] or 1.0, c.get("weight", 1.0) / whole
        low, high = norms[1 + k + 2 * i] / norm * w, norms[2 + k + 2 * i] / norm * w
        best, worst = (high, low) if c.get("direction", "benefit") == "benefit" else (low, high)
        scaled = v * F.lit(w / norm)
        near, far = near + F.pow(scaled - F.lit(best), 2), far + F.pow(scaled - F.lit(worst), 2)
    near, far = F.sqrt(near), F.sqrt(far)
    score = F.when(complete, even_round(F.when(near + far == 0, 0.5).otherwise(far / (near + far))))
    scored = df.withColumn(score_field, score)
    levels = scored.where(F.col(score_field).isNotNull()).groupBy(F.col(score_field).alias("__s")).agg(F.count(F.lit(1)).alias("__k"))
    better = F.coalesce(F.sum("__k").over(Window.orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = levels.withColumn(rank_field, (better + 1).cast("int")).drop("__k")
    return scored.join(ranks, scored[score_field] == ranks["__s"], "left").drop("__s")


#: Random consistency of reciprocal matrices of 1 to 10 rows.
RANDOM_INDEX = (0.0, 0.0, 0.58, 0.9, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49)


def ahp_weights(criteria: list[str], comparisons: dict[tuple[str, str], float]) -> dict:
    """Weights from pairwise comparisons of 2 to 10 criteria, with their consistency."""
    n = len(criteria)
    if not 2 <= n <= 10:
        raise ValueError("2 to 10 criteria")
    m = np.ones((n, n))
    for (a, b), v in comparisons.items():
        i, j = criteria.index(a), criteria.index(b)
        m[i, j], m[j, i] = v, 1 / v
    w = np.full(n, 1 / n)
    for _ in range(1000):
        new = m @ w
        new /= new.sum()
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    lam = float(np.mean(m @ new / new))
    index = (lam - n) / (n - 1)
    ratio = index / RANDOM_INDEX[n - 1] if RANDOM_INDEX[n - 1] else 0.0
    return {"weights": dict(zip(criteria, map(float, new), strict=True)), "lambda_max": lam, "ci": index, "cr": ratio, "consistent": ratio < 0.1}


def score_properties(df: DataFrame) -> DataFrame:
    """Suitability of building plots from 0 to 100, whether they are eligible, and why not.

    Points: 25 for a metro or mall within 500 m, 20 for a main road within 150 m,
    25 for an allowed zone, 10 for each risk (flood, earthquake, fire) that isn't high.
    """
    poi = F.least(F.coalesce(F.col("distance_to_metro_m"), F.lit(float("inf"))), F.coalesce(F.col("distance_to_mall_m"), F.lit(float("inf")))) <= 500
    road = F.coalesce(F.col("distance_to_main_road_m") <= 150, F.lit(False))
    zone = F.coalesce(F.col("in_allowed_zone"), F.lit(False))
    high = lambda c: F.coalesce(F.lower(F.col(c)).isin("high", "very_high"), F.lit(False))
    score = F.when(poi, 25).otherwise(0) + F.when(road, 20).otherwise(0) + F.when(zone, 25).otherwise(0)
    score = score + sum((F.when(high(c), 0).otherwise(10) for c in ("flood_risk", "earthquake_risk", "fire_risk")), F.lit(0))
    reasons = F.array_compact(F.array(F.when(~poi, "farther_than_500m_from_metro_or_mall"), F.when(~road, "far_from_main_road"), *[F.when(high(c), f"high_{c}") for c in ("flood_risk", "earthquake_risk", "fire_risk")], F.when(~zone, "outside_allowed_construction_zone")))
    return df.withColumn("investment_score", score.cast("double")).withColumn("reject_reasons", reasons).withColumn("eligible", F.size("reject_reasons") == 0)
