"""Features with equal geometry, looked at once.

What an operator finds for a shape holds for every feature that has it. So layers
are reduced to their distinct shapes, each under the smallest id that has it, and
the findings are handed out to the features afterwards; a layer without equal
shapes pays one exchange for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable


def alike(df: DataFrame, order: str = "_idx") -> tuple[DataFrame, DataFrame]:
    """Distinct shapes (``order``, geometry), and (shape, member): which feature has which."""
    known = durable(df.where("geometry is not null").select(F.col(order).cast("bigint").alias("member"), "geometry"))
    shapes = durable(known.groupBy("geometry").agg(F.min("member").alias(order)).select(order, "geometry"))
    members = known.join(shapes.withColumnRenamed(order, "shape"), "geometry").select("shape", "member")
    return shapes, durable(members)


def handed_out(found: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Rows about shapes, whose ids are in the column ``name``, as rows about the features that have them."""
    rest = [c for c in found.columns if c != name]
    return found.join(members.withColumnRenamed("shape", name), name).drop(name).select(F.col("member").alias(name), *rest)
