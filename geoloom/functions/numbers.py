"""How operators read numbers: strictly typed, from text, or from local text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Digits and separators of Persian and Arabic text, and their Latin counterparts.
LOCAL_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩٫،"
LATIN_DIGITS = "01234567890123456789.."


def finite(value: Column) -> Column:
    """The value as double; NaN and infinities are null."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def strict(df: DataFrame, name: str) -> Column:
    """Numbers of a numeric column; null for every other type, booleans included."""
    kind = df.schema[name].dataType
    return finite(F.col(name)) if isinstance(kind, NumericType) else F.lit(None).cast("double")


def loose(df: DataFrame, name: str) -> Column:
    """Numbers, also those written as text; null for booleans and what doesn't parse."""
    kind = df.schema[name].dataType
    if isinstance(kind, NumericType):
        return finite(F.col(name))
    if isinstance(kind, StringType):
        return finite(F.trim(F.col(name)).try_cast("double"))
    return F.lit(None).cast("double")


def local(df: DataFrame, name: str) -> Column:
    """As ``loose``, also with Persian and Arabic digits and a decimal comma."""
    if not isinstance(df.schema[name].dataType, StringType):
        return loose(df, name)
    text = F.translate(F.trim(F.col(name)), LOCAL_DIGITS, LATIN_DIGITS)
    return finite(F.when(~F.contains(text, F.lit(".")), F.replace(text, F.lit(","), F.lit("."))).otherwise(text).try_cast("double"))


def even_round(value: Column, digits: int = 6) -> Column:
    """Half-even rounding, as DuckDB's round_even does it."""
    return F.bround(value, digits)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def is_boolean(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, BooleanType)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (DateType, TimestampType, TimestampNTZType))
