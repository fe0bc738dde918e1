"""Split one flow into two, and carry two-sided records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, is_right: Column) -> tuple[DataFrame, DataFrame]:
    """(left, right) by a condition made two-valued: NULL goes left, so no record is lost."""
    goes_right = F.coalesce(is_right, F.lit(False))
    return df.where(~goes_right), df.where(goes_right)


def left(value: Column, right_type: str) -> Column:
    return F.struct(value.alias("left"), F.lit(None).cast(right_type).alias("right"))


def right(value: Column, left_type: str) -> Column:
    return F.struct(F.lit(None).cast(left_type).alias("left"), value.alias("right"))


def either(is_right: Column, left_value: Column, right_value: Column) -> Column:
    """Two-sided value as a struct with exactly one side set (values must not be NULL)."""
    goes_right = F.coalesce(is_right, F.lit(False))
    return F.struct(
        F.when(~goes_right, left_value).alias("left"),
        F.when(goes_right, right_value).alias("right"),
    )


def is_left(value: Column) -> Column:
    return value["right"].isNull()


def is_right(value: Column) -> Column:
    return value["right"].isNotNull()


def get_right(value: Column) -> Column:
    """The right side; a record holding a left side fails the query."""
    missing = F.raise_error(F.lit("right side requested of a left value"))
    return F.when(is_right(value), value["right"]).otherwise(missing)


def get_left(value: Column) -> Column:
    missing = F.raise_error(F.lit("left side requested of a right value"))
    return F.when(is_left(value), value["left"]).otherwise(missing)


def map_right(value: Column, change: Callable[[Column], Column]) -> Column:
    """Change the right side only; a left value passes through untouched."""
    return F.struct(
        value["left"].alias("left"),
        F.when(is_right(value), change(value["right"])).alias("right"),
    )


def to_multi(value: Column) -> Column:
    """Two-sided value to a pair of arrays, one of which holds the value."""
    return multi(
        F.when(is_left(value), F.array(value["left"])),
        F.when(is_right(value), F.array(value["right"])),
    )


def multi(first: Column | None = None, second: Column | None = None) -> Column:
    """0..n records for each of two outlets; a missing side counts as empty."""
    nothing = F.lit(None).cast("array<string>")
    return F.struct(
        (nothing if first is None else first).alias("data1"),
        (nothing if second is None else second).alias("data2"),
    )


def with_data1(value: Column, data: Column) -> Column:
    return value.withField("data1", data)


def with_data2(value: Column, data: Column) -> Column:
    return value.withField("data2", data)


def outlets(df: DataFrame, value: str, alias: str = "record") -> tuple[DataFrame, DataFrame]:
    """Explode both sides of a `multi` column; the other columns are repeated."""
    others = [c for c in df.columns if c != value]
    first, second = (
        df.select(*others, F.explode(F.col(value)[side]).alias(alias)) for side in ("data1", "data2")
    )
    return first, second
