"""Record validation, typed column checks, key and reference checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators.routing import split
from millrace.operators.transforms import wrap_with_error

# Fixed value: the error text invalid measurements carry.
INVALID_MEASUREMENT = "All measurements must be positive numbers!"


def is_valid_measurement(value: Column) -> Column:
    """Zero and above. Spark sorts NaN above every number, so NaN is excluded by hand."""
    return F.coalesce((value >= 0) & ~F.isnan(value), F.lit(False))


def validate_measurements(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid records, invalid records wrapped as `metric` beside the error text)."""
    invalid, valid = split(df, is_valid_measurement(F.col(value)))
    return valid, wrap_with_error(invalid, "metric", INVALID_MEASUREMENT, df.columns)


@dataclass(frozen=True)
class Check:
    """A column and the type its text must have: bool, int32, double, duration,
    memorysize, or string with an optional pattern."""

    column: str
    kind: str
    pattern: str | None = None

    def passes(self) -> Column:
        text = F.col(self.column)
        match self.kind:
            case "bool":
                return scalars.parse_bool(text).isNotNull()
            case "int32":
                return text.try_cast("int").isNotNull()
            case "double":
                return text.try_cast("double").isNotNull()
            case "duration":
                return scalars.duration_nanos(text).isNotNull()
            case "memorysize":
                return scalars.memory_bytes(text).isNotNull()
            case "string":
                return scalars.matches(text, self.pattern) if self.pattern else F.lit(True)
        raise ValueError(f"unknown kind: {self.kind}")


def typed_failures(df: DataFrame, row_key: str, checks: Sequence[Check]) -> DataFrame:
    """(row key, column, value) for each value that fails its check; NULL is not a value.

    One pass: the failures of a row are built as an array and exploded.
    """
    found = [
        F.when(
            F.col(c.column).isNotNull() & ~F.coalesce(c.passes(), F.lit(False)),
            F.struct(F.lit(c.column).alias("column"), F.col(c.column).alias("value")),
        )
        for c in checks
    ]
    return df.select(row_key, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(
        row_key, "_f.column", "_f.value"
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Every record whose trimmed key occurs more than once. All characters up to U+0020 are
    trimmed.

    The count is pre-aggregated; the way back is a semi join, whose streamed side adaptive
    execution splits when one key dominates.
    """
    trimmed = df.withColumn("_trimmed", F.regexp_replace(key, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""))
    counted = trimmed.groupBy(F.col("_trimmed").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counted.where("_n > 1").select("_key")
    return trimmed.join(
        repeated, F.col("_trimmed").eqNullSafe(F.col("_key")), "left_semi"
    ).drop("_trimmed")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Records whose key has no partner. One record each: the list can be any size."""
    partners = parent.select(F.col(parent_key).alias("_partner"))
    return df.join(partners, df[key] == partners["_partner"], "left_anti")


def bound_to_many(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, parent, number of parents) for keys seen under more than one parent.

    Long form, one record per parent, since a key may have any number of them.
    """
    pairs = df.select(key, parent).distinct()
    many = (
        pairs.groupBy(F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("parents"))
        .where("parents > 1")
    )
    return pairs.join(many, pairs[key].eqNullSafe(many["_key"])).select(key, parent, "parents")
