"""JSON wire codec with a policy for undecodable records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.scalars import once

_CORRUPT = "_corrupt"


def encode(columns: Sequence[Column | str] = ("*",)) -> Column:
    """Record to JSON text."""
    return F.to_json(F.struct(*columns))


def decoded(text: Column, schema: StructType) -> Column:
    """Struct of the record, or NULL when the text is not exactly one JSON object of this
    schema. Fields declared NOT NULL must be present; unknown fields are ignored."""
    marked = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _CORRUPT,
        "allowSingleQuotes": "false",
        "allowNonNumericNumbers": "false",
    }
    # The parser stops after the first value; as the only element of an array, text behind
    # the object becomes an error.
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    is_object = text.rlike(r"^\s*\{")

    def record(parsed: Column) -> Column:
        good = is_object & alone & parsed[_CORRUPT].isNull() & _required(parsed, schema)
        fields = F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields])
        return F.when(F.coalesce(good, F.lit(False)), fields)

    return once(F.from_json(text, marked, options), record)


def _required(record: Column, schema: StructType) -> Column:
    """Every NOT NULL field is set, in nested records too where the parent is set."""
    result = F.lit(True)
    for field in schema.fields:
        value = record[field.name]
        if not field.nullable:
            result = result & value.isNotNull()
        if isinstance(field.dataType, StructType):
            result = result & (value.isNull() | _required(value, field.dataType))
    return result


def _present(df: DataFrame, text: str, record: Column, schema: StructType) -> DataFrame:
    """The fields of each non-NULL record beside the other columns.

    Written as a flat-map of 0..1 records: a filter would be pushed below the decoding and
    run it a second time.
    """
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.inline(F.array_compact(F.array(record)))).select(
        *others, *[f.name for f in schema.fields]
    )


def decode_skip(
    df: DataFrame, text: str, schema: StructType, seen: Observation | None = None
) -> DataFrame:
    """Drop undecodable records. `seen` counts `records` and `skipped` as the query runs."""
    if seen is None:
        return _present(df, text, decoded(F.col(text), schema), schema)
    marked = df.withColumn(text, decoded(F.col(text), schema))
    counted = marked.observe(
        seen,
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col(text).isNull()).alias("skipped"),
    )
    return _present(counted, text, F.col(text), schema)


def decode_replace(df: DataFrame, text: str, schema: StructType, replacement: Column) -> DataFrame:
    """Put `replacement`, a struct of this schema, where a record is undecodable; where it
    is NULL too the record is dropped."""
    value = F.coalesce(decoded(F.col(text), schema), replacement.cast(_nullable(schema)))
    return _present(df, text, value, schema)


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def decode_dead_letter(
    df: DataFrame, text: str, schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """(decoded records, dead letters: the raw text and a reason)."""
    good = _present(df, text, decoded(F.col(text), schema), schema)
    reason = F.when(F.col(text).isNull(), "no value").otherwise("undecodable")
    dead = df.where(decoded(F.col(text), schema).isNull()).withColumn("reason", reason)
    return good, dead


def decode_strict(df: DataFrame, text: str, schema: StructType) -> DataFrame:
    """Fail the query on the first undecodable record."""
    shown = F.coalesce(F.col(text), F.lit("NULL"))
    wrong = F.raise_error(F.concat(F.lit("undecodable record: "), shown))
    value = F.coalesce(decoded(F.col(text), schema), wrong.cast(_nullable(schema)))
    return _present(df, text, value, schema)
