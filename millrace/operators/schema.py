"""Read records written under one schema as records of another.

Fields match by name. Reader fields the writer lacks take their default, writer fields the
reader lacks are dropped, and these promotions are allowed: int to long, float or double;
long to float or double; float to double; string to binary and back.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# Writer type -> reader types it may be read as.
PROMOTIONS = {
    "int": {"bigint", "float", "double"},
    "bigint": {"float", "double"},
    "float": {"double"},
    "string": {"binary"},
    "binary": {"string"},
}


class IncompatibleSchema(ValueError):
    """A reader field can be filled neither from the writer nor from a default."""


def resolve(df: DataFrame, reader: StructType, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Project `df` onto the reader schema; nested defaults use dotted names."""
    columns = _fields(df.schema, reader, defaults or {}, "", None)
    return df.select(*columns)


def _fields(
    writer: StructType, reader: StructType, defaults: dict[str, Any], prefix: str, parent: Column | None
) -> list[Column]:
    known = {f.name: f for f in writer.fields}
    columns = []
    for field in reader.fields:
        path = prefix + field.name
        if field.name in known:
            source = F.col(f"`{field.name}`") if parent is None else parent[field.name]
            value = _promote(source, known[field.name].dataType, field.dataType, defaults, path)
        elif path in defaults:
            value = F.lit(defaults[path]).cast(field.dataType)
        else:
            raise IncompatibleSchema(f"{path}: not written and without a default")
        columns.append(value.alias(field.name))
    return columns


def _promote(
    source: Column, writer: DataType, reader: DataType, defaults: dict[str, Any], path: str
) -> Column:
    if isinstance(writer, StructType) and isinstance(reader, StructType):
        record = F.struct(*_fields(writer, reader, defaults, path + ".", source))
        return F.when(source.isNotNull(), record)
    if isinstance(writer, ArrayType) and isinstance(reader, ArrayType):
        return F.transform(
            source,
            lambda item: _promote(item, writer.elementType, reader.elementType, defaults, path),
        )
    if writer == reader:
        return source
    if reader.simpleString() in PROMOTIONS.get(writer.simpleString(), ()):
        return source.cast(reader)
    raise IncompatibleSchema(
        f"{path}: {writer.simpleString()} cannot be read as {reader.simpleString()}"
    )
