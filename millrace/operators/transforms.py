"""Per-record projection, filter, flat-map, rendering and merge.

Everything here except `call_per_record` is a plain column expression, so it works the
same on batch and streaming DataFrames and stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """One output record per input record, with the named columns in the order given."""
    return df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    )


def override(
    df: DataFrame, suffix: dict[str, str] | None = None, constants: dict[str, Any] | None = None
) -> DataFrame:
    """Append configured text to some columns and set others to configured constants."""
    changed = {c: F.concat(F.col(c), F.lit(text)) for c, text in (suffix or {}).items()}
    changed |= {c: F.lit(value) for c, value in (constants or {}).items()}
    return df.withColumns(changed)


def wrap_with_error(df: DataFrame, record: str, message: str, columns: Sequence[str]) -> DataFrame:
    """Pack each record into the struct `record` and put an error text beside it."""
    return df.select(F.struct(*columns).alias(record), F.lit(message).alias("error"))


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    measures: dict[str, Column | str],
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """Wide to long: one record per measure, in the order of `measures`.

    Written as an exploded array of structs, which streaming accepts too.
    """
    pairs = [
        F.struct(
            F.lit(label).alias(name),
            (F.col(c) if isinstance(c, str) else c).cast("double").alias(value),
        )
        for label, c in measures.items()
    ]
    return df.select(*ids, F.explode(F.array(*pairs)).alias("_pair")).select(
        *ids, f"_pair.{name}", f"_pair.{value}"
    )


def keep_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Keep the records whose column equals the configured value."""
    return df.where(F.col(column) == F.lit(value))


def keep_present(df: DataFrame, column: str) -> DataFrame:
    """Flatten an optional: records without a value disappear."""
    return df.where(F.col(column).isNotNull())


def expand(df: DataFrame, array: str, alias: str) -> DataFrame:
    """One record per array element, in array order; an empty array yields none."""
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.explode(array).alias(alias))


def as_document(title: Column, body: Column) -> Column:
    """Title, blank line, body."""
    return F.concat(title, F.lit("\n\n"), body)


def as_pair(key: Column, value: Column) -> Column:
    return F.concat(key.cast("string"), F.lit(" -> "), value.cast("string"))


def as_log_line(prefix: str, columns: Sequence[str]) -> Column:
    """Prefix followed by the record as JSON, null fields written out."""
    return F.concat(F.lit(prefix), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def merge(*frames: DataFrame) -> DataFrame:
    """All records of at least one same-typed input; duplicates stay, order is open."""
    if not frames:
        raise ValueError("merge needs at least one input")
    return reduce(DataFrame.unionByName, frames)


def merge_strict(frames: Sequence[DataFrame]) -> DataFrame:
    """The older form of merge that insists on two inputs."""
    if len(frames) < 2:
        raise ValueError(f"merge needs at least two inputs, got {len(frames)}")
    return merge(*frames)


def call_per_record(
    df: DataFrame,
    call: Callable[[dict[str, Any]], Any],
    output: str,
    output_type: DataType,
    inputs: Sequence[str],
    parallelism: int = 5,
    timeout: float | None = 3.0,
) -> DataFrame:
    """Add the answer of a blocking call per record, `parallelism` calls in flight per task.

    Answers keep record order. A call that is not done `timeout` seconds after its turn fails the
    task, which Spark retries; calls not yet begun are then cancelled. For lookups into data use a join; this is for black-box services.
    """
    schema = StructType([*df.schema.fields, StructField(output, output_type)])
    answer_type = to_arrow_type(output_type)
    names = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(parallelism)
        try:
            for batch in batches:
                pending, answers = deque(), []
                for record in batch.select(names).to_pylist():
                    if len(pending) == parallelism:
                        answers.append(pending.popleft().result(timeout))
                    pending.append(pool.submit(call, record))
                answers += [p.result(timeout) for p in pending]
                yield batch.append_column(output, pa.array(answers, answer_type))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInArrow(run, schema)
