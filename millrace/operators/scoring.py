"""Score records with a user-supplied model and never lose one.

A record the model fails on keeps its row with the empty value and the error text; when
the model cannot be loaded every row does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

RESULT = [
    StructField("value", DoubleType(), False),
    StructField("errors", StringType(), False),
    StructField("model_name", StringType(), False),
    StructField("start_time", LongType(), False),
    StructField("duration", LongType(), False),
]


def score(
    df: DataFrame,
    features: Sequence[str] | str,
    load: Callable[[str], Callable[[np.ndarray], np.ndarray]],
    mount: str,
    model_name: str,
    empty_value: float = 0.0,
) -> DataFrame:
    """Add `value` (index of the largest model output, the first one on ties) and metadata.

    `features` are numeric columns in model order, or one array column. `load` runs once
    per task with `<mount>/<model_name>` and returns a function from an (n, k) float32
    matrix to an (n, m) matrix; `mount` must be readable on every executor. A batch the
    model rejects is halved until the bad records are found. `start_time` is
    when the task loaded the model and `duration` the scoring time, both in milliseconds.
    """
    path = f"{mount.rstrip('/')}/{model_name}"
    schema = StructType([*df.schema.fields, *RESULT])

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        if isinstance(features, str):
            lists = batch.column(features)
            lengths = set(pc.list_value_length(lists).to_pylist())
            if len(lengths) == 1 and None not in lengths:
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                return flat.astype(np.float32).reshape(len(lists), -1)
            return np.asarray(lists.to_pylist(), dtype=np.float32)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in features]
        return np.stack(columns, axis=1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            model, failure, name, started = load(path), "", model_name, _now()
        except Exception as error:  # the load error becomes data
            model, failure, name, started = None, f"Could not load model: {error}", "", 0
        for batch in batches:
            n = batch.num_rows
            values = np.full(n, empty_value, dtype=np.float64)
            errors, durations = [failure] * n, [0] * n
            spans = [(0, n)] if model is not None and n else []
            while spans:
                low, high = spans.pop()
                size, begin = high - low, _now()
                try:
                    scores = _checked(model(matrix(batch.slice(low, size))), size)
                    values[low:high] = np.argmax(scores, axis=1)
                except Exception as error:
                    if size > 1:
                        middle = low + size // 2
                        spans += [(low, middle), (middle, high)]
                        continue
                    errors[low] = str(error)
                durations[low:high] = [_now() - begin] * size
            result = [
                pa.array(values, pa.float64()),
                pa.array(errors, pa.string()),
                pa.array([name] * n, pa.string()),
                pa.array([started] * n, pa.int64()),
                pa.array(durations, pa.int64()),
            ]
            for field, column in zip(RESULT, result):
                batch = batch.append_column(field.name, column)
            yield batch

    return df.mapInArrow(run, schema)


def _checked(output: Any, rows: int) -> np.ndarray:
    result = np.asarray(output)
    if result.ndim != 2 or result.shape[0] != rows:
        raise ValueError(f"model returned shape {result.shape} for {rows} records")
    return result


def _now() -> int:
    return int(time.time() * 1000)
