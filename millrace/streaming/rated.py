"""At most so many records per period, counted as records and not as files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.session import delete_path, move_path, path_exists
from millrace.sources.topics import Topic, start

_ROW = "_row"
_TASK_BITS = 33
"""`monotonically_increasing_id` keeps the task above these bits and the row within it below."""


def write_rated(
    stream: DataFrame,
    topic: Topic,
    checkpoint: str,
    producer: str,
    records: int,
    period: float = 1.0,
    trigger: dict | None = None,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> StreamingQuery:
    """Committed write of at most `records` records per `period` seconds, each period's as one batch.

    A micro-batch is stored with its rows numbered, then published slice by slice. A replay after a crash
    finds the numbering and the slices that are out already, so it goes on with the next one. Micro-batches
    are as large as the source makes them; a limit of files per trigger bounds what is stored.
    """
    if records < 1 or period < 0:
        raise ValueError("needs at least one record and a period that is not negative")
    spark, due = stream.sparkSession, [clock()]

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = f"{checkpoint}/slices/batch_id={batch_id}"
        rows = _numbered(spark, batch, kept)
        for number, (low, high) in enumerate(_slices(rows, records)):
            wait = due[0] - clock()
            if wait > 0:
                sleep(wait)
            due[0] = max(due[0], clock()) + period
            part = rows.where(F.col(_ROW).between(low, high)).drop(_ROW)
            topic.write_batch(part, producer, f"{batch_id}.{number}")
        delete_path(spark, kept)

    return start(stream, each, checkpoint, trigger)


def _numbered(spark: SparkSession, batch: DataFrame, kept: str) -> DataFrame:
    # Always run: stateful operators upstream must see each batch through.
    staged = f"{kept.rsplit('/', 1)[0]}/_staged-{uuid.uuid4().hex}"
    numbered = batch.withColumn(_ROW, F.monotonically_increasing_id())
    numbered.write.parquet(staged)
    if not move_path(spark, staged, kept):
        delete_path(spark, staged)
    return spark.read.schema(numbered.schema).parquet(kept)


def _slices(rows: DataFrame, records: int) -> Iterator[tuple[int, int]]:
    """First and last row number of each slice. Numbers ascend over tasks and are dense within one, hence a
    slice is one interval, which the Parquet scan finds by its statistics. One count per task is all the
    driver holds."""
    task = F.shiftright(_ROW, _TASK_BITS).alias("task")
    first, room, last = None, records, None
    for number, size in rows.groupBy(task).count().orderBy("task").collect():
        base, taken = number << _TASK_BITS, 0
        while taken < size:
            first = base + taken if first is None else first
            step = min(room, size - taken)
            taken, room = taken + step, room - step
            last = base + taken - 1
            if room == 0:
                yield first, last
                first, room = None, records
    if first is not None:
        yield first, last
