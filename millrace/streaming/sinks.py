"""Micro-batch writers with more than one output."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.topics import Topic, start


def write_many(
    frames: Sequence[tuple[DataFrame, Topic]], producer: str, batch_id: int | str
) -> None:
    """Write every frame under the same batch id; each write is safe to repeat."""
    for frame, topic in frames:
        topic.write_batch(frame, producer, batch_id)


def write_two_stream(
    stream: DataFrame,
    divide: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    first: Topic,
    second: Topic,
    checkpoint: str,
    producer: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Divide each micro-batch over two topics; offsets are committed after both writes.

    A crash after the first write replays both under the same batch id, and the finished
    one is left alone.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            a, b = divide(batch)
            write_many([(a, first), (b, second)], producer, batch_id)
        finally:
            batch.unpersist()

    return start(stream, each, checkpoint, trigger)


def write_files_and_pass(
    stream: DataFrame,
    line: str,
    directory: str,
    onward: Topic,
    checkpoint: str,
    producer: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the text of `line` (a SQL expression) to files and pass the records on."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            text = batch.select(F.expr(line).cast("string").alias("value"))
            text.write.mode("overwrite").text(f"{directory}/batch_id={batch_id}")
            onward.write_batch(batch, producer, batch_id)
        finally:
            batch.unpersist()

    return start(stream, each, checkpoint, trigger)


def print_lines(lines: Iterator[str]) -> None:
    for line in lines:
        print(line, flush=True)


def log_lines(
    stream: DataFrame,
    line: str,
    checkpoint: str,
    trigger: dict | None = None,
    log: Callable[[Iterator[str]], None] = print_lines,
) -> StreamingQuery:
    """Log a text expression of every record. Each task logs its own records, by default on
    the output of its executor; nothing passes through the driver."""

    def lines(batches):
        log(x for batch in batches for x in batch.column(0).to_pylist())
        return iter(())

    def each(batch: DataFrame, batch_id: int) -> None:
        text = batch.select(F.expr(line).cast("string").alias("line"))
        text.mapInArrow(lines, text.schema).write.format("noop").mode("overwrite").save()

    return start(stream, each, checkpoint, trigger)
