"""Keyed state across micro-batches: running means, count windows, event-time windows.

State lies in Spark's state store (see `millrace.streaming.keyed`). The rows of a batch go through the same
operators as in batch mode, hence a key that owns a third of a batch is still spread over many tasks, and
order within a batch is by `order_by`, not by arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.aggregate import call_stats, running_mean, window_number
from millrace.operators.ordered import MAX_ROWS_PER_KEY, running_totals
from millrace.operators.reference import drop_listed, stored_key_list
from millrace.operators.transforms import merge
from millrace.session import delete_path, scratch_scope
from millrace.sources.topics import Topic, start
from millrace.streaming.keyed import COUNT, TOTAL, KeyedFlow


def stream_running_mean(
    stream: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    out: Topic,
    checkpoint: str,
    producer: str,
    carry: Sequence[str] = (),
    max_rows_per_key: int = MAX_ROWS_PER_KEY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """`running_mean` over an unbounded flow; the state survives restarts."""
    spark = stream.sparkSession
    keyed = KeyedFlow(stream, keys, F.col(value), F.col(value).isNotNull())

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            with scratch_scope(spark):
                own = keyed.divided(batch)
                prior = own.before.withColumnsRenamed({TOTAL: "_sum", COUNT: "_count"})
                rows = running_mean(own.records, keys, order_by, value, carry, prior, max_rows_per_key)
                out.write_batch(rows, producer, batch_id)
        finally:
            batch.unpersist()

    return start(keyed.flow, each, checkpoint, trigger)


def stream_count_window(
    stream: DataFrame,
    size: int,
    keys: Sequence[str],
    order_by: Sequence[str],
    aggregates: Sequence[Column],
    out: Topic,
    checkpoint: str,
    producer: str,
    max_rows_per_key: int = MAX_ROWS_PER_KEY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """`count_window` over an unbounded flow: full runs are emitted as they complete; up to
    size - 1 records per key wait for the next batch."""
    spark = stream.sparkSession
    keyed = KeyedFlow(stream, keys, F.lit(0.0), F.lit(1), order_by, size)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            with scratch_scope(spark):
                own = keyed.divided(batch)
                before = own.before.select(*keys, F.col(COUNT).alias("_index"))
                one = {"_index": F.lit(1).cast("long")}
                indexed = running_totals(own.records, keys, order_by, one, before, max_rows_per_key)
                open_rows = merge(indexed, own.waiting.withColumnRenamed(COUNT, "_index"))
                runs = open_rows.withColumn("window", window_number(F.col("_index"), size))
                full = runs.groupBy(*keys, "window").agg(*aggregates, F.count(F.lit(1)).alias("_in_run"))
                out.write_batch(full.where(F.col("_in_run") == size).drop("_in_run"), producer, batch_id)
        finally:
            batch.unpersist()

    return start(keyed.flow, each, checkpoint, trigger)


def stream_call_stats(
    stream: DataFrame,
    ts: str,
    duration: str,
    group_by_window: str,
    watermark: str,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Event-time windows written once each, when the watermark passes their end."""
    stats = call_stats(stream, ts, duration, group_by_window, keys, watermark)
    return (
        stats.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_drop_listed(
    stream: DataFrame,
    key: str,
    list_path: str,
    out: Topic,
    checkpoint: str,
    producer: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Filter each micro-batch against the version of the key list that was the newest when it began.

    That version is stored with the batch: a replay after a crash meets the same list.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = f"{checkpoint}/lists/batch_id={batch_id}"
        listed = stored_key_list(spark, list_path, kept)
        out.write_batch(drop_listed(batch, key, listed), producer, batch_id)
        if batch_id:
            delete_path(spark, f"{checkpoint}/lists/batch_id={batch_id - 1}")

    return start(stream, each, checkpoint, trigger)


def stream_deduplicated(
    stream: DataFrame, key: Sequence[str], ts: str, within: str
) -> DataFrame:
    """Drop repeats of a key that arrive within `within` of its first record.

    The delay counts from arrival, not from event time: arrival never runs backwards, so no
    record is too late and a distinct one always comes through, whatever its `ts`. Keys are
    forgotten once `within` has passed, which bounds the state.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    arrived = timed.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return arrived.dropDuplicatesWithinWatermark(list(key)).drop("_arrived")
