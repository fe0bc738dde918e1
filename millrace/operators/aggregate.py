"""Count windows, running means and event-time windows (batch forms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import MAX_ROWS_PER_KEY, KeySizes, running_totals


def count_window(
    df: DataFrame,
    size: int,
    order_by: Sequence[str],
    aggregates: Sequence[Column],
    keys: Sequence[str] = (),
    keep_partial: bool = True,
    max_rows_per_key: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Aggregate each run of `size` consecutive records, per key or over the whole frame.

    Output: the keys, `window` (0-based number of the run) and the aggregates. A finite
    input ends with a short run unless `keep_partial` is off.
    """
    if size < 1:
        raise ValueError("size must be positive")

    def per_run(indexed: DataFrame) -> DataFrame:
        runs = indexed.withColumn("window", window_number(F.col("_index"), size))
        counted = runs.groupBy(*keys, "window").agg(*aggregates, F.count(F.lit(1)).alias("_n"))
        if not keep_partial:
            counted = counted.where(F.col("_n") == size)
        return counted.drop("_n")

    return running_totals(
        df,
        keys,
        order_by,
        {"_index": F.lit(1).cast("long")},
        max_rows_per_key=max_rows_per_key,
        # Keyed runs lie within one key; keyless ones may cross chunks and meet after it.
        then=per_run,
    )


def window_number(index: Column, size: int) -> Column:
    """0-based number of the run that the 1-based record `index` falls into."""
    return F.floor((index - 1) / F.lit(size)).cast("long")


def running_mean(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    carry: Sequence[str] = (),
    prior: DataFrame | None = None,
    max_rows_per_key: int = MAX_ROWS_PER_KEY,
    sizes: KeySizes | None = None,
) -> DataFrame:
    """One output per input: mean and count of the key's values so far, this one included.

    `carry` columns are taken from the current record, that is the latest. `prior` may
    hold (`keys`, `_sum`, `_count`) of what came before this frame.
    """
    scanned = running_totals(
        df,
        keys,
        order_by,
        {
            "_sum": F.col(value).cast("double"),
            "_count": F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long"),
        },
        prior=prior,
        max_rows_per_key=max_rows_per_key,
        sizes=sizes,
    )
    mean = F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))
    return scanned.select(
        *keys,
        *order_by,
        *carry,
        mean.alias("mean"),
        F.col("_count").cast("long").alias("records"),
    )


def call_stats(
    df: DataFrame,
    ts: str,
    duration: str,
    group_by_window: str,
    keys: Sequence[str] = (),
    watermark: str | None = None,
) -> DataFrame:
    """Calls, total and mean duration per event-time window; windows start at the epoch.

    On a stream pass `watermark`: windows close once it has passed their end. Watermarks
    need a zoned timestamp, so a zone-less one is read as session time.
    """
    if watermark is not None:
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    grouped = df.groupBy(F.window(ts, group_by_window), *keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(duration).alias("total_duration"),
        F.avg(duration).alias("mean_duration"),
    )
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *keys,
        "calls",
        "total_duration",
        "mean_duration",
    )
