"""Per-key running sums that stay balanced when one key owns much of the data.

Keys of ordinary size go through one `Window.partitionBy(key)`. Keys above
`max_rows_per_key` are range-partitioned on (key, order columns), so one key spans many
tasks; each chunk is scanned on its own and then shifted by the totals of the chunks
before it. Both ways give the same rows; sums of fractional doubles are added in another order and
may differ in the last digits (relative error below 1e-12 for values of one sign). A sum is NULL
until its first value that is not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from millrace.session import materialized

MAX_ROWS_PER_KEY = 5_000_000
"""Largest group one task may scan in order."""

BROADCAST_ROWS = 100_000
"""Most key rows that are ever sent to all executors; more are joined by shuffle."""


@dataclass(frozen=True)
class HotRows:
    """The records of keys too large for one task, and how they are to be spread."""

    rows: DataFrame
    keys: int
    chunks: int


def divide_by_keys(
    df: DataFrame, keys: Sequence[str], listed: DataFrame, size: int
) -> tuple[DataFrame, DataFrame]:
    """(records whose key is not listed, records whose key is). `listed` has `size` rows and
    columns `_key_<name>`; NULL counts as a key."""
    side = F.broadcast(listed) if size <= BROADCAST_ROWS else listed
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(side, same, "left_anti"), df.join(side, same, "left_semi")


@dataclass(frozen=True)
class KeySizes:
    """How many records each key has (columns `_key_<name>`, `_rows`), how many keys there
    are, and the size of the largest."""

    counted: DataFrame
    keys: int
    largest: int


def key_sizes(df: DataFrame, keys: Sequence[str]) -> KeySizes:
    """Aggregated map-side; reads the key columns only."""
    named = [F.col(k).alias(f"_key_{k}") for k in keys]
    counted = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_rows"))
    n_keys, largest = counted.agg(F.count(F.lit(1)), F.max("_rows")).first()
    return KeySizes(counted, n_keys, largest or 0)


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    max_rows_per_key: int = MAX_ROWS_PER_KEY,
    sizes: KeySizes | None = None,
) -> tuple[DataFrame | None, HotRows | None]:
    """(records of ordinary keys, records of hot keys); None where there are none.

    At most rows / max_rows_per_key keys can be hot. Without keys the whole frame is one
    hot group. `sizes` saves a pass where they are known.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not keys:
        return None, HotRows(df, 1, max(least, -(-df.count() // max_rows_per_key)))
    sizes = sizes or key_sizes(df, keys)
    if sizes.largest <= max_rows_per_key:
        return df, None
    hot = materialized(sizes.counted.where(F.col("_rows") > max_rows_per_key), "hot-keys")
    n_keys, n_rows = hot.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    ordinary, large = divide_by_keys(df, keys, hot.drop("_rows"), n_keys)
    return ordinary, HotRows(large, n_keys, max(least, -(-n_rows // max_rows_per_key)))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    measures: dict[str, Column],
    prior: DataFrame | None = None,
    max_rows_per_key: int = MAX_ROWS_PER_KEY,
    sizes: KeySizes | None = None,
    then: Callable[[DataFrame], DataFrame] = lambda d: d,
) -> DataFrame:
    """Add, per row, the running sum of every measure over its key up to and including it.

    `order_by` must end in a unique tiebreaker. `prior` holds at most one row per key with
    a starting value for each measure; it enters the scan as a record before all others.
    Unless `sizes` is given, keys are counted first, which reads the input once more.
    `then` runs on the two branches before their union, so an aggregation on the key can
    reuse the partitioning of the first branch.
    """
    names = list(measures)
    order = list(order_by)
    rows = df.withColumns(measures)
    if prior is not None:
        starts = prior.select(*keys, *names).withColumn("_fresh", F.lit(0))
        rows = rows.withColumn("_fresh", F.lit(1)).unionByName(starts, allowMissingColumns=True)
        order = ["_fresh", *order]

    def finish(scanned: DataFrame) -> DataFrame:
        if prior is not None:
            scanned = scanned.where("_fresh = 1").drop("_fresh")
        return then(scanned)

    cold, hot = split_hot(rows, keys, max_rows_per_key, sizes)
    parts = []
    if cold is not None:
        parts.append(finish(_scan(cold, keys, order, names)))
    if hot is not None:
        parts.append(finish(_chunked(hot, keys, order, names)))
    return reduce(DataFrame.unionByName, parts)


def _up_to_here(within: Sequence[str], order: Sequence[str]) -> WindowSpec:
    spec = Window.partitionBy(*within).orderBy(*order)
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _scan(
    df: DataFrame, within: Sequence[str], order: Sequence[str], names: Sequence[str]
) -> DataFrame:
    return df.withColumns({n: F.sum(n).over(_up_to_here(within, order)) for n in names})


def _chunked(
    hot: HotRows, keys: Sequence[str], order: Sequence[str], names: Sequence[str]
) -> DataFrame:
    # The chunk number must not change once totals were taken from it, hence the written copy.
    ranged = materialized(
        hot.rows.repartitionByRange(hot.chunks, *keys, *order).withColumn(
            "_chunk", F.spark_partition_id()
        ),
        "chunks",
    )
    totals = ranged.groupBy(*keys, "_chunk").agg(*[F.sum(n).alias(n) for n in names])
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (hot key, chunk it reaches): at most hot keys + chunks rows in all.
    starts = totals.select(
        *[F.col(k).alias(f"_start_{k}") for k in keys],
        F.col("_chunk").alias("_start_chunk"),
        *[F.sum(n).over(before).alias(f"_start_{n}") for n in names],
    )
    if hot.keys + hot.chunks <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_start_{k}")) for k in keys],
        F.col("_chunk") == F.col("_start_chunk"),
    )
    scanned = _scan(ranged.join(starts, same), [*keys, "_chunk"], order, names)
    shifted = scanned.withColumns(
        {
            n: F.coalesce(F.col(n) + F.col(f"_start_{n}"), F.col(n), F.col(f"_start_{n}"))
            for n in names
        }
    )
    return shifted.drop(
        "_chunk", "_start_chunk", *[f"_start_{k}" for k in keys], *[f"_start_{n}" for n in names]
    )
