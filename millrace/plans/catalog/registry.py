"""Registered queries, their SQL equivalents, and the inputs several of them share."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch
from millrace.sources.topics import Topic

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


TOPIC_FILES = 8
FILES_PER_SLICE = 2


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, table folder) -> DataFrame with its SQL equivalent."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Event-time windows and epoch conversions are defined in UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def topic_for(spark: SparkSession, df: DataFrame, name: str, key: str | None = None) -> Topic:
    """An empty topic shaped like `df`."""
    return Topic(scratch(spark, name), df.schema, key)


@lru_cache(maxsize=None)
def _loaded(application: str, folder: str, name: str) -> Topic:
    spark = SparkSession.active()
    df = table(spark, folder, name)
    topic = topic_for(spark, df, name)
    topic.write(df.repartition(TOPIC_FILES))
    return topic


def loaded_topic(spark: SparkSession, folder: str, name: str) -> Topic:
    """A topic holding a whole table, written once and shared by its consumers. It comes in
    several files, so that a limit of files per trigger yields several micro-batches."""
    return _loaded(spark.sparkContext.applicationId, folder, name)


@lru_cache(maxsize=None)
def _event_topic(application: str, folder: str) -> Topic:
    spark = SparkSession.active()
    events = table(spark, folder, "events")
    topic = Topic(scratch(spark, "events-by-time"), events.schema)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(micros, [0.33, 0.66])).first()[0]
    low, high = (F.timestamp_micros(F.lit(c)).cast("timestamp_ntz") for c in cuts)
    # Exhaustive: an event without a time goes with the last ones.
    slice_of = F.when(F.col("ts") < low, 0).when(F.col("ts") < high, 1).otherwise(2)
    for number in range(3):
        part = events.where(slice_of == number).repartition(FILES_PER_SLICE)
        topic.write_batch(part, "feed", number)
    return topic


def event_topic(spark: SparkSession, folder: str) -> Topic:
    """All events, appended in three time slices of two files each. Reading two files per
    trigger gives micro-batches in event-time order."""
    return _event_topic(spark.sparkContext.applicationId, folder)
