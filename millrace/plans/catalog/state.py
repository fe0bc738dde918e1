"""Count windows, running state, event-time windows and the deny list."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.aggregate import call_stats, count_window, running_mean
from millrace.operators.reference import drop_listed, read_key_list
from millrace.plans.catalog.registry import (
    FILES_PER_SLICE,
    event_topic,
    query,
    scratch,
    table,
    topic_for,
)
from millrace.sources.topics import Topic
from millrace.streaming.stateful import (
    stream_call_stats,
    stream_count_window,
    stream_drop_listed,
    stream_running_mean,
)

ORDER = ["ts", "event_id"]
RUN = 5

_RUNS = """SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5
    AS "window", event_id, value FROM events"""


def _runs(spark, folder, aggregates):
    events = table(spark, folder, "events").select("user_id", *ORDER, "value")
    return count_window(events, RUN, ORDER, aggregates, ["user_id"])


@query(
    "count_window",
    f"""SELECT user_id, "window", count(*) AS records, min(event_id) AS first_id, max(event_id) AS last_id
        FROM ({_RUNS}) r GROUP BY user_id, "window" """,
)
def count_windows(spark, folder):
    return _runs(
        spark, folder,
        [
            F.count(F.lit(1)).alias("records"),
            F.min("event_id").alias("first_id"),
            F.max("event_id").alias("last_id"),
        ],
    )


@query(
    "count_window_avg",
    f"""SELECT user_id, "window", round(avg(value), 6) AS mean FROM ({_RUNS}) r
        GROUP BY user_id, "window" """,
)
def count_window_avg(spark, folder):
    return _runs(spark, folder, [F.round(F.avg("value"), 6).alias("mean")])


@query(
    "count_window_sum",
    f"""SELECT user_id, "window", round(sum(value), 6) AS total FROM ({_RUNS}) r
        GROUP BY user_id, "window" """,
)
def count_window_sum(spark, folder):
    return _runs(spark, folder, [F.round(F.sum("value"), 6).alias("total")])


@query(
    "count_window_global",
    """SELECT "window", count(*) AS records, max(o_orderkey) AS last_key, min(o_orderdate) AS since
       FROM (SELECT *, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 64 AS "window"
             FROM orders) r
       GROUP BY "window" """,
)
def count_window_global(spark, folder):
    """Runs of 64 over the whole table in date order, without a key."""
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return count_window(
        orders, 64, ["o_orderdate", "o_orderkey"],
        [
            F.count(F.lit(1)).alias("records"),
            F.max("o_orderkey").alias("last_key"),
            F.min("o_orderdate").alias("since"),
        ],
    )


@query(
    "stream_count_window",
    f"""SELECT user_id, "window", count(*) AS records, round(sum(value), 6) AS total,
               max(event_id) AS last_id
        FROM ({_RUNS}) r GROUP BY user_id, "window" HAVING count(*) = 5""",
)
def stream_count_windows(spark, folder):
    """Full runs only: the last short run of a key waits for more records."""
    stream = event_topic(spark, folder).read_stream(spark, max_files_per_trigger=FILES_PER_SLICE)
    out = topic_for(
        spark, spark.createDataFrame([], "user_id long, window long, records long, total double, last_id long"),
        "windows",
    )
    stream_count_window(
        stream.select("user_id", *ORDER, "value"), RUN, ["user_id"], ORDER,
        [
            F.count(F.lit(1)).alias("records"),
            F.round(F.sum("value"), 6).alias("total"),
            F.max("event_id").alias("last_id"),
        ],
        out, scratch(spark, "count-window"), "windows",
    ).awaitTermination()
    return out.read(spark)


_MEANS = """SELECT user_id, event_id, event_type, avg(speed) OVER w AS mean, count(speed) OVER w AS records
    FROM (SELECT *, CAST(round(value) AS INTEGER) AS speed FROM events) e
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


def _speeds(events):
    return events.select("user_id", *ORDER, "event_type", F.round("value").cast("int").alias("speed"))


@query("running_mean_by_key", _MEANS)
def running_mean_by_key(spark, folder):
    speeds = _speeds(table(spark, folder, "events"))
    return running_mean(speeds, ["user_id"], ORDER, "speed", carry=["event_type"]).drop("ts")


@query("stream_running_mean", _MEANS)
def stream_running_means(spark, folder):
    source = event_topic(spark, folder)
    stream = _speeds(source.read_stream(spark, max_files_per_trigger=FILES_PER_SLICE))
    shape = "user_id long, event_id long, event_type string, mean double, records long"
    out = topic_for(spark, spark.createDataFrame([], shape), "means", key="user_id")
    stream_running_mean(
        stream, ["user_id"], ORDER, "speed", out, scratch(spark, "mean"), "mean", ["event_type"]
    ).awaitTermination()
    return out.read(spark)


@query("running_mean_latest", _MEANS.replace("FROM events)", "FROM events WHERE coalesce(value, 50) >= 50)"))
def running_mean_latest(spark, folder):
    """Keyed state over a plain reader: it starts at the end of the topic, its positions and its state
    are thrown away with the run."""
    events = table(spark, folder, "events")
    source = topic_for(spark, events, "sharded", key="user_id")
    early = F.coalesce(F.col("value") < 50, F.lit(False))
    source.write(events.where(early), "before")
    stream = _speeds(source.read_stream(spark, position="latest"))
    source.write(events.where(~early), "after")
    shape = "user_id long, event_id long, event_type string, mean double, records long"
    out = topic_for(spark, spark.createDataFrame([], shape), "means", key="user_id")
    stream_running_mean(
        stream, ["user_id"], ORDER, "speed", out, scratch(spark, "plain"), "mean", ["event_type"]
    ).awaitTermination()
    return out.read(spark)


_CALLS = """SELECT make_timestamp(epoch_us(ts) // 420000000 * 420000000) AS window_start,
        make_timestamp(epoch_us(ts) // 420000000 * 420000000 + 420000000) AS window_end,
        count(*) AS calls, sum(CAST(floor(value) AS BIGINT))::BIGINT AS total_duration,
        avg(CAST(floor(value) AS BIGINT)) AS mean_duration
    FROM events GROUP BY ALL"""


def _calls(events):
    return events.select("ts", F.floor("value").alias("duration"))


@query("call_window_stats", _CALLS)
def call_window_stats(spark, folder):
    return call_stats(_calls(table(spark, folder, "events")), "ts", "duration", "7 minutes")


@query(
    "stream_call_window_stats",
    f"""SELECT * FROM ({_CALLS}) c
        WHERE window_end <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 MINUTE FROM events)""",
)
def stream_call_window_stats(spark, folder):
    """Windows the watermark has closed: those ending a minute before the newest event."""
    source = event_topic(spark, folder)
    stream = _calls(source.read_stream(spark, max_files_per_trigger=FILES_PER_SLICE))
    path, checkpoint = scratch(spark, "calls"), scratch(spark, "calls-progress")
    stream_call_stats(
        stream, "ts", "duration", "7 minutes", "1 minute", path, checkpoint
    ).awaitTermination()
    stats = spark.read.parquet(path)
    return stats.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


_DENIED = """SELECT * FROM events WHERE user_id NOT IN
    (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)"""


def _write_denied(spark, folder):
    events = table(spark, folder, "events")
    path = scratch(spark, "denied")
    denied = events.where("event_type = 'error' AND value > 150").select("user_id").distinct()
    denied.select(F.col("user_id").cast("string")).write.text(path)
    return events, path


@query("denylist_anti_join", _DENIED)
def denylist_anti_join(spark, folder):
    events, path = _write_denied(spark, folder)
    return drop_listed(events, "user_id", read_key_list(spark, path))


@query("stream_denylist", _DENIED)
def stream_denylist(spark, folder):
    _, path = _write_denied(spark, folder)
    source = event_topic(spark, folder)
    out = Topic(scratch(spark, "allowed"), source.schema)
    stream = source.read_stream(spark, max_files_per_trigger=FILES_PER_SLICE)
    stream_drop_listed(
        stream, "user_id", path, out, scratch(spark, "deny"), "deny"
    ).awaitTermination()
    return out.read(spark)
