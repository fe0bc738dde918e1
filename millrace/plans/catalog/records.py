"""Projection, filter, flat-map, routing and merge."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.operators import routing, transforms
from millrace.operators.quality import validate_measurements
from millrace.plans.catalog.registry import (
    loaded_topic,
    query,
    scratch,
    table,
    topic_for,
)
from millrace.plans.turbines import turbine_application
from millrace.sources.topics import Group, Topic, write_stream
from millrace.streaming.sinks import write_two_stream

LINE_MEASURES = {
    "ids": ("l_orderkey", "l_linenumber", "l_partkey"),
    "measures": {
        "quantity": "l_quantity",
        "extendedprice": "l_extendedprice",
        "discount": "l_discount",
    },
}
_UNPIVOT_SQL = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, '{name}' AS name, {column} AS value FROM lineitem"
    for name, column in LINE_MEASURES["measures"].items()
)


@query(
    "sensor_flow",
    f"SELECT * FROM ({_UNPIVOT_SQL}) m WHERE value >= 0 AND NOT isnan(value)",
)
def sensor_flow(spark, folder):
    application = turbine_application(LINE_MEASURES)
    topics = application.run_batch(spark, {"sensor-data": table(spark, folder, "lineitem")})
    return topics["valid-metrics"]


BALANCES = {"ids": ("c_custkey",), "measures": {"balance": "c_acctbal", "nation": "c_nationkey"}}
_CHECKED_SQL = " UNION ALL ".join(
    f"""SELECT c_custkey, '{name}' AS name, {column}::DOUBLE AS value,
        CASE WHEN {column} >= 0 THEN 'valid' ELSE 'invalid' END AS outlet FROM customer"""
    for name, column in BALANCES["measures"].items()
)


def _outlets(valid, invalid):
    columns = ["c_custkey", "name", "value"]
    return valid.select(*columns, F.lit("valid").alias("outlet")).unionByName(
        invalid.select(*[F.col(f"metric.{c}").alias(c) for c in columns], F.lit("invalid").alias("outlet"))
    )


def _signed_measures(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("long").alias("c_custkey"),
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("c_nationkey"),
    )


@query("sensor_flow_checked", _CHECKED_SQL)
def sensor_flow_checked(spark, folder):
    """The flow over a table with negative values: both outlets."""
    topics = turbine_application(BALANCES).run_batch(spark, {"sensor-data": _signed_measures(spark, folder)})
    return _outlets(topics["valid-metrics"], topics["invalid-metrics"])


@query("pipeline_sensor", _CHECKED_SQL)
def pipeline_sensor(spark, folder):
    """The same as streams: every stage a query of its own, both outlets topics."""
    balances = _signed_measures(spark, folder)
    batch = turbine_application(BALANCES).run_batch(spark, {"sensor-data": balances})
    topics = {name: topic_for(spark, frame, name) for name, frame in batch.items()}
    topics["sensor-data"].write(balances)
    turbine_application(BALANCES).run_stream(spark, scratch(spark, "application"), topics)
    return _outlets(topics["valid-metrics"].read(spark), topics["invalid-metrics"].read(spark))


@query("unpivot_metrics", _UNPIVOT_SQL)
def unpivot_metrics(spark, folder):
    return transforms.unpivot(table(spark, folder, "lineitem"), **LINE_MEASURES)


@query("filter_name", "SELECT * FROM events WHERE event_type = 'error'")
def filter_name(spark, folder):
    return table(spark, folder, "events").where(F.col("event_type") == "error")


# Keeping even ids is the operator of the original example, applied to the whole table.
@query("filter_even", "SELECT * FROM events WHERE event_id % 2 = 0")
def filter_even(spark, folder):
    return table(spark, folder, "events").where(F.col("event_id") % 2 == 0)


@query("filter_by_config", "SELECT * FROM events WHERE event_type = 'purchase'")
def filter_by_config(spark, folder):
    return transforms.keep_equal(table(spark, folder, "events"), "event_type", "purchase")


@query(
    "map_project",
    "SELECT event_id AS id, user_id AS device, ts AS at, event_type AS name, value AS reading FROM events",
)
def map_project(spark, folder):
    return transforms.project(
        table(spark, folder, "events"),
        id="event_id", device="user_id", at="ts", name="event_type", reading="value",
    )


@query(
    "map_override",
    "SELECT o_orderkey, o_orderstatus || '-seen' AS o_orderstatus, 'hello' AS o_orderpriority FROM orders",
)
def map_override(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return transforms.override(orders, {"o_orderstatus": "-seen"}, {"o_orderpriority": "hello"})


@query(
    "render_log_lines",
    """SELECT c_name || chr(10) || chr(10) || c_mktsegment AS document,
              c_custkey || ' -> ' || c_name AS pair,
              'valid: {"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS line
       FROM customer""",
)
def render_log_lines(spark, folder):
    return table(spark, folder, "customer").select(
        transforms.as_document(F.col("c_name"), F.col("c_mktsegment")).alias("document"),
        transforms.as_pair(F.col("c_custkey"), F.col("c_name")).alias("pair"),
        transforms.as_log_line("valid: ", ["c_custkey", "c_name"]).alias("line"),
    )


def _describe(record):
    return f"{record['p_name'].upper()}/{record['p_size'] * 2}"


@query("async_enrich", "SELECT p_partkey, upper(p_name) || '/' || (p_size * 2) AS described FROM part")
def async_enrich(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return transforms.call_per_record(
        part, _describe, "described", StringType(), ["p_name", "p_size"]
    ).select("p_partkey", "described")


def _balances(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))


@query(
    "metrics_valid",
    "SELECT c_custkey, c_acctbal AS value FROM customer WHERE c_acctbal >= 0 AND NOT isnan(c_acctbal)",
)
def metrics_valid(spark, folder):
    return validate_measurements(_balances(spark, folder))[0]


@query(
    "metrics_invalid",
    """SELECT c_custkey, c_acctbal AS value, 'All measurements must be positive numbers!' AS error
       FROM customer WHERE NOT coalesce(c_acctbal >= 0 AND NOT isnan(c_acctbal), false)""",
)
def metrics_invalid(spark, folder):
    invalid = validate_measurements(_balances(spark, folder))[1]
    return invalid.select("metric.c_custkey", "metric.value", "error")


def _orders_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return routing.split(orders, F.col("o_totalprice") > 250000)


@query(
    "split_left",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
       WHERE NOT coalesce(o_totalprice > 250000, false)""",
)
def split_left(spark, folder):
    return _orders_split(spark, folder)[0]


@query(
    "split_right",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 250000",
)
def split_right(spark, folder):
    return _orders_split(spark, folder)[1]


@query(
    "split_two_sinks",
    """SELECT CASE WHEN o_totalprice > 250000 THEN 'right' ELSE 'left' END AS outlet,
              o_orderkey, o_totalprice FROM orders""",
)
def split_two_sinks(spark, folder):
    orders = loaded_topic(spark, folder, "orders")
    stream = orders.read_stream(spark, max_files_per_trigger=3).select("o_orderkey", "o_totalprice")
    left, right = (topic_for(spark, stream, side) for side in ("left", "right"))
    write_two_stream(
        stream,
        lambda batch: routing.split(batch, F.col("o_totalprice") > 250000),
        left, right, scratch(spark, "split"), "splitter",
    ).awaitTermination()
    return transforms.merge(
        left.read(spark).select(F.lit("left").alias("outlet"), "*"),
        right.read(spark).select(F.lit("right").alias("outlet"), "*"),
    )


@query(
    "either_map_right",
    """SELECT event_id, CASE WHEN NOT coalesce(value >= 50, false) THEN event_type END AS left_side,
              CASE WHEN value >= 50 THEN value * 2 END AS right_side FROM events""",
)
def either_map_right(spark, folder):
    events = table(spark, folder, "events")
    side = routing.either(F.col("value") >= 50, F.col("event_type"), F.col("value"))
    doubled = events.select("event_id", routing.map_right(side, lambda v: v * 2).alias("e"))
    return doubled.select("event_id", F.col("e.left").alias("left_side"), F.col("e.right").alias("right_side"))


def _multi(spark, folder):
    final = F.when(F.col("o_orderstatus") == "F", F.array("o_custkey", "o_orderkey"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        routing.multi(F.split("o_orderpriority", "-"), final).alias("out"),
    )


@query(
    "multi_out_1",
    "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS record FROM orders",
)
def multi_out_1(spark, folder):
    return routing.outlets(_multi(spark, folder), "out")[0]


@query(
    "multi_out_2",
    "SELECT o_orderkey, unnest([o_custkey, o_orderkey]) AS record FROM orders WHERE o_orderstatus = 'F'",
)
def multi_out_2(spark, folder):
    return routing.outlets(_multi(spark, folder), "out")[1]


def _parties(spark, folder):
    """Customers, suppliers and nations as records of one type."""
    sources = (("customer", "c"), ("supplier", "s"))
    parties = [
        table(spark, folder, name).select(
            F.col(f"{p}_name").alias("name"),
            F.col(f"{p}_nationkey").alias("nationkey"),
            F.col(f"{p}_acctbal").alias("acctbal"),
        )
        for name, p in sources
    ]
    nation = table(spark, folder, "nation").select(
        F.col("n_name").alias("name"),
        F.col("n_nationkey").alias("nationkey"),
        F.lit(None).cast("double").alias("acctbal"),
    )
    return [*parties, nation]


_PARTIES_SQL = """SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier
    UNION ALL SELECT n_name, n_nationkey, CAST(NULL AS DOUBLE) FROM nation"""


@query("merge_n", _PARTIES_SQL)
def merge_n(spark, folder):
    return transforms.merge(*_parties(spark, folder))


@query("merge_via_topic", _PARTIES_SQL)
def merge_via_topic(spark, folder):
    parties = _parties(spark, folder)
    shared = topic_for(spark, parties[0], "parties", key="name")
    for number, frame in enumerate(parties):
        shared.write(frame, f"producer-{number}")
    return shared.read(spark)


@query(
    "fan_out",
    "SELECT consumer, o_orderkey, o_custkey FROM orders, (VALUES ('a'), ('b'), ('c')) v(consumer)",
)
def fan_out(spark, folder):
    source = loaded_topic(spark, folder, "orders")
    base = scratch(spark, "fan-out")
    outputs, running = [], []
    for name in ("a", "b", "c"):
        stream = source.read_stream(spark).select("o_orderkey", "o_custkey")
        out = Topic(f"{base}/{name}", stream.schema)
        outputs.append((name, out))
        checkpoint = Group(base, "fan", name, "in").checkpoint()
        running.append(write_stream(stream, out, checkpoint, name))
    for consumer in running:
        consumer.awaitTermination()
    return transforms.merge(
        *[out.read(spark).select(F.lit(name).alias("consumer"), "*") for name, out in outputs]
    )
