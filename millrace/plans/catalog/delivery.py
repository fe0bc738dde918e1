"""Reading and writing topics with the three delivery guarantees."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators.transforms import merge
from millrace.plans.application import Application, Stage
from millrace.plans.catalog.registry import (
    FILES_PER_SLICE,
    event_topic,
    loaded_topic,
    query,
    scratch,
    table,
    topic_for,
)
from millrace.session import delete_path, list_folders, move_path
from millrace.sources.landing import bytes_schema, read_bytes
from millrace.sources.replicas import Replica
from millrace.sources.topics import Group, Topic, drain, start, write_stream, write_stream_plain
from millrace.sources.watch import change_schema, write_changes
from millrace.streaming.rated import write_rated
from millrace.streaming.sinks import write_files_and_pass, write_two_stream
from millrace.streaming.stateful import stream_deduplicated

EVENTS = "SELECT * FROM events"


@query("topic_read_committed", EVENTS)
def topic_read_committed(spark, folder):
    """A consumer that stops after the first batches and resumes from its checkpoint."""
    events = table(spark, folder, "events")
    source = topic_for(spark, events, "source", key="user_id")
    out = topic_for(spark, events, "copy", key="user_id")
    checkpoint = Group(scratch(spark, "groups"), "copy", "reader", "in").checkpoint()
    early = F.coalesce(F.col("value") < 50, F.lit(False))
    for producer, part in (("early", early), ("late", ~early)):
        source.write(events.where(part), producer)
        stream = source.read_stream(spark, max_files_per_trigger=4)
        write_stream(stream, out, checkpoint, "reader").awaitTermination()
    return out.read(spark)


@query("topic_read_latest", "SELECT * FROM events WHERE coalesce(value, 50) >= 50")
def topic_read_latest(spark, folder):
    """A reader that starts on a filled topic and sees only what is written afterwards."""
    events = table(spark, folder, "events")
    source, out = topic_for(spark, events, "source"), topic_for(spark, events, "latest")
    early = F.coalesce(F.col("value") < 50, F.lit(False))
    source.write(events.where(early), "before")
    stream = source.read_stream(spark, position="latest")
    source.write(events.where(~early), "after")
    write_stream_plain(stream, out, scratch(spark, "plain")).awaitTermination()
    return out.read(spark)


@query("drain_and_resume", "SELECT * FROM events WHERE coalesce(value, 50) >= 50")
def drain_and_resume(spark, folder):
    """A commit-only consumer passes over what is there; its successor sees only what follows."""
    events = table(spark, folder, "events")
    source, out = topic_for(spark, events, "source"), topic_for(spark, events, "resumed")
    checkpoint = Group(scratch(spark, "groups"), "drain", "reader", "in").checkpoint()
    early = F.coalesce(F.col("value") < 50, F.lit(False))
    source.write(events.where(early), "early")
    drain(source.read_stream(spark), checkpoint).awaitTermination()
    source.write(events.where(~early), "late")
    write_stream(source.read_stream(spark), out, checkpoint, "reader").awaitTermination()
    return out.read(spark)


@query("files_and_pass", "SELECT event_id, 'file' AS place FROM events UNION ALL SELECT event_id, 'topic' FROM events")
def files_and_pass(spark, folder):
    """Every record as a line of a file and onward in a topic."""
    source = loaded_topic(spark, folder, "events")
    lines, onward = scratch(spark, "mount"), Topic(scratch(spark, "onward"), source.schema)
    stream = source.read_stream(spark, max_files_per_trigger=4)
    write_files_and_pass(
        stream, "cast(event_id as string)", lines, onward, scratch(spark, "writer"), "writer"
    ).awaitTermination()
    written = spark.read.option("recursiveFileLookup", "true").text(lines)
    return written.select(F.col("value").cast("long").alias("event_id"), F.lit("file").alias("place")).unionByName(
        onward.read(spark).select("event_id", F.lit("topic").alias("place"))
    )


@query(
    "exploded_write_unit",
    """SELECT event_id, 'digit' AS side, CAST(c AS VARCHAR) AS part FROM (SELECT event_id, unnest(string_split(CAST(event_id AS VARCHAR), '')) AS c FROM events)
       UNION ALL SELECT event_id, 'word', unnest(string_split(event_type, '_')) FROM events""",
)
def exploded_write_unit(spark, folder):
    """Each record becomes several messages on two topics, written under one commit."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    source = topic_for(spark, events, "source")
    source.write(events)
    shape = spark.createDataFrame([], "event_id long, part string")
    sides = {name: topic_for(spark, shape, name) for name in ("digit", "word")}

    def divide(batch):
        digits = F.explode(F.split(F.col("event_id").cast("string"), ""))
        words = F.explode(F.split("event_type", "_"))
        return batch.select("event_id", digits.alias("part")), batch.select("event_id", words.alias("part"))

    write_two_stream(
        source.read_stream(spark), divide, sides["digit"], sides["word"], scratch(spark, "unit"), "unit"
    ).awaitTermination()
    return merge(*[t.read(spark).select("event_id", F.lit(n).alias("side"), "part") for n, t in sides.items()])


@query("topic_read_earliest", f"{EVENTS} UNION ALL {EVENTS}")
def topic_read_earliest(spark, folder):
    """A plain reader restarted once: each start reads everything again."""
    source = loaded_topic(spark, folder, "events")
    out = Topic(scratch(spark, "earliest"), source.schema)
    for _ in range(2):
        stream = source.read_stream(spark)
        write_stream_plain(stream, out, scratch(spark, "plain")).awaitTermination()
    return out.read(spark)


@query("topic_write_committed", "SELECT *, CAST(user_id AS VARCHAR) AS _key FROM events")
def topic_write_committed(spark, folder):
    source = loaded_topic(spark, folder, "events")
    out = Topic(scratch(spark, "committed"), source.schema, key="user_id")
    stream = source.read_stream(spark, max_files_per_trigger=3)
    write_stream(stream, out, scratch(spark, "writer"), "writer").awaitTermination()
    return out.read(spark, with_key=True).drop("_partition")


@query("topic_write_plain", EVENTS)
def topic_write_plain(spark, folder):
    events = table(spark, folder, "events")
    out = topic_for(spark, events, "plain")
    out.write(events)
    return out.read(spark)


@query(
    "consumer_groups",
    "SELECT consumer, event_id, user_id FROM events, (VALUES ('first'), ('second')) v(consumer)",
)
def consumer_groups(spark, folder):
    """Two stages read one topic as it grows, each from its own position."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    source = topic_for(spark, events, "source")
    base = scratch(spark, "groups")
    outs = {name: topic_for(spark, events, name) for name in ("first", "second")}

    def consume(name):
        checkpoint = Group(base, "app", name, "in").checkpoint()
        write_stream(source.read_stream(spark), outs[name], checkpoint, name).awaitTermination()

    first_part = F.coalesce(F.col("user_id") < 40, F.lit(False))
    source.write(events.where(first_part), "one")
    consume("first")
    source.write(events.where(~first_part), "two")
    consume("second")
    consume("first")
    return merge(*[o.read(spark).select(F.lit(n).alias("consumer"), "*") for n, o in outs.items()])


@query(
    "broadcast_read",
    "SELECT instance, event_id FROM events, (VALUES (0), (1)) v(instance)",
)
def broadcast_read(spark, folder):
    """Two instances of one stage with unique groups: both see all records."""
    source = loaded_topic(spark, folder, "events")
    group = Group(scratch(spark, "unique"), "app", "stage", "in", unique=True)
    frames = []
    for instance in range(2):
        stream = source.read_stream(spark).select("event_id")
        out = topic_for(spark, stream, f"instance-{instance}")
        write_stream(stream, out, group.checkpoint(), "instance").awaitTermination()
        frames.append(out.read(spark).select(F.lit(instance).alias("instance"), "event_id"))
    return merge(*frames)


@query(
    "replicas_share_group",
    """SELECT event_id, user_id, CASE WHEN value < 50 THEN 2 ELSE 1 END::BIGINT AS members FROM events""",
)
def replicas_share_group(spark, folder):
    """Two replicas of a stage divide the first records; one leaves and the other reads what follows, of
    all partitions. With every record: how many replicas took part."""
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    source = topic_for(spark, events, "shared", key="user_id")
    group = Group(scratch(spark, "groups"), "app", "stage", "in")
    out = Topic(scratch(spark, "read"), events.withColumns({"member": F.lit(0), "early": F.lit(True)}).schema)
    early = F.coalesce(F.col("value") < 50, F.lit(False))

    def consume(members):
        replicas = [Replica(group, number, members) for number in range(members)]
        running = []
        for replica in replicas:
            mark = {"member": F.lit(replica.number), "early": early}
            running += replica.write_stream(spark, source, lambda s, mark=mark: s.withColumns(mark), out)
        for stream in running:
            stream.awaitTermination()

    for part, members in ((early, 2), (~early, 1)):
        source.write(events.where(part))
        consume(members)
    read = out.read(spark)
    took_part = read.groupBy("early").agg(F.count_distinct("member").alias("members"))
    return read.join(F.broadcast(took_part), "early").select("event_id", "user_id", "members")


@query(
    "records_per_period",
    """SELECT i AS slice, least(n // 7 + 1, n - i * (n // 7 + 1)) AS records,
              least(n // 7 + 1, n - i * (n // 7 + 1)) AS different
       FROM (SELECT count(*) AS n FROM events), range(7) r(i) WHERE i * (n // 7 + 1) < n""",
)
def records_per_period(spark, folder):
    """A limit of records per period; each period's records are one published batch."""
    source = loaded_topic(spark, folder, "events")
    out = Topic(scratch(spark, "rated"), source.schema)
    limit = table(spark, folder, "events").count() // 7 + 1
    write_rated(
        source.read_stream(spark), out, scratch(spark, "rater"), "rater", limit, period=0.1
    ).awaitTermination()
    slice_of = F.regexp_extract("_metadata.file_path", r"batch_id=\d+\.(\d+)/", 1).cast("long")
    numbered = out.read(spark).select(slice_of.alias("slice"), "event_id")
    return numbered.groupBy("slice").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("event_id").alias("different")
    )


@query(
    "directory_changes",
    """WITH kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i, count(*) OVER () AS n
                      FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))
       SELECT CASE WHEN i = 2 THEN 'modified' ELSE 'created' END AS kind, event_type
       FROM kinds WHERE i = 2 OR i = n""",
)
def directory_changes(spark, folder):
    """One file per event type: the first is deleted, the second written anew, the last one created."""
    events = table(spark, folder, "events").where("event_type IS NOT NULL")
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).cast("string").alias("value"))
    watched, fresh, state = (scratch(spark, n) for n in ("watched", "fresh", "looks"))
    out = Topic(scratch(spark, "changes"), change_schema())
    counts.write.partitionBy("event_type").text(watched)
    counts.withColumn("value", F.concat("value", F.lit(" again"))).write.partitionBy("event_type").text(fresh)
    kinds = sorted(f.rsplit("/", 1)[1] for f in list_folders(spark, f"{watched}/event_type=*"))
    last = f"{watched}/{kinds[-1]}"
    delete_path(spark, last)
    write_changes(spark, watched, state, 0, out, "watch")
    delete_path(spark, f"{watched}/{kinds[0]}")
    (old,) = list_folders(spark, f"{watched}/{kinds[1]}/part-*")
    (new,) = list_folders(spark, f"{fresh}/{kinds[1]}/part-*")
    delete_path(spark, old)
    move_path(spark, new, old)
    move_path(spark, f"{fresh}/{kinds[-1]}", last)
    write_changes(spark, watched, state, 1, out, "watch")
    return out.read(spark).select("kind", F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("event_type"))


@query("supervised_stages", "SELECT *, value >= 50 AS high FROM events WHERE value IS NOT NULL")
def supervised_stages(spark, folder):
    """Two stages of which the second fails once, in its second micro-batch; the restart goes on from there."""
    source = loaded_topic(spark, folder, "events")
    marked = table(spark, folder, "events").withColumn("high", F.lit(True))
    calls = []

    def present(inputs, config):
        return {"out": inputs["in"].where("value IS NOT NULL")}

    def mark(inputs, config):
        calls.append(None)
        if len(calls) == 2:
            raise RuntimeError("lost once")
        return {"out": inputs["in"].withColumn("high", F.col("value") >= 50)}

    stages = (
        Stage("present", present, {"in": "events"}, {"out": "present"}),
        Stage("mark", mark, {"in": "present"}, {"out": "marked"}),
    )
    topics = {
        "events": source,
        "present": Topic(scratch(spark, "present"), source.schema),
        "marked": topic_for(spark, marked, "marked"),
    }
    application = Application("supervised", stages)
    application.run_stream(spark, scratch(spark, "application"), topics, max_files_per_trigger=4, restarts=2)
    return topics["marked"].read(spark)


@query("idempotent_replay", EVENTS)
def idempotent_replay(spark, folder):
    """Every micro-batch is delivered twice; the topic holds each record once."""
    source = loaded_topic(spark, folder, "events")
    out = Topic(scratch(spark, "replayed"), source.schema, key="user_id")

    def deliver_twice(batch, batch_id):
        out.write_batch(batch, "replayer", batch_id)
        out.write_batch(batch, "replayer", batch_id)

    stream = source.read_stream(spark, max_files_per_trigger=3)
    start(stream, deliver_twice, scratch(spark, "replayer")).awaitTermination()
    return out.read(spark)


@query("stream_deduplicate", EVENTS)
def stream_deduplicate(spark, folder):
    """A topic with every record written twice, cleaned by record id within a watermark."""
    events = table(spark, folder, "events")
    source, out = topic_for(spark, events, "doubled"), topic_for(spark, events, "cleaned")
    for producer in ("once", "again"):
        source.write(events, producer)
    stream = stream_deduplicated(source.read_stream(spark), ["event_id"], "ts", "1 hour")
    write_stream(stream, out, scratch(spark, "dedup"), "dedup").awaitTermination()
    return out.read(spark)


@query("rate_limited_read", EVENTS)
def rate_limited_read(spark, folder):
    """A bounded number of files per micro-batch."""
    source = event_topic(spark, folder)
    out = Topic(scratch(spark, "limited"), source.schema)
    stream = source.read_stream(spark, max_files_per_trigger=FILES_PER_SLICE)
    write_stream(stream, out, scratch(spark, "limiter"), "limiter").awaitTermination()
    return out.read(spark)


@query("external_bytes", "SELECT event_id, props FROM events")
def external_bytes(spark, folder):
    """Records stored as bare bytes, decoded by the reader and not by the topic."""
    events = table(spark, folder, "events")
    text = F.concat_ws("|", F.col("event_id").cast("string"), F.col("props"))
    topic = Topic(scratch(spark, "bytes"), bytes_schema())
    topic.write(events.select(scalars.key_bytes(text).alias("value")))
    value = F.decode("value", "UTF-8")
    return read_bytes(spark, topic.path).select(
        F.substring_index(value, "|", 1).cast("long").alias("event_id"),
        F.regexp_extract(value, r"(?s)^[^|]*\|(.*)\z", 1).alias("props"),
    )


@query(
    "keyed_partition",
    """SELECT CAST(o_custkey AS VARCHAR) AS _key, count(*) AS records, 1::BIGINT AS partitions
       FROM orders GROUP BY o_custkey""",
)
def keyed_partition(spark, folder):
    """Per key: how many records a keyed topic holds and over how many partitions."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    topic = topic_for(spark, orders, "keyed", key="o_custkey")
    topic.write(orders)
    placed = topic.read(spark, with_key=True)
    per_place = placed.groupBy("_key", "_partition").agg(F.count(F.lit(1)).alias("n"))
    return per_place.groupBy("_key").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("partitions")
    )


@query(
    "round_robin_partition",
    "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS _key FROM orders",
)
def round_robin_partition(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    topic = topic_for(spark, orders, "dealt")
    topic.write(orders)
    return topic.read(spark, with_key=True).drop("_partition")
