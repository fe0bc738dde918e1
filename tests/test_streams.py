"""Topics, delivery, stateful streams against their batch twins, restart and replay."""

import random
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import routing
from millrace.operators.aggregate import call_stats, count_window, running_mean
from millrace.operators.transforms import merge
from millrace.session import scratch
from millrace.sources import topics
from millrace.sources.topics import Group, KafkaTopic, Topic, drain, write_stream, write_stream_plain
from millrace.streaming import keyed, sinks, stateful

SHAPE = "k string, ts timestamp, id long, v double"


def records(n, seed=1):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.4 else rng.choice("abc"), 60 * i + rng.randrange(60), i, float(rng.randrange(100)))
        for i in range(n)
    ]


def frame(spark, data):
    raw = spark.createDataFrame(data, "k string, at long, id long, v double")
    return raw.select("k", F.timestamp_seconds("at").alias("ts"), "id", "v")


@pytest.fixture
def source(spark):
    return Topic(scratch(spark, "source"), spark.createDataFrame([], SHAPE).schema, key="k")


def feed(spark, topic, data, name):
    topic.write_batch(frame(spark, data).coalesce(1), "feed", name)


def ids(df):
    return sorted(r.id for r in df.collect())


# -- topics ------------------------------------------------------------------------------


def test_empty_topic(spark, source):
    assert source.read(spark).count() == 0
    query = write_stream(source.read_stream(spark), source, scratch(spark, "c"), "p")
    query.awaitTermination()


def test_key_and_partition(spark, source):
    feed(spark, source, records(200), 0)
    feed(spark, source, records(200, seed=2), 1)
    stored = source.read(spark, with_key=True)
    assert stored.where("NOT _key <=> k").count() == 0
    spread = stored.groupBy("_key").agg(F.count_distinct("_partition").alias("n"))
    assert {r.n for r in spread.collect()} == {1}
    plain = Topic(scratch(spark, "plain"), source.schema, partitions=3)
    plain.write(frame(spark, records(30)).coalesce(1))
    dealt = plain.read(spark, with_key=True)
    assert dealt.where("_key IS NOT NULL").count() == 0
    assert sorted(r["count"] for r in dealt.groupBy("_partition").count().collect()) == [10, 10, 10]


def test_group_reads_everything_once_over_restarts(spark, source):
    out = Topic(scratch(spark, "out"), source.schema)
    checkpoint = Group(scratch(spark, "g"), "app", "stage", "in").checkpoint()
    data = records(500)
    for part in range(5):
        feed(spark, source, data[part * 100 : part * 100 + 100], part)
        stream = source.read_stream(spark, max_files_per_trigger=1)
        write_stream(stream, out, checkpoint, "reader").awaitTermination()
        assert ids(out.read(spark)) == list(range((part + 1) * 100))


def test_two_groups_each_see_all(spark, source):
    base, data = scratch(spark, "g"), records(200)
    outs = {}
    feed(spark, source, data[:120], 0)
    for name in ("a", "b"):
        outs[name] = Topic(scratch(spark, name), source.schema)
        checkpoint = Group(base, "app", name, "in").checkpoint()
        write_stream(source.read_stream(spark), outs[name], checkpoint, name).awaitTermination()
        if name == "a":
            feed(spark, source, data[120:], 1)
    assert ids(outs["a"].read(spark)) == list(range(120))
    assert ids(outs["b"].read(spark)) == list(range(200))


def test_group_ids():
    group = Group("/base", "app", "stage", "in")
    assert group.checkpoint() == "/base/groups/app.stage.in" == group.checkpoint()
    unique = Group("/base", "app", "stage", "in", unique=True)
    assert unique.checkpoint() != unique.checkpoint()


def test_latest_and_earliest(spark, source):
    data = records(30)
    feed(spark, source, data[:10], 0)
    time.sleep(0.05)
    latest = source.read_stream(spark, position="latest")
    earliest = source.read_stream(spark)
    time.sleep(0.05)
    feed(spark, source, data[10:], 1)
    for stream, expected in ((latest, range(10, 30)), (earliest, range(30))):
        out = Topic(scratch(spark, "out"), source.schema)
        write_stream_plain(stream, out, scratch(spark, "plain")).awaitTermination()
        assert ids(out.read(spark)) == list(expected)
    with pytest.raises(ValueError):
        source.read_stream(spark, position="middle")


def test_commit_only_sink_advances(spark, source):
    checkpoint = scratch(spark, "drain")
    feed(spark, source, records(20), 0)
    drain(source.read_stream(spark), checkpoint).awaitTermination()
    again = drain(source.read_stream(spark), checkpoint)
    again.awaitTermination()
    assert sum(p["numInputRows"] for p in again.recentProgress) == 0


def test_replayed_batch_leaves_one_copy(spark, source):
    df = frame(spark, records(50))
    source.write_batch(df, "p", 0)
    files = sorted(source.read(spark).inputFiles())
    source.write_batch(df, "p", 0)
    assert sorted(source.read(spark).inputFiles()) == files
    assert ids(source.read(spark)) == list(range(50))


class Crash(Exception):
    pass


def test_crash_between_write_and_commit(spark, source, monkeypatch):
    """The batch is stored, the offsets are not: the replay must not double it."""
    out = Topic(scratch(spark, "out"), source.schema)
    checkpoint = scratch(spark, "c")
    data = records(60)
    for part in range(3):
        feed(spark, source, data[part * 20 : part * 20 + 20], part)
    real, seen = Topic.write_batch, []

    def crash_after_second(self, df, producer, batch_id):
        real(self, df, producer, batch_id)
        seen.append(batch_id)
        if producer == "p" and len(seen) == 2:
            raise Crash("lost")

    monkeypatch.setattr(Topic, "write_batch", crash_after_second)
    with pytest.raises(Exception, match="lost"):
        write_stream(source.read_stream(spark, max_files_per_trigger=1), out, checkpoint, "p").awaitTermination()
    write_stream(source.read_stream(spark, max_files_per_trigger=1), out, checkpoint, "p").awaitTermination()
    assert seen == [0, 1, 1, 2]
    assert ids(out.read(spark)) == list(range(60))


def test_two_outlets_commit_together(spark, source, monkeypatch):
    """A crash after the first outlet: the replay completes the second, doubling nothing."""
    left, right = (Topic(scratch(spark, n), source.schema) for n in ("left", "right"))
    checkpoint = scratch(spark, "c")
    feed(spark, source, records(40), 0)
    feed(spark, source, records(80)[40:], 1)
    real, calls = Topic.write_batch, []

    def crash_once(self, df, producer, batch_id):
        if self is right and not calls:
            calls.append(batch_id)
            raise Crash("lost")
        real(self, df, producer, batch_id)

    monkeypatch.setattr(Topic, "write_batch", crash_once)

    def run():
        stream = source.read_stream(spark, max_files_per_trigger=1)
        divide = lambda batch: routing.split(batch, F.col("v") >= 50)
        sinks.write_two_stream(stream, divide, left, right, checkpoint, "s").awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    a, b = left.read(spark), right.read(spark)
    assert a.where("v >= 50").count() == 0 and b.where("v < 50").count() == 0
    assert sorted(ids(a) + ids(b)) == list(range(80))


def test_files_and_pass_on(spark, source, folder):
    out = Topic(scratch(spark, "out"), source.schema)
    feed(spark, source, records(3), 0)
    stream = source.read_stream(spark)
    sinks.write_files_and_pass(
        stream, "concat('record ', id)", folder, out, scratch(spark, "c"), "p"
    ).awaitTermination()
    assert rows(spark.read.text(f"{folder}/batch_id=0")) == [("record 0",), ("record 1",), ("record 2",)]
    assert ids(out.read(spark)) == [0, 1, 2]


def test_deduplication_within_watermark(spark, source):
    feed(spark, source, records(30), 0)
    source.write_batch(frame(spark, records(30)), "again", 0)
    out = Topic(scratch(spark, "out"), source.schema)
    stream = stateful.stream_deduplicated(source.read_stream(spark), ["id"], "ts", "1 hour")
    write_stream(stream, out, scratch(spark, "c"), "p").awaitTermination()
    assert ids(out.read(spark)) == list(range(30))


def test_stateful_stream_replays_a_stored_batch(spark, source, monkeypatch):
    for part in range(3):
        feed(spark, source, records(60)[part * 20 : part * 20 + 20], part)
        source.write_batch(frame(spark, records(60)[part * 20 : part * 20 + 20]), "again", part)
    out = Topic(scratch(spark, "out"), source.schema)
    checkpoint = scratch(spark, "c")
    real, seen = Topic.write_batch, []

    def crash_after_second(self, df, producer, batch_id):
        real(self, df, producer, batch_id)
        seen.append(batch_id)
        if len(seen) == 2:
            raise Crash("lost")

    monkeypatch.setattr(Topic, "write_batch", crash_after_second)

    def run():
        limited = source.read_stream(spark, max_files_per_trigger=2)
        stream = stateful.stream_deduplicated(limited, ["id"], "ts", "1 hour")
        write_stream(stream, out, checkpoint, "p").awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert ids(out.read(spark)) == list(range(60))


def test_kafka_options_later_win():
    topic = KafkaTopic("t", "h:1", connection=(("a", "1"), ("b", "1")), settings=(("b", "2"),))
    assert topic.options() == {"kafka.bootstrap.servers": "h:1", "kafka.a": "1", "kafka.b": "2"}


# -- state -------------------------------------------------------------------------------

ORDER = ["ts", "id"]
MEANS = "k string, ts timestamp, id long, mean double, records long"


@pytest.mark.parametrize("limit", [10, 10_000])
def test_stream_mean_equals_batch_over_restarts(spark, source, limit):
    data = records(240)
    out = Topic(scratch(spark, "out"), spark.createDataFrame([], MEANS).schema, key="k")
    checkpoint = scratch(spark, "mean")
    for start, stop in ((0, 70), (70, 150), (150, 240)):
        feed(spark, source, data[start:stop], start)
        stream = source.read_stream(spark, max_files_per_trigger=1)
        stateful.stream_running_mean(
            stream, ["k"], ORDER, "v", out, checkpoint, "p", max_rows_per_key=limit
        ).awaitTermination()
    expected = running_mean(frame(spark, data), ["k"], ORDER, "v")
    assert rows(out.read(spark), "k", "id", "mean", "records") == rows(expected, "k", "id", "mean", "records")


def test_stream_mean_survives_crash_in_a_batch(spark, source, monkeypatch):
    """The state of the batch that crashed was written; its replay starts from the state before it."""
    data = records(90)
    for part in range(3):
        feed(spark, source, data[part * 30 : part * 30 + 30], part)
    out = Topic(scratch(spark, "out"), spark.createDataFrame([], MEANS).schema, key="k")
    checkpoint = scratch(spark, "mean")
    real, calls = Topic.write_batch, []

    def crash_once(self, df, producer, batch_id):
        real(self, df, producer, batch_id)
        calls.append(batch_id)
        if calls == [0, 1]:
            raise Crash("lost")

    monkeypatch.setattr(Topic, "write_batch", crash_once)

    def run():
        stream = source.read_stream(spark, max_files_per_trigger=1)
        stateful.stream_running_mean(stream, ["k"], ORDER, "v", out, checkpoint, "p").awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert calls == [0, 1, 1, 2]
    expected = running_mean(frame(spark, data), ["k"], ORDER, "v")
    assert rows(out.read(spark), "k", "id", "mean", "records") == rows(expected, "k", "id", "mean", "records")


@pytest.mark.parametrize("limit", [10, 10_000])
def test_stream_count_window_equals_full_batch_windows(spark, source, limit):
    data = records(200)
    shape = "k string, window long, s double, n long"
    out = Topic(scratch(spark, "out"), spark.createDataFrame([], shape).schema)
    checkpoint = scratch(spark, "windows")
    aggregates = lambda: [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")]
    for start, stop in ((0, 2), (2, 90), (90, 95), (95, 200)):
        feed(spark, source, data[start:stop], start)
        stream = source.read_stream(spark, max_files_per_trigger=1)
        stateful.stream_count_window(
            stream, 5, ["k"], ORDER, aggregates(), out, checkpoint, "p", limit
        ).awaitTermination()
    expected = count_window(frame(spark, data), 5, ORDER, aggregates(), ["k"], keep_partial=False)
    columns = ("k", "window", "s", "n")
    assert rows(out.read(spark), *columns) == rows(expected, *columns)


def test_stream_windows_and_means_without_key(spark, source):
    data = records(130)
    windows = Topic(scratch(spark, "w"), spark.createDataFrame([], "window long, s double").schema)
    means = Topic(scratch(spark, "m"), spark.createDataFrame([], "id long, mean double").schema)
    progress = scratch(spark, "c")
    for start, stop in ((0, 3), (3, 70), (70, 130)):
        feed(spark, source, data[start:stop], start)
        stream = source.read_stream(spark, max_files_per_trigger=1)
        stateful.stream_count_window(
            stream, 8, [], ORDER, [F.sum("v").alias("s")], windows, f"{progress}-w", "p", 20
        ).awaitTermination()
        stateful.stream_running_mean(
            stream, [], ORDER, "v", means, f"{progress}-m", "p", max_rows_per_key=20
        ).awaitTermination()
    df = frame(spark, data)
    full = count_window(df, 8, ORDER, [F.sum("v").alias("s")], keep_partial=False)
    assert rows(windows.read(spark), "window", "s") == rows(full, "window", "s")
    expected = rows(running_mean(df, [], ORDER, "v"), "id", "mean")
    got = rows(means.read(spark), "id", "mean")
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert [m for _, m in got] == pytest.approx([m for _, m in expected])


def test_stream_state_is_kept_by_bucket(spark, source):
    """A micro-batch of many keys calls the processor once a bucket, not once a key."""
    feed(spark, source, [(f"k{i % 3000}", i, i, 1.0) for i in range(6000)], 0)
    told = []

    def each(batch, batch_id):
        batch.persist()
        told.append(batch.where(F.col(keyed.KIND) == keyed.BEFORE).count())
        told.append(flow.divided(batch).before.agg(F.count(F.lit(1)), F.sum(keyed.COUNT)).first())
        batch.unpersist()

    flow = keyed.KeyedFlow(source.read_stream(spark), ["k"], F.col("v"), F.lit(1))
    checkpoint = scratch(spark, "buckets")
    topics.start(flow.flow, each, checkpoint).awaitTermination()
    feed(spark, source, [(f"k{i}", i, i, 1.0) for i in range(2000)], 1)
    flow = keyed.KeyedFlow(source.read_stream(spark), ["k"], F.col("v"), F.lit(1))
    topics.start(flow.flow, each, checkpoint).awaitTermination()
    assert 0 < told[0] <= 1024 and 0 < told[2] <= 1024
    assert tuple(told[1]) == (0, None) and tuple(told[3]) == (2000, 4000)


def test_stream_windows_of_many_and_odd_keys(spark):
    """NULL, zeros of both signs and NaNs are keys, in tuples too; what waits survives batches without its key."""
    odd = [None, 0.0, -0.0, float("nan"), 1.5]
    data = [(None if i % 3 == 0 else f"s{i % 2}", odd[i * 7 % 5], i * 7919 % 101, i, i) for i in range(300)]
    made = spark.createDataFrame(data, "k string, f double, ts long, id long, v long")
    source = Topic(scratch(spark, "odd"), made.schema)
    out = Topic(scratch(spark, "out"), spark.createDataFrame([], "k string, f double, window long, s long, n long").schema)
    checkpoint = scratch(spark, "odd-windows")
    aggregates = lambda: [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")]
    for part, (low, high) in enumerate([(0, 130), (130, 131), (131, 300)]):
        source.write_batch(made.where(F.col("id").between(low, high - 1)).coalesce(1), "feed", part)
    stateful.stream_count_window(
        source.read_stream(spark, max_files_per_trigger=1), 4, ["k", "f"], ["ts", "id"], aggregates(), out, checkpoint, "p"
    ).awaitTermination()
    # Batches come one after the other, so what is in front of an earlier one stays there.
    turn = F.when(F.col("id") < 130, 0).when(F.col("id") < 131, 1).otherwise(2)
    expected = count_window(
        made.withColumn("turn", turn), 4, ["turn", "ts", "id"], aggregates(), ["k", "f"], keep_partial=False
    )
    names = ("k", "f", "window", "s", "n")
    plain = lambda df: rows(df.withColumn("f", (F.col("f") + 0.0).cast("string")), *names)
    assert plain(out.read(spark)) == plain(expected)


def test_state_of_a_key_outlives_its_time_alone():
    """In a bucket every key has its own time."""

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentProcessingTimeInMs(self):
            return self.now

    def told(now, *keys):
        n = len(keys)
        totals = pa.table({"key0": keys, keyed.TOTAL: [1.0] * n, keyed.COUNT: [1] * n})
        records = pa.table({"key0": keys, "k": keys, "id": [now] * n})
        part = pd.DataFrame({keyed.TOTALS: [keyed.packed(totals)], keyed.ROWS: [keyed.packed(records)]})
        made = next(processor.handleInputRows((0,), iter([part]), Clock(now)))
        tables = [made[c][0] and keyed.unpacked(made[c][0]).to_pydict() for c in (keyed.TOTALS, keyed.ROWS)]
        return [t and dict(zip(t.get("key0") or t["k"], t[keyed.COUNT])) for t in tables]

    processor = keyed.KeyTotals(["key0"], ["id"], 3, ttl_ms=100)
    processor.state = State()
    assert told(0, "a", "b") == [None, None]
    assert told(60, "a") == [{"a": 1}, {"a": 1}]
    assert told(120, "a", "b") == [{"a": 2}, {"a": 2}]


def test_stream_call_stats(spark, source):
    data = records(120)
    for part in range(3):
        feed(spark, source, data[part * 40 : part * 40 + 40], part)
    path = scratch(spark, "calls")
    stateful.stream_call_stats(
        source.read_stream(spark, max_files_per_trigger=1), "ts", "v", "7 minutes", "1 minute",
        path, scratch(spark, "c"), keys=["k"],
    ).awaitTermination()
    batch = call_stats(frame(spark, data), "ts", "v", "7 minutes", ["k"])
    newest = frame(spark, data).agg(F.max("ts")).first()[0]
    closed = batch.where(F.col("window_end") <= F.lit(newest) - F.expr("INTERVAL 1 MINUTE"))
    columns = batch.columns
    assert 0 < closed.count() < batch.count()
    assert rows(spark.read.parquet(path), *columns) == rows(closed, *columns)


def test_deny_list_changes_between_batches(spark, source, folder):
    data = records(60)
    out = Topic(scratch(spark, "out"), source.schema)
    checkpoint = scratch(spark, "deny")

    def run():
        stateful.stream_drop_listed(
            source.read_stream(spark), "k", folder, out, checkpoint, "p"
        ).awaitTermination()

    def listed(*keys):
        spark.createDataFrame([(k,) for k in keys], "v string").coalesce(1).write.mode("overwrite").text(folder)

    expected = []
    for part, deny in enumerate([None, ("hot",), ("hot", "a"), ("b",)]):
        slice_ = data[part * 15 : part * 15 + 15]
        if deny:
            listed(*deny)
        feed(spark, source, slice_, part)
        run()
        expected += [i for k, _, i, _ in slice_ if k not in (deny or ())]
    assert ids(out.read(spark)) == expected


# -- applications --------------------------------------------------------------------------


def app():
    from millrace.plans.application import Application, Stage

    def both(inputs, config):
        return {"out": merge(inputs["a"], inputs["b"])}

    def cut(inputs, config):
        low, high = routing.split(inputs["in"], F.col("v") >= config["from"])
        return {"low": low, "high": high}

    return Application(
        "test",
        (
            Stage("merge", both, {"a": "first", "b": "second"}, {"out": "all"}),
            Stage("cut", cut, {"in": "all"}, {"low": "low", "high": "high"}, {"from": 50}),
            Stage("recut", cut, {"in": "high"}, {"low": "mid", "high": "top"}, {"from": 75}),
        ),
    )


def test_application_batch_and_stream_agree(spark, source):
    data = records(120)
    names = ("first", "second", "all", "low", "high", "mid", "top")
    stored = {n: Topic(scratch(spark, n), source.schema, key="k") for n in names}
    base = scratch(spark, "app")
    for start in (0, 60):
        feed(spark, stored["first"], data[start : start + 30], start)
        feed(spark, stored["second"], data[start + 30 : start + 60], start)
        app().run_stream(spark, base, stored)
    inputs = {"first": stored["first"].read(spark), "second": stored["second"].read(spark)}
    batch = app().run_batch(spark, inputs)
    kept = {"all": Topic(scratch(spark, "kept"), source.schema)}
    materialised = app().run_batch(spark, inputs, kept)
    for name in names:
        assert ids(stored[name].read(spark)) == ids(batch[name]) == ids(materialised[name])
    assert ids(stored["mid"].read(spark)) == sorted(i for _, _, i, v in data if 50 <= v < 75)


def test_application_wiring_is_checked(spark):
    from millrace.plans.application import Application, Stage

    def nothing(inputs, config):
        return {}

    with pytest.raises(ValueError, match="unique"):
        Application("x", (Stage("a", nothing), Stage("a", nothing)))
    with pytest.raises(ValueError, match="before"):
        Application("x", (Stage("a", nothing, {"in": "t"}), Stage("b", nothing, {}, {"out": "t"})))
    with pytest.raises(ValueError, match="declared"):
        Application("x", (Stage("a", nothing, {}, {"out": "t"}),)).run_batch(spark, {})
    assert topics.KEY == "_key"
