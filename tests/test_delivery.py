"""Replicas of a group, records per period, directory changes, key lists valid for a batch."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators.reference import stored_key_list
from millrace.session import scratch
from millrace.sources.replicas import Replica
from millrace.sources.topics import Group, Topic
from millrace.sources.watch import change_schema, changes_at, list_files, watch_stream, write_changes
from millrace.streaming import rated, stateful

SHAPE = "k string, id long"


class Crash(Exception):
    pass


@pytest.fixture
def source(spark):
    return Topic(scratch(spark, "source"), spark.createDataFrame([], SHAPE).schema, key="k", partitions=4)


def feed(spark, topic, numbers, name):
    """A third of the records share a key; some have none."""
    data = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 11}", i) for i in numbers]
    topic.write_batch(spark.createDataFrame(data, SHAPE), "feed", name)


def ids(df):
    return sorted(r.id for r in df.collect())


def crash_on(monkeypatch, producer, when, before=False):
    """Let the write with this number, from 0, of a producer crash once."""
    real, seen, turn = Topic.write_batch, [], threading.Lock()

    def write(self, df, by, batch_id):
        if not by.startswith(producer):
            return real(self, df, by, batch_id)
        with turn:
            crashing = len(seen) == when
            seen.append(batch_id)
        if not (before and crashing):
            real(self, df, by, batch_id)
        if crashing:
            raise Crash("lost")

    monkeypatch.setattr(Topic, "write_batch", write)
    return seen


# -- replicas ------------------------------------------------------------------------------


def consume(spark, source, out, group, members, only=None):
    queries = []
    for number in range(members) if only is None else only:
        marked = lambda s, n=number: s.withColumn("member", F.lit(n))
        queries += Replica(group, number, members).write_stream(spark, source, marked, out)
    for query in queries:
        query.awaitTermination()


def marked_topic(spark):
    return Topic(scratch(spark, "out"), spark.createDataFrame([], f"{SHAPE}, member int").schema)


def test_members_divide_partitions(spark, source):
    group = Group("/g", "a", "s", "in")
    for members in (1, 2, 3, 4, 9):
        shares = [p for n in range(members) for p in Replica(group, n, members).partitions(source)]
        assert sorted(shares) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        Replica(group, 2, 2)
    with pytest.raises(ValueError):
        Replica(Group("/g", "a", "s", "in", unique=True), 0, 1)


def test_members_come_and_go(spark, source):
    out, group = marked_topic(spark), Group(scratch(spark, "g"), "app", "stage", "in")
    for step, members in enumerate((1, 3, 2)):
        feed(spark, source, range(step * 60, step * 60 + 60), step)
        consume(spark, source, out, group, members)
        assert ids(out.read(spark)) == list(range(step * 60 + 60))
    spread = out.read(spark).where("id BETWEEN 60 AND 119").groupBy("k").agg(F.count_distinct("member").alias("n"))
    assert {r.n for r in spread.collect()} == {1}


def test_a_lost_member_leaves_its_records_to_the_others(spark, source, monkeypatch):
    out, group = marked_topic(spark), Group(scratch(spark, "g"), "app", "stage", "in")
    feed(spark, source, range(80), 0)
    consume(spark, source, out, group, 2, only=[0])
    part = ids(out.read(spark))
    assert 0 < len(part) < 80
    crash_on(monkeypatch, group.id, 0)
    with pytest.raises(Exception, match="lost"):
        consume(spark, source, out, group, 2, only=[1])
    consume(spark, source, out, group, 1)
    assert ids(out.read(spark)) == list(range(80))


# -- records per period ----------------------------------------------------------------------


class Clock:
    """Time that passes only while one sleeps."""

    def __init__(self):
        self.now, self.slept = 100.0, []

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def published(spark, out):
    number = F.regexp_extract("_metadata.file_path", r"batch_id=([0-9.]+)/", 1)
    counted = out.read(spark).select(number.alias("n")).groupBy("n").count()
    return {r["n"]: r["count"] for r in counted.collect()}


def test_records_per_period(spark, source):
    feed(spark, source, range(100), 0)
    out, clock = Topic(scratch(spark, "out"), source.schema), Clock()
    rated.write_rated(
        source.read_stream(spark), out, scratch(spark, "c"), "p", 30, 2.0, clock=lambda: clock.now, sleep=clock.sleep
    ).awaitTermination()
    assert published(spark, out) == {"0.0": 30, "0.1": 30, "0.2": 30, "0.3": 10}
    assert clock.slept == [2.0, 2.0, 2.0]
    assert ids(out.read(spark)) == list(range(100))


@pytest.mark.parametrize("limit,sizes", [(1, [1] * 5), (5, [5]), (1000, [5])])
def test_limits_at_the_edges(spark, source, limit, sizes):
    feed(spark, source, range(5), 0)
    out = Topic(scratch(spark, "out"), source.schema)
    rated.write_rated(source.read_stream(spark), out, scratch(spark, "c"), "p", limit, 0.0).awaitTermination()
    assert sorted(published(spark, out).values()) == sizes


def test_nothing_to_limit(spark, source):
    out = Topic(scratch(spark, "out"), source.schema)
    rated.write_rated(source.read_stream(spark), out, scratch(spark, "c"), "p", 3, 0.0).awaitTermination()
    assert out.read(spark).count() == 0
    with pytest.raises(ValueError):
        rated.write_rated(source.read_stream(spark), out, scratch(spark, "c"), "p", 0)


def test_rated_write_goes_on_after_a_crash(spark, source, monkeypatch):
    feed(spark, source, range(70), 0)
    out, checkpoint = Topic(scratch(spark, "out"), source.schema), scratch(spark, "c")
    seen = crash_on(monkeypatch, "p", 2)

    def run():
        rated.write_rated(source.read_stream(spark), out, checkpoint, "p", 20, 0.0).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert seen == ["0.0", "0.1", "0.2", "0.0", "0.1", "0.2", "0.3"]
    assert published(spark, out) == {"0.0": 20, "0.1": 20, "0.2": 20, "0.3": 10}
    assert ids(out.read(spark)) == list(range(70))


# -- directory changes -------------------------------------------------------------------------


def put(folder, name, text, at=None):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(text)
    if at:
        os.utime(path, (at, at))


def names(df):
    return sorted((r.kind, r.path.rsplit("/", 1)[1]) for r in df.collect())


def test_created_and_modified_but_not_deleted(spark, folder):
    state = scratch(spark, "looks")
    assert list_files(spark, folder).count() == 0
    assert names(changes_at(spark, folder, state, 0)) == []
    for name in ("same", "longer", "touched", "gone", "sub/deep"):
        put(folder, name, "x", at=1_000_000_000)
    everything = [("created", n) for n in ("deep", "gone", "longer", "same", "touched")]
    assert names(changes_at(spark, folder, state, 1)) == everything
    put(folder, "longer", "xyz", at=1_000_000_000)
    put(folder, "touched", "y", at=1_000_000_500)
    put(folder, "new one", "z")
    put(folder, "empty", "")
    os.remove(os.path.join(folder, "gone"))
    changed = [("created", "new one"), ("modified", "longer"), ("modified", "touched")]
    found = [(kind, name.replace("%20", " ")) for kind, name in names(changes_at(spark, folder, state, 2))]
    assert found == changed
    assert names(changes_at(spark, folder, state, 3)) == []
    put(folder, "gone", "back", at=1_000_000_000)
    put(folder, "empty", "no more")
    assert names(changes_at(spark, folder, state, 4)) == [("created", "empty"), ("created", "gone")]


def test_a_repeated_look_finds_the_same(spark, folder):
    state, out = scratch(spark, "looks"), Topic(scratch(spark, "out"), change_schema())
    put(folder, "a", "1", at=1_000_000_000)
    write_changes(spark, folder, state, 0, out, "w")
    put(folder, "b", "1")
    write_changes(spark, folder, state, 1, out, "w")
    put(folder, "c", "1")
    assert names(changes_at(spark, folder, state, 1)) == [("created", "b")]
    write_changes(spark, folder, state, 1, out, "w")
    write_changes(spark, folder, state, 2, out, "w")
    assert names(out.read(spark)) == [("created", "b"), ("created", "c")]


def test_watching_stream_over_a_restart(spark, folder):
    checkpoint, out = scratch(spark, "c"), Topic(scratch(spark, "out"), change_schema())
    put(folder, "old", "1", at=1_000_000_000)

    def run_until(done):
        query = watch_stream(spark, folder, out, checkpoint, "w", "200 milliseconds")
        try:
            for _ in range(120):
                if done() or query.awaitTermination(0.25):
                    break
        finally:
            query.stop()
        assert query.exception() is None

    looked = lambda: os.path.isdir(f"{checkpoint}/commits") and os.path.exists(f"{checkpoint}/commits/0")
    run_until(looked)
    put(folder, "meanwhile", "1")
    run_until(lambda: out.read(spark).count() >= 1)
    assert names(out.read(spark)) == [("created", "meanwhile")]


# -- key lists -----------------------------------------------------------------------------------


def test_a_replayed_batch_meets_its_own_list(spark, source, folder, monkeypatch):
    out, checkpoint = Topic(scratch(spark, "out"), source.schema), scratch(spark, "c")
    feed(spark, source, range(30), 0)
    put(folder, "list", "hot\nhot\n")
    crash_on(monkeypatch, "p", 0, before=True)

    def run():
        stateful.stream_drop_listed(source.read_stream(spark), "k", folder, out, checkpoint, "p").awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    put(folder, "list", "k1\n")
    run()
    assert ids(out.read(spark)) == [i for i in range(30) if i % 3]
    feed(spark, source, range(30, 60), 1)
    run()
    later = [i for i in range(30, 60) if i % 3 == 0 or i % 7 == 0 or i % 11 != 1]
    assert ids(out.read(spark).where("id >= 30")) == later


def test_stored_list_keeps_its_first_version(spark, folder):
    kept = f"{scratch(spark, 'lists')}/0"
    assert rows(stored_key_list(spark, f"{folder}/absent", f"{kept}-none")) == []
    put(folder, "list", "a\nb\na\n")
    assert rows(stored_key_list(spark, folder, kept)) == [("a",), ("b",)]
    put(folder, "list", "c\n")
    assert rows(stored_key_list(spark, folder, kept)) == [("a",), ("b",)]
