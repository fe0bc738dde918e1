"""Stages that fail: restarts from the checkpoint, and an end for all when one fails too often."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.application import Application, Stage
from millrace.session import scratch
from millrace.sources.topics import Topic
from millrace.streaming.supervise import StageFailed, Supervisor


class Query:
    """Stands for a streaming query that is told how it goes on."""

    def __init__(self, error=None, active=True):
        self.error, self.isActive, self.stopped = error, active, False

    def exception(self):
        return self.error

    def stop(self):
        self.stopped, self.isActive = True, False

    def end(self, error=None):
        self.error, self.isActive = error, False


def test_pauses_grow_and_others_run_on():
    now, started = [0.0], {"a": [], "b": []}

    def begin(name):
        started[name].append(Query())
        return started[name][-1]

    made = Supervisor({n: lambda n=n: begin(n) for n in "ab"}, restarts=2, pause=1.0, clock=lambda: now[0])
    assert made.check() and len(started["a"]) == len(started["b"]) == 1
    for wait in (1.0, 2.0):
        started["a"][-1].end(ValueError("bad"))
        before = len(started["a"])
        made.check()
        now[0] += wait - 0.1
        made.check()
        assert len(started["a"]) == before
        now[0] += 0.2
        made.check()
        assert len(started["a"]) == before + 1
    started["a"][-1].end(ValueError("bad"))
    with pytest.raises(StageFailed, match="a failed 3 times: bad") as failed:
        made.check()
    assert failed.value.stage == "a"
    assert len(started["b"]) == 1 and started["b"][0].stopped
    assert not made.check()


def test_all_finished():
    queries = {"a": Query(active=False), "b": Query()}
    made = Supervisor({n: lambda n=n: queries[n] for n in queries})
    assert made.check() and made.check()
    queries["b"].end()
    assert not made.check()
    assert made.run() == queries and not made.failures
    assert not Supervisor({}).check()


def application(fail_on, calls):
    def double(inputs, config):
        return {"out": inputs["in"].withColumn("v", F.col("v") * 2)}

    def shift(inputs, config):
        calls.append(None)
        if len(calls) in fail_on:
            raise RuntimeError("lost")
        return {"out": inputs["in"].withColumn("v", F.col("v") + 1)}

    return Application(
        "app", (Stage("double", double, {"in": "raw"}, {"out": "mid"}), Stage("shift", shift, {"in": "mid"}, {"out": "end"}))
    )


@pytest.fixture
def topics(spark):
    shape = spark.createDataFrame([], "v long").schema
    made = {n: Topic(scratch(spark, n), shape) for n in ("raw", "mid", "end")}
    for part in range(3):
        made["raw"].write_batch(spark.range(part * 20, part * 20 + 20).toDF("v").coalesce(1), "feed", part)
    return made


def values(spark, topic):
    return sorted(r.v for r in topic.read(spark).collect())


def test_a_stage_that_fails_once_ends_with_complete_output(spark, topics):
    app, base = application({2}, calls := []), scratch(spark, "app")
    app.run_stream(spark, base, topics, max_files_per_trigger=1, restarts=1)
    assert values(spark, topics["end"]) == [2 * v + 1 for v in range(60)]
    assert len(calls) == 4


def test_side_by_side_until_caught_up(spark, topics):
    app, base = application({1, 3}, []), scratch(spark, "app")
    now = {"availableNow": True}
    for _ in range(2):  # consumers may have started before their producers had written
        made = app.supervised(spark, base, topics, 1, now, restarts=2, pause=0.1)
        made.run()
    assert values(spark, topics["end"]) == [2 * v + 1 for v in range(60)]


def test_too_many_failures_stop_the_rest_and_lose_nothing(spark, topics):
    base, endless = scratch(spark, "app"), {"processingTime": "100 milliseconds"}
    made = application(range(1, 100), []).supervised(spark, base, topics, 1, endless, restarts=2, pause=0.1)
    with pytest.raises(StageFailed, match="shift failed 3 times"):
        made.run()
    assert not any(q.isActive for q in made.queries.values())
    application((), []).run_stream(spark, base, topics)
    assert values(spark, topics["end"]) == [2 * v + 1 for v in range(60)]
