"""Input that is late, old, damaged or skewed: nothing is lost and nothing comes twice."""

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import quality, transforms
from millrace.operators.aggregate import running_mean
from millrace.operators.ordered import running_totals
from millrace.operators.scoring import score
from millrace.session import clear_scratch, list_folders, scratch, scratch_scope, workspace
from millrace.sources import landing
from millrace.sources.topics import Topic, write_stream
from millrace.streaming import sinks, stateful

ID = "id long"


def schema(spark, text=ID):
    return spark.createDataFrame([], text).schema


def numbers(spark, low, high):
    return spark.range(low, high).select("id")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_old_files_are_taken(spark, folder):
    """A file that lands after a newer one was seen, with a time stamp far back."""
    os.makedirs(folder)
    out, checkpoint = Topic(scratch(spark, "old"), schema(spark)), scratch(spark, "old-groups")

    def ingest():
        landing.ingest_json_stream(
            spark, folder, schema(spark), lambda r, n: out.write_batch(r, "p", n), checkpoint
        ).awaitTermination()

    with open(f"{folder}/new.json", "w") as f:
        f.write('{"id":1}')
    ingest()
    with open(f"{folder}/old.json", "w") as f:
        f.write('{"id":2}')
    past = time.time() - 400 * 86_400
    os.utime(f"{folder}/old.json", (past, past))
    ingest()
    assert ids(out.read(spark)) == [1, 2]


DAMAGED = [
    ('{"id":1}\n{"id":2,\n{"id":3}\n{"id":4}', [1, 3, 4], 1),
    ('{"id":1}\n{"id":"x\n{"id":3}\n', [1, 3], 1),
    ('{"id":1}}\n{"id":2}', [1, 2], 1),
    ('{"id":1}\n{"id":2}\n{"id":', [1, 2], 1),
    ('[{"id":1},{"id":2}', [1, 2], 0),
    ('{"id":1,\n "a":{"b":"}{"}}\n{"id":2}', [1, 2], 0),
    ('text before {"id":1}\n{', [1], 1),
    ("", [], 0),
]


@pytest.mark.parametrize("text,good,bad", DAMAGED)
def test_damage_costs_itself_only(spark, folder, text, good, bad):
    os.makedirs(folder)
    with open(f"{folder}/a file.json", "w") as f:
        f.write(text)
    with open(f"{folder}/sound.json", "w") as f:
        f.write('{"id":100}\n{"id":101}')
    records, rejects = landing.ingest_json_checked(spark, folder, schema(spark))
    assert ids(records) == sorted([*good, 100, 101])
    assert rejects.count() == bad
    assert ids(landing.ingest_json(spark, folder, schema(spark))) == sorted([*good, 100, 101])


def test_batch_published_after_the_start_is_delivered(spark):
    source, out = Topic(scratch(spark, "t"), schema(spark)), Topic(scratch(spark, "o"), schema(spark))
    source.write(numbers(spark, 0, 5))
    staged = source.stage(numbers(spark, 5, 8))
    stream = source.read_stream(spark, position="latest")
    source.publish(spark, staged, "slow", 0)
    write_stream(stream, out, scratch(spark, "c"), "p").awaitTermination()
    assert ids(out.read(spark)) == [5, 6, 7]


def test_crash_before_publication_shows_nothing_twice(spark):
    source, out = Topic(scratch(spark, "t"), schema(spark)), Topic(scratch(spark, "o"), schema(spark))
    checkpoint = scratch(spark, "c")

    def read():
        write_stream(source.read_stream(spark), out, checkpoint, "p").awaitTermination()
        return ids(out.read(spark))

    source.stage(numbers(spark, 0, 4))  # the crash: written, never published
    assert read() == []
    source.write_batch(numbers(spark, 0, 4), "feed", 0)
    assert read() == [0, 1, 2, 3]
    source.publish(spark, source.stage(numbers(spark, 0, 4)), "feed", 0)  # a replay beside it
    assert read() == [0, 1, 2, 3] == ids(source.read(spark))
    assert not list_folders(spark, f"{source.path}/_staged/*")[1:]


def test_deduplication_keeps_late_records(spark):
    source = Topic(scratch(spark, "t"), schema(spark, "id long, ts timestamp"))
    out = Topic(scratch(spark, "o"), source.schema)
    for n, part in enumerate((range(20, 30), range(0, 10), range(10, 20), range(5, 25))):
        raw = spark.createDataFrame([(i,) for i in part], "id long")
        source.write_batch(raw.withColumn("ts", F.timestamp_seconds(F.col("id") * 86_400)).coalesce(1), "f", n)
    limited = source.read_stream(spark, max_files_per_trigger=1)
    stream = stateful.stream_deduplicated(limited, ["id"], "ts", "1 hour")
    write_stream(stream, out, scratch(spark, "c"), "p").awaitTermination()
    assert ids(out.read(spark)) == list(range(30))


def test_state_written_follows_the_batch(spark):
    """Batches after the first touch one key of many: one row of state is written, all keys are kept."""
    source = Topic(scratch(spark, "t"), schema(spark, "k long, id long, v double"))
    out = Topic(scratch(spark, "o"), schema(spark, "k long, id long, mean double, records long"))
    frames = [spark.range(400).selectExpr("id as k", "id", "id + 0.25 as v")]
    frames += [spark.createDataFrame([(7, 10_000 + i, i / 3)], "k long, id long, v double") for i in range(3)]
    for n, frame in enumerate(frames):
        source.write_batch(frame.coalesce(1), "f", n)
    run = stateful.stream_running_mean(
        source.read_stream(spark, max_files_per_trigger=1), ["k"], ["id"], "v", out, scratch(spark, "c"), "p"
    )
    run.awaitTermination()
    told = [p["stateOperators"][0] for p in run.recentProgress if p["numInputRows"]]
    assert [t["numRowsUpdated"] for t in told] == [400, 1, 1, 1]
    last = [r for r in out.read(spark).where("id = 10002").collect()]
    want = running_mean(source.read(spark), ["k"], ["id"], "v").where("id = 10002").first()
    assert last[0].records == want.records == 4 and last[0].mean == pytest.approx(want.mean, rel=1e-12)


def test_hot_and_cold_agree_on_fractions_and_leading_nulls(spark):
    df = spark.range(3_000).selectExpr(
        "cast(id % 3 as int) as k", "id", "case when id < 700 or id % 5 = 0 then null else id / 7 + 0.1 end as v"
    )
    both = []
    for limit in (10, 10_000):
        out = running_totals(df, ["k"], ["id"], {"s": F.col("v")}, max_rows_per_key=limit)
        both.append({r.id: r.s for r in out.collect()})
    assert len(both[0]) == len(both[1]) == 3_000
    for key, value in both[0].items():
        assert both[1][key] == (None if value is None else pytest.approx(value, rel=1e-12))


def test_scratch_is_removed(spark):
    chunks = f"{workspace(spark)}/millrace/{spark.sparkContext.applicationId}/chunks-*"
    before, earlier = set(os.listdir(workspace(spark).replace("file:", ""))), set(list_folders(spark, chunks))
    with scratch_scope(spark):
        running_totals(spark.range(100).select("id"), [], ["id"], {"s": F.col("id")}, max_rows_per_key=10).collect()
        assert set(list_folders(spark, chunks)) > earlier
    assert set(list_folders(spark, chunks)) == earlier
    after = set(os.listdir(workspace(spark).replace("file:", "")))
    assert {x for x in after - before if x != "millrace"} == set()
    assert callable(clear_scratch)


def test_keys_are_trimmed_of_all_blanks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a\t"), (3, "\x01 a\n"), (4, "b"), (5, None), (6, None)], "id long, k string")
    assert ids(quality.duplicate_keys(df, "k")) == [1, 2, 3, 5, 6]


def test_every_record_is_logged(spark, folder):
    source = Topic(scratch(spark, "t"), schema(spark))
    source.write(numbers(spark, 0, 53))
    os.makedirs(folder)

    def log(lines):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{x}\n" for x in lines)

    sinks.log_lines(source.read_stream(spark), "concat('id ', id)", scratch(spark, "c"), log=log).awaitTermination()
    found = [x for name in os.listdir(folder) for x in open(f"{folder}/{name}").read().splitlines()]
    assert sorted(found) == sorted(f"id {i}" for i in range(53))


def test_delimited_rejects(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/x.csv", "w") as f:
        f.write("1;2;3\n 4 ; 5;6\n7;x;9\n1;2\n1;2;3;4\n")
    good, bad = landing.split_delimited(spark, folder, ["a", "b", "c"])
    assert rows(good, "a", "b", "c") == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert bad.count() == 3
    with pytest.raises(Exception):
        landing.read_delimited(spark, folder, ["a", "b", "c"]).collect()


def test_slow_call_stops_the_rest(spark, folder):
    os.makedirs(folder)

    def call(record):
        with open(f"{folder}/{record['id']}", "w"):
            pass
        time.sleep(2 if record["id"] == 0 else 0)
        return record["id"]

    df = numbers(spark, 0, 2_000).coalesce(1)
    with pytest.raises(Exception):
        transforms.call_per_record(df, call, "x", schema(spark).fields[0].dataType, ["id"], 2, 0.3).collect()
    assert len(os.listdir(folder)) < 100


def test_array_features_and_halving(spark, folder):
    def load(path):
        def model(m):
            if (m[:, 0] > 900).any():
                raise ValueError("too large")
            return m

        return model

    df = spark.range(1_000).selectExpr("id", "array(cast(id as float), cast(500 as float)) as f").coalesce(1)
    scored = {r.id: (r.value, r.errors) for r in score(df, "f", load, folder, "m").collect()}
    assert scored[10] == (1.0, "") and scored[600] == (0.0, "") and scored[950] == (0.0, "too large")
    assert sum(bool(e) for _, e in scored.values()) == 99
