"""JSON framing, directory ingest, accept/reject, delimited files."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from conftest import rows
from millrace.functions.scalars import instant
from millrace.plans.turbines import MEASUREMENTS, turbine_application
from millrace.session import scratch
from millrace.sources import landing
from millrace.sources.topics import Topic

ID = StructType([StructField("id", IntegerType(), False)])


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as out:
            out.write(text)


def bodies(spark, folder, **options):
    framed = landing.frame_json(landing.read_json_pieces(spark, folder), **options)
    by_file = {}
    for r in framed.orderBy("path", "position").collect():
        by_file.setdefault(os.path.basename(r.path), []).append(r.body)
    return by_file


CASES = {
    "one.json": ('{"id": 1}', ['{"id": 1}']),
    "pretty.json": ('{\n  "id": 1,\n  "in": {\n "x": {}}\n}\n', ['{\n  "id": 1,\n  "in": {\n "x": {}}\n}']),
    "array.json": ('[{"id":1}, {"id":2},\n{"id":3}]\n', ['{"id":1}', '{"id":2}', '{"id":3}']),
    "row.json": ('{"id":4}{"id":5} {"id":6}', ['{"id":4}', '{"id":5}', '{"id":6}']),
    "lines.json": ('{"id":7}\n\n{"id":8}\r\n', ['{"id":7}', '{"id":8}']),
    "quoted.json": (r'{"a":"}{\"}\\"}{"b":"{"}', [r'{"a":"}{\"}\\"}', '{"b":"{"}']),
    "cut.json": ('{"id":9}{"id":10', ['{"id":9}']),
    "cut_nested.json": ('{"id":9,"in":{"x":1}', None),
    "empty.json": ("", None),
    "blank.json": ("\n  \n", None),
    "unicode.json": ('{"é":"ü}"}\n{"id":11}', ['{"é":"ü}"}', '{"id":11}']),
}


@pytest.mark.parametrize("big_file", [landing.BIG_FILE, 0])
def test_framing_shapes(spark, folder, big_file):
    write(folder, {name: text for name, (text, _) in CASES.items()})
    expected = {name: objects for name, (_, objects) in CASES.items() if objects}
    assert bodies(spark, folder, big_file=big_file) == expected


@pytest.mark.parametrize("big_file", [landing.BIG_FILE, 0, 900])
def test_framing_over_many_blocks(spark, folder, big_file):
    rng = random.Random(5)
    alphabet = '{}[]",:\\ ax\né'

    def value(depth):
        if depth and rng.random() < 0.4:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(3))}
        return "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))

    files, expected = {}, {}
    for n in range(6):
        objects = [{"id": i, "v": value(3)} for i in range(rng.randrange(5, 60))]
        texts = [json.dumps(o, ensure_ascii=False, indent=rng.choice([None, 1])) for o in objects]
        files[f"f{n}.json"] = rng.choice(["[{}]", "{}", "\n{}"]).format(rng.choice([",\n", " ", ","]).join(texts))
        expected[f"f{n}.json"] = texts
    write(folder, files)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert bodies(spark, folder, big_file=big_file) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_compressed_file(spark, folder):
    import gzip

    os.makedirs(folder)
    with gzip.open(os.path.join(folder, "a.json.gz"), "wt") as out:
        out.write("".join('{"id":%d,"pad":"%s"}\n' % (i, "x" * 50) for i in range(40)))
    got = landing.ingest_json(spark, folder, ID)
    assert rows(got) == sorted([(i,) for i in range(40)], key=repr)


DEVICE = "c75cb448-df0e-4692-8e06-0321b7703992"


def sensor(power, rotor, wind, at=1495545346279):
    return {
        "deviceId": DEVICE, "timestamp": at,
        "measurements": {"power": power, "rotorSpeed": rotor, "windSpeed": wind},
    }


def sensor_files():
    one = {
        "04-moderate-breeze.json": sensor(1.7, 3.9, 25.3),
        "10-storm.json": sensor(1.7, 23.4, 100.1),
        "11-violent-storm.json": sensor(1.7, 45.7, 105.9),
        "12-hurricane.json": sensor(1.7, 78.3, 129.4),
        "invalid-metric.json": sensor(-1.7, 3.9, 25.3),
    }
    future = [
        sensor(1.7, 3.9, 25.3, 3134584800000), sensor(-1.7, 3.9, 25.3, 3134584800000),
        sensor(1.7, 3.9, 100.1, 3134584800000), sensor(1.7, 3.9, 100.1, 3134584800000),
    ]
    return {**one, "future-data.json": future}


def test_sensor_files_end_to_end(spark, folder):
    write(folder, {name: json.dumps(data, indent=4) for name, data in sensor_files().items()})
    wire = StructType(
        [
            StructField("deviceId", StringType(), False),
            StructField("timestamp", LongType(), False),
            StructField("measurements", MEASUREMENTS, False),
        ]
    )
    records = landing.ingest_json(spark, folder, wire).withColumn("timestamp", instant(F.col("timestamp")))
    topics = turbine_application().run_batch(spark, {"sensor-data": records})
    assert topics["metrics"].count() == 27
    assert topics["valid-metrics"].count() == 25
    invalid = topics["invalid-metrics"].select("metric.name", "metric.value", "error")
    assert rows(invalid) == [("power", -1.7, "All measurements must be positive numbers!")] * 2
    first = records.where("measurements.windSpeed = 129.4").select(F.col("timestamp").cast("string"))
    assert first.first()[0] == "2017-05-23 13:15:46.279"


def test_stream_takes_each_file_once(spark, folder):
    out = Topic(scratch(spark, "ingest"), ID)
    checkpoint = scratch(spark, "ingest-progress")

    def run():
        landing.ingest_json_stream(
            spark, folder, ID, lambda df, i: out.write_batch(df, "in", i), checkpoint, 1
        ).awaitTermination()
        return rows(out.read(spark))

    write(folder, {"a.json": '{"id":1}{"id":2}', "b.json": '[{"id":3}]'})
    assert run() == [(1,), (2,), (3,)]
    assert run() == [(1,), (2,), (3,)]
    write(folder, {"c.json": '{"id":4}\n{"broken":'})
    assert run() == [(1,), (2,), (3,), (4,)]


def test_replay_emits_every_file_again(spark, folder):
    write(folder, {"a.json": '{"id":1}', "b.json": '{"id":2}'})
    seen = []
    query = landing.ingest_json_replayed(
        spark, folder, ID, lambda df, i: seen.append(rows(df)), scratch(spark, "replay"), "1 second"
    )
    try:
        deadline = time.time() + 60
        while len(seen) < 2 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[:2] == [[(1,), (2,)]] * 2


def test_accept_and_reject(spark, folder):
    write(folder, {"bodies.txt": '{"id":1}\n\n{"id":"x"}\n{"id":2}\n'})
    accepted, rejected = landing.accept_bodies(landing.read_bodies(spark, folder), "body", ID)
    assert rows(accepted) == [(1,), (2,)]
    assert rows(rejected, "body") == sorted([("",), ('{"id":"x"}',)], key=repr)


def elements(spark, texts, kind="long"):
    bodies = spark.createDataFrame(list(enumerate(texts)), f"n {kind}, text string")
    accepted, rejected = landing.accept_elements(bodies, "n", "text", ID)
    return rows(accepted, "n", "id"), rows(rejected, "n", "position", "reason"), rejected


def test_elements_of_a_pretty_printed_body(spark):
    parts = ['{\n  "id": %s\n}' % x for x in ("1", "2", '"x"', "4", "5")]
    text = "[\n" + ",\n".join(parts) + "\n]\n"
    accepted, rejected, frame = elements(spark, [text])
    assert accepted == [(0, 1), (0, 2), (0, 4), (0, 5)]
    assert rejected == [(0, text.index(parts[2]), "undecodable")]
    assert [r.body for r in frame.collect()] == [parts[2]]


@pytest.mark.parametrize(
    "text,ids,rejects",
    [
        ('{"id":1}', [1], 0),
        ('{"id":1}{"id":2}\n{"id":3}\n', [1, 2, 3], 0),
        ('[{"id":1,"o":{"id":9}},{"id":2,"s":"}{]"}]', [1, 2], 0),
        ('[{"id":1},\n{"id":2', [1], 1),
        ('{"id":1}\n{"id":2,\n{"id":3}', [1, 3], 1),
        ('"text"', [], 1),
        ("[]", [], 0),
        ("", [], 1),
        (" \n\t", [], 1),
        (None, [], 1),
        ("}", [], None),
        ('{"id":1}}', [1], None),
        ('{"id":7,"s":"ä€"}' * 300, [7] * 300, 0),
    ],
)
def test_elements_of_odd_bodies(spark, text, ids, rejects):
    accepted, rejected, _ = elements(spark, [text])
    assert [i for _, i in accepted] == ids
    assert rejects is None or len(rejected) == rejects


def test_bodies_do_not_run_into_each_other(spark):
    """Open ends, repeated ids, and a file per body."""
    bodies = spark.createDataFrame([("a", '{"id":1'), ("a", ',"x":2}'), ("a", '{"id":3}'), (None, '{"id":4}')], "n string, text string")
    accepted, rejected = landing.accept_elements(bodies.coalesce(1), "n", "text", ID)
    assert rows(accepted, "n", "id") == sorted([("a", 3), (None, 4)], key=repr)
    assert rejected.count() >= 2
    none = bodies.limit(0)
    assert [f.count() for f in landing.accept_elements(none, "n", "text", ID)] == [0, 0]


def test_a_file_per_body(spark, folder):
    write(folder, {"a": '[\n{"id":1},\n{"id":2}\n]', "b": '{"id":"x"}\n{"id":3}'})
    accepted, rejected = landing.accept_elements(landing.read_whole_bodies(spark, folder), "path", "body", ID)
    assert rows(accepted, "id") == [(1,), (2,), (3,)]
    assert rows(rejected, "position", "body") == [(0, '{"id":"x"}')]


def test_delimited(spark, folder):
    write(folder, {"wine.csv": "7.0; 0.27 ;0.36\n6.3;0.3;  0.34\n"})
    got = landing.read_delimited(spark, folder, ["a", "b", "c"])
    assert rows(got) == [("wine", 6.3, 0.3, 0.34), ("wine", 7.0, 0.27, 0.36)]
