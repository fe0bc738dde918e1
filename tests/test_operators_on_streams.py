"""Stateless operators give the same records on a stream as on a batch frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from conftest import rows
from millrace.functions import codec, scalars
from millrace.operators import quality, routing, transforms
from millrace.operators.reference import drop_listed
from millrace.operators.schema import resolve
from millrace.operators.scoring import score
from millrace.session import scratch
from millrace.sources.topics import Topic, write_stream

DATA = StructType([StructField("id", StringType(), False), StructField("x", DoubleType(), False)])


def decode(df):
    return codec.decode_skip(df.select("body"), "body", DATA)


def dead_letters(df):
    return codec.decode_dead_letter(df.select("body"), "body", DATA)[1]


def metrics(df):
    return transforms.unpivot(df, ["id"], {"a": "a", "b": "b"})


def invalid(df):
    return quality.validate_measurements(metrics(df))[1].select("metric.*", "error")


def right(df):
    return routing.split(df.select("id", "a"), F.col("a") > 0)[1]


def doubled(df):
    side = routing.either(F.col("a") > 0, F.col("id"), F.col("a"))
    return df.select(routing.map_right(side, lambda v: v * 2).alias("e")).select("e.left", "e.right")


def fanned(df):
    value = routing.multi(F.array("a", "b"), F.array("id"))
    return routing.outlets(df.select("id", value.alias("m")), "m")[0]


def merged(df):
    return transforms.merge(df.select("id", "a"), df.select("id", F.col("b").alias("a")))


def labels(df):
    return df.select(scalars.dns_label(F.col("body")).alias("label"), scalars.duration_nanos(F.col("id")).alias("d"))


def resolved(df):
    return resolve(df.select("id", "a"), StructType([*DATA.fields[:1], StructField("n", StringType())]), {"n": "-"})


def allowed(df):
    spark = df.sparkSession
    return drop_listed(df.select("id", "a"), "id", spark.createDataFrame([("2",), ("7",)], "listed string"))


def called(df):
    return transforms.call_per_record(df.select("id"), lambda r: r["id"] * 2, "twice", StringType(), ["id"])


def _model(path):
    return lambda matrix: np.stack([matrix[:, 0], -matrix[:, 0]], axis=1)


def scored(df):
    return score(df.select("id", "a", "b"), ["a", "b"], _model, "/models", "m").select("id", "value", "errors")


OPERATORS = [
    decode, dead_letters, metrics, invalid, right, doubled, fanned, merged, labels, resolved,
    allowed, called, scored,
]


@pytest.fixture(scope="module")
def source(spark):
    bodies = ['{"id":"%d","x":%d}', '{"id":"%d"', "[%d, %d]"]
    data = [
        (str(i), float(i % 5 - 2), None if i % 4 == 0 else float(i), bodies[i % 3].replace("%d", str(i)))
        for i in range(40)
    ]
    df = spark.createDataFrame(data, "id string, a double, b double, body string")
    topic = Topic(scratch(spark, "source"), df.schema)
    topic.write(df.repartition(3))
    return topic


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_stream_equals_batch(spark, source, operator):
    stream = operator(source.read_stream(spark, max_files_per_trigger=1))
    assert stream.isStreaming
    out = Topic(scratch(spark, "out"), stream.schema)
    write_stream(stream, out, scratch(spark, "c"), "p").awaitTermination()
    batch = operator(source.read(spark))
    assert 0 < batch.count()
    assert rows(out.read(spark)) == rows(batch)
