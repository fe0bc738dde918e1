"""Decoding policies and the leniency traps of the JSON parser."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from conftest import rows
from millrace.functions import codec
from millrace.operators.transforms import wrap_with_error

DATA = StructType([StructField("id", IntegerType(), False), StructField("name", StringType(), False)])
NESTED = StructType([StructField("id", IntegerType(), False), StructField("in", DATA)])

GOOD = ['{"id":1,"name":"a"}', ' {"name":"b","id":2,"extra":[1,{}]} ', '{"id":3,"name":"}{"}']
BAD = [
    '{"name":"z"}', '{"id":"x","name":"z"}', '{"id":1,"name":"z"', "null", "", None, "  ",
    '[{"id":1,"name":"z"}]', '{"id":1,"name":"z"} trailing', '{"id":1,"name":"z"}{"id":2,"name":"z"}',
    '{"id":1.5,"name":"z"}', "{'id':1,'name':'z'}", '{"id":1,"name":null}', '{"id":1,"name":"z"},',
]


@pytest.fixture
def bodies(spark):
    return spark.createDataFrame([(t,) for t in GOOD + BAD], "body string")


EXPECTED = [(1, "a"), (2, "b"), (3, "}{")]


def test_skip_counts(spark, bodies):
    seen = Observation("decode")
    assert rows(codec.decode_skip(bodies, "body", DATA, seen)) == EXPECTED
    assert seen.get == {"records": len(GOOD) + len(BAD), "skipped": len(BAD)}
    assert rows(codec.decode_skip(bodies, "body", DATA)) == EXPECTED


def test_dead_letter(spark, bodies):
    good, dead = codec.decode_dead_letter(bodies, "body", DATA)
    assert rows(good) == EXPECTED
    reasons = {r.body: r.reason for r in dead.collect()}
    assert set(reasons) == set(BAD)
    assert reasons[None] == "no value" and reasons[""] == "undecodable"


def test_replace(spark, bodies):
    replacement = F.struct(F.lit(0).alias("id"), F.lit("none").alias("name"))
    got = rows(codec.decode_replace(bodies, "body", DATA, replacement))
    assert got == sorted(EXPECTED + [(0, "none")] * len(BAD), key=repr)
    nothing = F.lit(None).cast("struct<id:int,name:string>")
    assert rows(codec.decode_replace(bodies, "body", DATA, nothing)) == EXPECTED


def test_strict(spark, bodies):
    with pytest.raises(Exception, match="undecodable record"):
        codec.decode_strict(bodies, "body", DATA).collect()


def test_nested_required(spark):
    texts = ['{"id":1,"in":{"id":2,"name":"a"}}', '{"id":1,"in":{"id":2}}', '{"id":1}', '{"id":1,"in":5}']
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    got = codec.decode_skip(df, "body", NESTED).select("id", "in.name")
    assert rows(got) == [(1, "a"), (1, None)]


def test_round_trip_and_other_columns(spark):
    df = spark.createDataFrame([(7, 1, "a\"}")], "k int, id int, name string")
    text = df.select("k", codec.encode(["id", "name"]).alias("body"))
    assert rows(codec.decode_skip(text, "body", DATA)) == [(7, 1, 'a"}')]


def test_one_parse_per_record(spark, bodies):
    plan = codec.decode_skip(bodies, "body", DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_wrapped_record(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    got = wrap_with_error(df, "metric", "bad", df.columns).first()
    assert got.metric.asDict() == {"id": 1, "name": "a"} and got.error == "bad"
