"""Filter, merge, split, two-sided and multi-output records, schema resolution, checks."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from conftest import rows
from millrace.operators import quality, routing, transforms
from millrace.operators.reference import drop_listed, read_key_list
from millrace.operators.schema import IncompatibleSchema, resolve


def data(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, name string")


def test_merge_two(spark):
    a, b = data(spark, (1, "a"), (3, "c"), (5, "e")), data(spark, (2, "b"), (4, "d"))
    assert rows(transforms.merge(a, b)) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


@pytest.mark.parametrize("n", range(2, 11))
def test_merge_many(spark, n):
    frames = [data(spark, (i, str(i))) for i in range(n)]
    assert transforms.merge_strict(frames).count() == n
    assert transforms.merge(*frames).count() == n


def test_merge_needs_inputs(spark):
    one = data(spark, (1, "a"))
    assert transforms.merge(one).count() == 1
    with pytest.raises(ValueError):
        transforms.merge()
    for frames in ([], [one]):
        with pytest.raises(ValueError):
            transforms.merge_strict(frames)


def test_merge_keeps_duplicates(spark):
    one = data(spark, (1, "a"))
    assert rows(transforms.merge(one, one)) == [(1, "a"), (1, "a")]


def test_filters(spark):
    df = data(spark, (1, "a"), (2, "b"), (3, "c"), (4, None))
    assert rows(df.where(F.col("id") % 2 == 0)) == [(2, "b"), (4, None)]
    assert rows(transforms.keep_equal(df, "name", "b")) == [(2, "b")]
    assert transforms.keep_present(df, "name").count() == 3


def test_override_and_unpivot_order(spark):
    df = spark.createDataFrame([("x", 1, 2.0, None)], "src string, a int, b double, c double")
    got = transforms.override(df, {"src": "-seen"}, {"a": 9}).first()
    assert (got.src, got.a) == ("x-seen", 9)
    long = transforms.unpivot(df, ["src"], {"a": "a", "b": "b", "c": "c"}).collect()
    assert [tuple(r) for r in long] == [("x", "a", 1.0), ("x", "b", 2.0), ("x", "c", None)]


def test_expand(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, xs array<string>")
    assert rows(transforms.expand(df, "xs", "x")) == [(1, "a"), (1, "b")]


def test_split_keeps_every_record(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, -1.0, None, float("nan")])], "i int, v double")
    left, right = routing.split(df, F.col("v") > 0)
    assert left.count() + right.count() == 4
    assert (2, None) in rows(left)


SPECIAL = [float("nan"), None, 0.0, -0.0, float("inf"), float("-inf"), 1.5, -1.5]


def test_measurements_special_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(SPECIAL)], "id int, value double")
    valid, invalid = quality.validate_measurements(df)
    assert sorted(r.id for r in valid.collect()) == [2, 3, 4, 6]
    wrapped = invalid.collect()
    assert sorted(r.metric.id for r in wrapped) == [0, 1, 5, 7]
    assert {r.error for r in wrapped} == {quality.INVALID_MEASUREMENT}


def test_split_even_odd(spark):
    left, right = routing.split(data(spark, (1, "a"), (2, "b")), F.col("id") % 2 == 0)
    assert rows(left.select("name")) == [("a",)] and rows(right) == [(2, "b")]


def test_either(spark):
    df = data(spark, (1, "a"), (2, "b"))
    e = df.select(routing.either(F.col("id") == 2, F.col("name"), F.col("id")).alias("e"))
    mapped = e.select(routing.map_right(F.col("e"), lambda v: v * 10).alias("e"))
    assert [tuple(r.e) for r in mapped.collect()] == [("a", None), (None, 20)]
    flags = mapped.select(routing.is_left(F.col("e")), routing.is_right(F.col("e")))
    assert [tuple(r) for r in flags.collect()] == [(True, False), (False, True)]
    built = df.select(
        routing.left(F.col("name"), "int").alias("l"), routing.right(F.col("id"), "string").alias("r")
    )
    assert tuple(built.first().l) == ("a", None) and tuple(built.first().r) == (None, 1)
    for side in (routing.get_right, routing.get_left):
        with pytest.raises(Exception, match="requested of a"):
            mapped.select(side(F.col("e"))).collect()


def test_multi(spark):
    df = spark.createDataFrame([(1, ["A", "B"], [456, 323, 32]), (2, [], None)], "id int, a array<string>, b array<int>")
    out = df.select("id", routing.multi(F.col("a"), F.col("b")).alias("m"))
    first, second = routing.outlets(out, "m")
    assert rows(first) == [(1, "A"), (1, "B")]
    assert rows(second) == sorted([(1, 456), (1, 323), (1, 32)], key=repr)
    only = df.select("id", routing.with_data1(routing.multi(second=F.col("b")), F.col("a")).alias("m"))
    assert routing.outlets(only, "m")[0].count() == 2
    none = df.select("id", routing.with_data2(routing.multi(F.col("a"), F.col("b")), F.array()).alias("m"))
    assert routing.outlets(none, "m")[1].count() == 0
    either = data(spark, (1, "a"), (2, "b")).select(
        routing.either(F.col("id") == 2, F.col("name"), F.col("id")).alias("e")
    )
    lefts, rights = routing.outlets(either.select(routing.to_multi(F.col("e")).alias("m")), "m")
    assert rows(lefts) == [("a",)] and rows(rights) == [(2,)]


def test_render(spark):
    df = data(spark, (1, "a"), (2, None))
    got = df.select(
        transforms.as_document(F.col("name"), F.lit("text")).alias("d"),
        transforms.as_pair(F.col("id"), F.col("name")).alias("p"),
        transforms.as_log_line("invalid: ", ["id", "name"]).alias("l"),
    ).collect()
    assert tuple(got[0]) == ("a\n\ntext", "1 -> a", 'invalid: {"id":1,"name":"a"}')
    assert got[1].l == 'invalid: {"id":2,"name":null}'


def _slow_lookup(record):
    time.sleep(0.01 if record["id"] % 3 else 0.0)
    return None if record["name"] is None else record["name"] * record["id"]


def test_calls_keep_order_and_columns(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(i, "x", big if i % 2 else None) for i in range(30)], "id int, name string, n long")
    got = transforms.call_per_record(df.coalesce(1), _slow_lookup, "answer", StringType(), ["id", "name"])
    assert [(r.id, r.answer) for r in got.collect()] == [(i, "x" * i) for i in range(30)]
    assert {r.n for r in got.collect()} == {big, None}


def test_call_timeout(spark):
    df = data(spark, (1, "a"))
    slow = transforms.call_per_record(df, lambda r: time.sleep(5), "x", StringType(), ["id"], timeout=0.2)
    with pytest.raises(Exception):
        slow.collect()


def test_deny_list(spark, folder):
    df = data(spark, (1, "a"), (2, "b"), (3, None))
    assert drop_listed(df, "name", read_key_list(spark, f"{folder}/absent")).count() == 3
    spark.createDataFrame([("b",), ("z",)], "v string").write.text(folder)
    assert rows(drop_listed(df, "name", read_key_list(spark, folder))) == [(1, "a"), (3, None)]


def schema(*fields):
    return StructType([StructField(n, t) for n, t in fields])


WRITER = [("i", IntegerType()), ("l", LongType()), ("f", FloatType()), ("s", StringType())]


@pytest.mark.parametrize(
    "source,target",
    [("i", LongType()), ("i", FloatType()), ("i", DoubleType()), ("l", FloatType()), ("l", DoubleType()),
     ("f", DoubleType()), ("s", BinaryType()), ("i", IntegerType())],
)
def test_promotions(spark, source, target):
    df = spark.createDataFrame([(1, 2, 3.0, "x")], schema(*WRITER))
    got = resolve(df, schema((source, target)))
    assert got.schema[source].dataType == target and got.first()[0] is not None
    if target == BinaryType():
        assert resolve(got, schema(("s", StringType()))).first()[0] == "x"


@pytest.mark.parametrize("source,target", [("l", IntegerType()), ("f", LongType()), ("s", IntegerType()), ("i", StringType())])
def test_forbidden_promotions(spark, source, target):
    with pytest.raises(IncompatibleSchema):
        resolve(spark.createDataFrame([], schema(*WRITER)), schema((source, target)))


def test_resolution_of_fields(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "x")], schema(*WRITER))
    reader = schema(("s", StringType()), ("new", StringType()), ("i", IntegerType()))
    got = resolve(df, reader, {"new": "d"})
    assert got.columns == ["s", "new", "i"] and tuple(got.first()) == ("x", "d", 1)
    with pytest.raises(IncompatibleSchema):
        resolve(df, reader)
    nested = df.select(F.struct("i", "s").alias("r"), F.array(F.struct("i")).alias("rs"))
    inner = schema(("i", LongType()), ("n", IntegerType()))
    got = resolve(nested, schema(("r", inner)), {"r.n": 7}).first()
    assert tuple(got.r) == (1, 7)


def test_typed_failures(spark):
    df = spark.createDataFrame(
        [("1", "true", "42", "1.5", "7 m", "64k", "debug"), ("2", "maybe", "4.2", "x", "7 q", "-1", "xdebug"),
         ("3", None, "99999999999", None, None, None, None)],
        "k string, b string, i string, d string, t string, m string, s string",
    )
    checks = [
        quality.Check("b", "bool"), quality.Check("i", "int32"), quality.Check("d", "double"),
        quality.Check("t", "duration"), quality.Check("m", "memorysize"),
        quality.Check("s", "string", "debug|info"), quality.Check("s", "string"),
    ]
    assert rows(quality.typed_failures(df, "k", checks)) == sorted(
        [("2", "b", "maybe"), ("2", "i", "4.2"), ("2", "d", "x"), ("2", "t", "7 q"), ("2", "m", "-1"),
         ("2", "s", "xdebug"), ("3", "i", "99999999999")], key=repr)
    with pytest.raises(ValueError):
        quality.typed_failures(df, "k", [quality.Check("b", "int64")])


def test_duplicates(spark):
    df = data(spark, (1, "a"), (2, " a "), (3, "b"), (4, None), (5, None))
    assert sorted(r.id for r in quality.duplicate_keys(df, "name").collect()) == [1, 2, 4, 5]


def test_orphans(spark):
    a, b = data(spark, (1, "x"), (2, "y"), (3, None)), data(spark, (9, "y"), (8, "z"))
    assert rows(quality.orphans(a, "name", b, "name")) == [(1, "x"), (3, None)]
    assert rows(quality.orphans(b, "name", a, "name")) == [(8, "z")]


def test_bound_to_many(spark):
    df = spark.createDataFrame(
        [("bar.in", "foos"), ("bar.in", "fooos"), ("bar.in", "foos"), ("bar.out", "foos-processed"),
         ("bar.out", "foos-processed2"), ("foo.out", "foos")], "port string, topic string")
    assert rows(quality.bound_to_many(df, "port", "topic")) == sorted(
        [("bar.in", "foos", 2), ("bar.in", "fooos", 2), ("bar.out", "foos-processed", 2),
         ("bar.out", "foos-processed2", 2)], key=repr)
