"""Running totals, count windows and running means against brute force, plain and skewed."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators.aggregate import count_window, running_mean


def skewed(n=600, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        data.append((key, rng.randrange(50), i, float(rng.randrange(-20, 20))))
    return data


def frame(spark, data):
    return spark.createDataFrame(data, "k string, ts int, id int, v double").repartition(5)


def brute_windows(data, size, keyed=True):
    groups = {}
    for k, ts, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(k if keyed else "", []).append(v)
    out = []
    for k, values in groups.items():
        for w, at in enumerate(range(0, len(values), size)):
            run = values[at : at + size]
            out.append((k, w, sum(run), len(run)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10, 10_000])
@pytest.mark.parametrize("size", [1, 4, 5])
def test_count_window_by_key(spark, limit, size):
    data = skewed()
    got = count_window(
        frame(spark, data), size, ["ts", "id"],
        [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")], ["k"], max_rows_per_key=limit,
    )
    assert rows(got, "k", "window", "s", "n") == brute_windows(data, size)


def test_count_window_only_some_keys_hot(spark):
    data = skewed()
    got = count_window(
        frame(spark, data), 5, ["ts", "id"],
        [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")], ["k"], max_rows_per_key=150,
    )
    assert rows(got, "k", "window", "s", "n") == brute_windows(data, 5)


def test_count_window_without_key(spark):
    data = skewed(101)
    got = count_window(
        frame(spark, data), 5, ["ts", "id"],
        [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")],
    ).withColumn("k", F.lit(""))
    assert rows(got, "k", "window", "s", "n") == brute_windows(data, 5, keyed=False)


@pytest.mark.parametrize("n,full,partial", [(0, 0, 0), (4, 0, 1), (5, 1, 0), (6, 1, 1), (10, 2, 0)])
def test_count_window_edges(spark, n, full, partial):
    df = spark.createDataFrame([("a", i) for i in range(n)], "k string, id int")
    args = (df, 5, ["id"], [F.count(F.lit(1)).alias("n")], ["k"])
    assert count_window(*args).count() == full + partial
    assert count_window(*args, keep_partial=False).count() == full


@pytest.mark.parametrize("keys", [["k"], []])
def test_hot_rows_are_spread_over_chunks(spark, keys, monkeypatch):
    """One key with every record: the scan must run in many balanced chunks."""
    from millrace.operators import ordered

    seen = []
    real = ordered._chunked

    def watch(hot, *rest):
        seen.append(hot)
        return real(hot, *rest)

    monkeypatch.setattr(ordered, "_chunked", watch)
    data = [("hot", i % 7, i, 1.0) for i in range(1000)]
    got = count_window(
        frame(spark, data), 3, ["ts", "id"], [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")],
        keys, max_rows_per_key=100,
    ).withColumn("k", F.lit("hot"))
    assert rows(got, "k", "window", "s", "n") == brute_windows(data, 3)
    assert [h.chunks for h in seen] == [10]


def brute_mean(data):
    out, state = [], {}
    for k, ts, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        total, n = state.get(k, (0.0, 0))
        state[k] = (total + v, n + 1)
        out.append((k, i, state[k][0] / state[k][1], n + 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10, 10_000])
def test_running_mean(spark, limit):
    data = skewed()
    got = running_mean(frame(spark, data), ["k"], ["ts", "id"], "v", max_rows_per_key=limit)
    assert rows(got, "k", "id", "mean", "records") == brute_mean(data)


def test_running_mean_of_one_car(spark):
    df = spark.createDataFrame(
        [(1, "ann", 1, 60), (1, "bob", 2, 90), (1, "bob", 3, 75)],
        "carId int, driver string, ts int, speed int",
    )
    got = running_mean(df, ["carId"], ["ts"], "speed", carry=["driver"])
    assert rows(got, "carId", "driver", "mean", "records") == [
        (1, "ann", 60.0, 1), (1, "bob", 75.0, 2), (1, "bob", 75.0, 3),
    ]


@pytest.mark.parametrize("limit", [2, 10_000])
def test_running_mean_continues_from_prior(spark, limit):
    prior = spark.createDataFrame([("a", 10.0, 2), ("z", 1.0, 1)], "k string, _sum double, _count long")
    df = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 9.0), ("b", 3, 4.0), ("a", 4, None)], "k string, id int, v double"
    )
    got = running_mean(df, ["k"], ["id"], "v", prior=prior, max_rows_per_key=limit)
    assert rows(got, "k", "id", "mean", "records") == [
        ("a", 1, 5.0, 3), ("a", 2, 6.0, 4), ("a", 4, 6.0, 4), ("b", 3, 4.0, 1),
    ]
