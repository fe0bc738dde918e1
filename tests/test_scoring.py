"""Scoring keeps every record, whatever the model does."""

import json
import os

import numpy as np

from millrace.operators.scoring import score


def frame(spark, values):
    return spark.createDataFrame([(2**53 + i, float(v), 1.0) for i, v in enumerate(values)], "id long, x double, y double")


def linear(path):
    with open(path) as source:
        weights = np.array(json.load(source))

    def predict(matrix):
        assert matrix.dtype == np.float32
        return matrix @ weights.T

    return predict


def picky(path):
    model = linear(path)

    def predict(matrix):
        if (matrix[:, 0] < 0).any():
            raise ValueError("negative")
        return model(matrix)

    return predict


def broken(path):
    def predict(matrix):
        raise RuntimeError("always")

    return predict


def model_in(folder, weights):
    os.makedirs(folder)
    with open(os.path.join(folder, "wine"), "w") as out:
        json.dump(weights, out)
    return folder


def results(df):
    return [(r.value, r.errors, r.model_name) for r in df.orderBy("id").collect()]


def test_first_maximum_wins(spark, folder):
    mount = model_in(folder, [[0, 0], [1, 0], [1, 0]])
    got = score(frame(spark, [2, -2, 0]), ["x", "y"], linear, mount, "wine")
    assert results(got) == [(1.0, "", "wine"), (0.0, "", "wine"), (0.0, "", "wine")]
    assert [r.id for r in got.orderBy("id").collect()] == [2**53 + i for i in range(3)]


def test_bad_record_keeps_its_row(spark, folder):
    mount = model_in(folder, [[0, 0], [1, 0]])
    got = score(frame(spark, [2, -2, 3]), ["x", "y"], picky, mount, "wine", empty_value=-1.0)
    assert results(got) == [(1.0, "", "wine"), (-1.0, "negative", "wine"), (1.0, "", "wine")]


def test_all_records_bad(spark, folder):
    mount = model_in(folder, [[0, 0]])
    got = score(frame(spark, [1, 2]), ["x", "y"], broken, mount, "wine")
    assert results(got) == [(0.0, "always", "wine")] * 2


def test_model_does_not_load(spark, folder):
    got = score(frame(spark, [1, 2]), ["x", "y"], linear, folder, "absent").collect()
    assert len(got) == 2
    for r in got:
        assert r.value == 0.0 and r.errors.startswith("Could not load model: ") and r.model_name == ""


def test_array_features(spark, folder):
    mount = model_in(folder, [[0, 0], [1, 0]])
    df = frame(spark, [2, -2]).selectExpr("id", "array(x, y) AS v")
    assert results(score(df, "v", linear, mount, "wine")) == [(1.0, "", "wine"), (0.0, "", "wine")]
