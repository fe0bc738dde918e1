"""Delimited records, feature vectors and model scoring."""

from __future__ import annotations

import json

import numpy as np
from pyarrow import fs
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators.scoring import score
from millrace.plans.catalog.registry import query, scratch, table
from millrace.sources.landing import read_delimited

# The features of a wine record, in model order.
FEATURES = [
    "fixed_acidity", "volatile_acidity", "citric_acid", "residual_sugar", "chlorides",
    "free_sulfur_dioxide", "total_sulfur_dioxide", "density", "pH", "sulphates", "alcohol",
]
CLASSES = 3


def _weight(label: int, position: int) -> float:
    """A fixed linear model, simple enough for SQL to repeat."""
    return float((label + 1) * (position % 4) - position)


def _wine(spark, folder):
    """Embeddings read as wine records: their first components are the features."""
    vector = F.col("embedding")
    columns = [vector[i].cast("double").alias(name) for i, name in enumerate(FEATURES)]
    return table(spark, folder, "embeddings").select("vec_id", *columns)


_WINE_SQL = "SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS {name}" for i, name in enumerate(FEATURES)
) + " FROM embeddings"
_OUTPUTS = [
    " + ".join(f"({_weight(c, i)}) * {name}" for i, name in enumerate(FEATURES))
    for c in range(CLASSES)
]
_VALUE = f"(list_position([{', '.join(_OUTPUTS)}], list_max([{', '.join(_OUTPUTS)}])) - 1)::DOUBLE"


@query(
    "delimited_records",
    "SELECT 'wine' AS datatype, " + ", ".join(FEATURES) + f" FROM ({_WINE_SQL}) w",
)
def delimited_records(spark, folder):
    path = scratch(spark, "wine")
    _wine(spark, folder).select(
        F.concat_ws(" ; ", *[F.col(c).cast("string") for c in FEATURES])
    ).write.text(path)
    return read_delimited(spark, path, FEATURES)


@query(
    "feature_vector",
    f"""SELECT vec_id, position, feature::DOUBLE AS feature FROM
        (SELECT vec_id, unnest([{', '.join(f'{c}::FLOAT' for c in FEATURES)}]) AS feature,
                unnest(range({len(FEATURES)}))::INTEGER AS position FROM ({_WINE_SQL}) w) f""",
)
def feature_vector(spark, folder):
    vectors = _wine(spark, folder).select("vec_id", scalars.feature_vector(FEATURES).alias("v"))
    exploded = vectors.select("vec_id", F.posexplode("v").alias("position", "feature"))
    return exploded.withColumn("feature", F.col("feature").cast("double"))


@query(
    "vector_argmax",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings",
)
def vector_argmax(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    return embeddings.select("vec_id", scalars.argmax(F.col("embedding")).alias("best"))


def _load(path):
    """The weights of a linear model, from whatever file system the path is on."""
    files, root = fs.FileSystem.from_uri(path)
    parts = [f.path for f in files.get_file_info(fs.FileSelector(root)) if "/part-" in f.path]
    text = b"".join(files.open_input_stream(p).read() for p in parts)
    weights = np.array(json.loads(text), dtype=np.float64)
    return lambda matrix: matrix.astype(np.float64) @ weights.T


def _load_picky(path):
    model = _load(path)

    def predict(matrix):
        if (matrix[:, 0] < 0).any():
            raise ValueError("negative acidity")
        return model(matrix)

    return predict


def _mount(spark):
    """A model folder on shared storage, as a deployment would mount it."""
    mount = scratch(spark, "models")
    weights = [[_weight(c, i) for i in range(len(FEATURES))] for c in range(CLASSES)]
    text = spark.createDataFrame([(json.dumps(weights),)], "value string")
    text.coalesce(1).write.text(f"{mount}/linear")
    return mount


_RESULT = ["vec_id", "value", "errors", "model_name"]


@query(
    "score_model",
    f"SELECT vec_id, {_VALUE} AS value, '' AS errors, 'linear' AS model_name FROM ({_WINE_SQL}) w",
)
def score_model(spark, folder):
    return score(_wine(spark, folder), FEATURES, _load, _mount(spark), "linear").select(*_RESULT)


@query(
    "score_model_errors",
    f"""SELECT vec_id, CASE WHEN fixed_acidity < 0 THEN 0.0 ELSE {_VALUE} END AS value,
               CASE WHEN fixed_acidity < 0 THEN 'negative acidity' ELSE '' END AS errors,
               'linear' AS model_name
        FROM ({_WINE_SQL}) w""",
)
def score_model_errors(spark, folder):
    scored = score(_wine(spark, folder), FEATURES, _load_picky, _mount(spark), "linear")
    return scored.select(*_RESULT)


@query(
    "score_model_unloadable",
    "SELECT vec_id, 0.0::DOUBLE AS value, true AS failed, '' AS model_name FROM embeddings",
)
def score_model_unloadable(spark, folder):
    scored = score(_wine(spark, folder), FEATURES, _load, _mount(spark), "absent")
    failed = F.col("errors").startswith("Could not load model: ")
    return scored.select("vec_id", "value", failed.alias("failed"), "model_name")
