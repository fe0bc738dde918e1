"""Drop records whose key is on a list that may change while a stream runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import delete_path, move_path, path_exists


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """One key per line, column `listed`. An absent file is an empty list.

    Builds a new DataFrame each time: an old one keeps the listing it was created with.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "listed string")
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("listed"))


def stored_key_list(spark: SparkSession, path: str, kept: str) -> DataFrame:
    """The list as it is on the first call with `kept`, a folder that takes its distinct keys; later
    calls return these."""
    if not path_exists(spark, kept):
        staged = f"{kept.rsplit('/', 1)[0]}/_staged-{uuid.uuid4().hex}"
        read_key_list(spark, path).distinct().write.parquet(staged)
        if not move_path(spark, staged, kept):
            delete_path(spark, staged)
    return spark.read.schema("listed string").parquet(kept)


def drop_listed(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Anti join. No hint: Spark broadcasts the list when its size allows, and otherwise
    shuffles, splitting skewed partitions of the records."""
    return df.join(listed, df[key].cast("string") == listed["listed"], "left_anti")
