"""Changes of a directory: files that came or were written anew since the last look.

Each look lists the directory and stores the listing under its number before anything is derived from it.
What changed is the difference of two stored listings, so a look that is repeated after a crash finds the
same changes, whatever happened to the directory meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.session import delete_path, move_path, path_exists
from millrace.sources.topics import Topic, start

LISTING = "path string, length long, modified timestamp"


def change_schema() -> StructType:
    """`kind` is created or modified."""
    return StructType.fromDDL(f"kind string, {LISTING}")


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every file below a directory that is not empty; contents stay unread. An absent directory has none.
    Spark's listing passes over files without a byte, hidden ones and those that begin with `_`."""
    if not path_exists(spark, directory):
        return spark.createDataFrame([], LISTING)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def changes_at(spark: SparkSession, directory: str, state: str, look: int) -> DataFrame:
    """What the look found that the one before it did not. Look 0 only notes what is there.

    A deleted file is no change; one that comes back after a look without it is created. An empty file is
    created when it gets its first bytes. Files are told
    apart by length and time of writing, so one written twice between two looks is one change, and one
    whose length stays the same must differ in time by the file system's unit.
    """
    now = _stored(spark, directory, state, look)
    if look == 0:
        return now.select(F.lit("").alias("kind"), "*").limit(0)
    before = _read(spark, state, look - 1)
    same = [F.col("path"), F.col("length").alias("_length"), F.col("modified").alias("_modified")]
    known = now.join(before.select(*same), "path", "left")
    moved = (F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified"))
    kind = F.when(F.col("_length").isNull(), "created").when(moved, "modified")
    return known.select(kind.alias("kind"), "path", "length", "modified").where("kind IS NOT NULL")


def write_changes(
    spark: SparkSession, directory: str, state: str, look: int, out: Topic, producer: str
) -> None:
    """Publish the changes of a look; a repeated one changes nothing. Listings older than the one
    before are removed."""
    out.write_batch(changes_at(spark, directory, state, look), producer, look)
    if look >= 2:
        delete_path(spark, _folder(state, look - 2))


def watch_stream(
    spark: SparkSession,
    directory: str,
    out: Topic,
    checkpoint: str,
    producer: str,
    every: str = "5 seconds",
) -> StreamingQuery:
    """Look at the directory at every tick until stopped; a restart goes on from the last look."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def each(_ticks: DataFrame, batch_id: int) -> None:
        write_changes(spark, directory, f"{checkpoint}/looks", batch_id, out, producer)

    return start(ticks, each, checkpoint, {"processingTime": every})


def _folder(state: str, look: int) -> str:
    return f"{state}/look={look}"


def _read(spark: SparkSession, state: str, look: int) -> DataFrame:
    return spark.read.schema(LISTING).parquet(_folder(state, look))


def _stored(spark: SparkSession, directory: str, state: str, look: int) -> DataFrame:
    if not path_exists(spark, _folder(state, look)):
        staged = f"{state}/_staged-{uuid.uuid4().hex}"
        list_files(spark, directory).write.parquet(staged)
        if not move_path(spark, staged, _folder(state, look)):
            delete_path(spark, staged)
    return _read(spark, state, look)
