"""Landing directories: JSON files of any layout, delimited files, raw bytes."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from millrace.functions.codec import decode_dead_letter, decode_skip
from millrace.session import materialized, scratch_scope
from millrace.sources.framing import framed, framed_bodies
from millrace.sources.topics import ANY_AGE, start

BIG_FILE = 256 * 1024 * 1024
"""Files above this size are framed block by block, even where they are read in one block."""

COMPRESSED = r"\.(gz|bz2|zst|zstd|snappy|lz4|deflate|xz)\z"
"""Files whose size on disk says nothing about their last byte; it is taken to be a `}`."""

_SCAN = [
    "value",
    "_metadata.file_path AS path",
    "_metadata.file_size AS size",
    "_metadata.file_block_start AS block",
    "_metadata.file_block_length AS length",
]


def read_json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every `}`, so that neither long lines nor large files are one row."""
    return spark.read.option("lineSep", "}").text(path).selectExpr(*_SCAN)


def stream_json_pieces(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """As `read_json_pieces`, each file once; frame the pieces inside `foreachBatch`."""
    reader = spark.readStream.option("lineSep", "}").option("maxFileAge", ANY_AGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).selectExpr(*_SCAN)


class FramedJson(NamedTuple):
    """`objects`: (path, position, body). `rejects`: (path, position, body, reason), text that is no object.
    The position is the byte of the file the text begins at."""

    objects: DataFrame
    rejects: DataFrame


def frame_json_checked(pieces: DataFrame, big_file: int = BIG_FILE) -> FramedJson:
    """The objects of each file, and what of damaged files is none: records that never close, and text outside
    any object but for separators and a lone brace that ends the file. One bad record costs itself and not what
    follows; see `millrace.sources.framing`. Both come from one pass, which is written to scratch.
    """
    items = materialized(framed(pieces, big_file, COMPRESSED), "framed")
    return FramedJson(items.where("reason IS NULL").drop("reason"), items.where("reason IS NOT NULL"))


def frame_json(pieces: DataFrame, big_file: int = BIG_FILE) -> DataFrame:
    """(path, position, body): the top-level objects of each file.

    Accepts one object per file, arrays, objects in a row and one per line. Braces and quotes inside strings do
    not count. What is no object is left out; see `frame_json_checked`. Files above `big_file` bytes, and all
    that Spark reads in several blocks, are scanned once more for the state each block starts from.
    """
    return framed(pieces, big_file, COMPRESSED).where("reason IS NULL").drop("reason")


def ingest_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All records of a landing directory as they are now; undecodable ones are skipped. See
    `ingest_json_checked` for what was skipped."""
    objects = frame_json(read_json_pieces(spark, path))
    return decode_skip(objects, "body", schema).drop("path", "position")


def ingest_json_checked(
    spark: SparkSession, path: str, schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a landing directory: rejects are (path, position, body, reason) of
    unframed text and of objects that do not decode."""
    return _decoded(frame_json_checked(read_json_pieces(spark, path)), schema)


def _decoded(framed: FramedJson, schema: StructType) -> tuple[DataFrame, DataFrame]:
    records, undecoded = decode_dead_letter(framed.objects, "body", schema)
    rejects = framed.rejects.unionByName(undecoded.select("path", "position", "body", "reason"))
    return records.drop("path", "position"), rejects


def ingest_json_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    max_files_per_trigger: int | None = None,
    trigger: dict | None = None,
    rejects: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Feed each landed file to `sink(records, batch_id)` once, new files as they come, and what
    is no record to `rejects(frame, batch_id)`, if given."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not rejects:
            sink(decode_skip(frame_json(batch), "body", schema).drop("path", "position"), batch_id)
            return
        with scratch_scope(spark):
            records, rejected = _decoded(frame_json_checked(batch), schema)
            sink(records, batch_id)
            rejects(rejected, batch_id)

    return start(stream_json_pieces(spark, path, max_files_per_trigger), each, checkpoint, trigger)


def ingest_json_replayed(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str = "5 seconds",
) -> StreamingQuery:
    """Re-list the directory at every tick and emit all of its files again, until stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def each(_ticks: DataFrame, batch_id: int) -> None:
        sink(ingest_json(spark, path, schema), batch_id)

    return start(ticks, each, checkpoint, {"processingTime": every})


def accept_bodies(
    bodies: DataFrame, body: str, schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """(accepted records, rejected bodies with a reason). An empty body is rejected."""
    return decode_dead_letter(bodies, body, schema)


def accept_elements(
    bodies: DataFrame, row_id: str, body: str, schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """Bodies of any number of JSON objects, as an array, one per line or in a row, in any layout: (`row_id`,
    `position` and the fields of each object that decodes, `row_id`, `position`, `body` and `reason` of whatever
    does not). The position is the byte of the body the text begins at; a bad element costs itself and not what
    follows. A body without any text is rejected at position 0; an empty array has neither records nor rejects.
    """
    found = framed_bodies(bodies, row_id, body)
    objects = found.where("reason IS NULL").drop("reason")
    records, undecoded = decode_dead_letter(objects, "body", schema)
    absent = F.col(body).isNull() | ~F.col(body).rlike(r"\S")
    columns = [row_id, "position", "body", "reason"]
    without = bodies.where(absent).select(
        row_id, F.lit(0).cast("long").alias("position"), F.col(body).cast("string").alias("body"), F.lit("no value").alias("reason")
    )
    rejects = found.where("reason IS NOT NULL").select(columns).unionByName(undecoded.select(columns))
    return records, rejects.unionByName(without)


def read_whole_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One body per file, as `path` and `body`; a body must fit a task."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One body per line, empty ones included."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("body"))


def delimited_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, DoubleType()) for c in columns])


def read_delimited(
    spark: SparkSession, path: str, columns: list[str], datatype: str = "wine", sep: str = ";"
) -> DataFrame:
    """Numeric records by position, values trimmed, plus a defaulted `datatype` column. A line
    with a malformed number or too few or too many fields fails the read."""
    rows = (
        spark.read.schema(delimited_schema(columns))
        .option("sep", sep)
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.select(F.lit(datatype).alias("datatype"), *columns)


def split_delimited(
    spark: SparkSession, path: str, columns: list[str], datatype: str = "wine", sep: str = ";"
) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines as `line`). Fields are unquoted; an empty one is NULL, a blank
    line is none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.transform(F.split("value", re.escape(sep), -1), lambda f: F.trim(f))
    rows = lines.select(
        F.col("value").alias("line"), fields.alias("f"), F.transform(fields, lambda f: f.try_cast("double")).alias("n")
    )
    unread = F.exists(F.zip_with("f", "n", lambda f, n: (f != "") & n.isNull()), lambda x: x)
    sound = (F.size("f") == len(columns)) & ~unread
    values = [F.try_element_at("n", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)]
    good = rows.where(sound).select(F.lit(datatype).alias("datatype"), *values)
    return good, rows.where(~sound).select("line")


def read_bytes(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """Undecoded record values from Parquet: a BINARY column, for the caller to interpret."""
    stored = spark.read.schema(f"{value} binary").option("recursiveFileLookup", "true")
    return stored.parquet(path)


def bytes_schema() -> StructType:
    return StructType([StructField("value", BinaryType())])
