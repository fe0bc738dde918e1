"""Topics: typed, append-only Parquet directories that connect stages.

Layout: `<path>/producer=<name>/batch_id=<id>/*.parquet`. A batch is written to a hidden folder
and published by renaming it, so readers see a batch whole or not at all, and one that is
published twice is there once. The rename is one step on HDFS and local disks; an object store
needs a committer that makes it so. Readers list the files below `<path>`.

Each record carries `_key` (text of the partitioning column, NULL without one) and
`_partition`. Records of one key share a partition number; a partition with much data is
spread over several files, so a hot key never becomes one task's work.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    ArrayType,
    DataType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from millrace.session import delete_path, list_folders, make_dirs, move_path, path_exists

ANY_AGE = "36500d"
"""Spark's file source leaves out files much older than the newest one it has seen; this is
longer than any file's age, so none is left out. The source then remembers every path it took."""

KEY = "_key"
PARTITION = "_partition"


def partition_of(key: Column, partitions: int) -> Column:
    """Partition number of a key; the same key always gets the same one."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def optional(kind: DataType) -> DataType:
    """The type with everything inside it nullable, as Parquet gives it back."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, optional(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(optional(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(optional(kind.keyType), optional(kind.valueType))
    return kind


@dataclass(frozen=True)
class Topic:
    """`key` names the partitioning column; without one records are dealt out evenly."""

    path: str
    schema: StructType
    key: str | None = None
    partitions: int = 8

    @property
    def stored(self) -> StructType:
        return StructType(
            [
                *[StructField(f.name, optional(f.dataType)) for f in self.schema.fields],
                StructField(KEY, StringType()),
                StructField(PARTITION, IntegerType()),
            ]
        )

    # -- reading ---------------------------------------------------------------------

    def read(self, spark: SparkSession, with_key: bool = False) -> DataFrame:
        """Everything in the topic now. Reading again starts from the earliest record."""
        make_dirs(spark, self.path)
        stored = spark.read.schema(self.stored).option("recursiveFileLookup", "true")
        return self._columns(stored.parquet(self.path), with_key)

    def read_stream(
        self,
        spark: SparkSession,
        position: str = "earliest",
        max_files_per_trigger: int | None = None,
        with_key: bool = False,
    ) -> DataFrame:
        """The topic as a stream. Where it resumes is up to the checkpoint of the query.

        `latest` passes only batches published from now on, whenever they were written: the
        folders that are there now are noted, and Spark prunes their files by path unopened.
        """
        make_dirs(spark, self.path)
        reader = spark.readStream.schema(self.stored).option("recursiveFileLookup", "true")
        reader = reader.option("maxFileAge", ANY_AGE)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        stream = reader.parquet(self.path)
        if position == "latest":
            published = list_folders(spark, f"{self.path}/producer=*/batch_id=*")
            names = ["/".join(p.rsplit("/", 2)[1:]) for p in published]
            folder = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)/[^/]+$", 1)
            stream = stream.where(~folder.isin(names)) if names else stream
        elif position != "earliest":
            raise ValueError(f"unknown position: {position}")
        return self._columns(stream, with_key)

    def _columns(self, df: DataFrame, with_key: bool) -> DataFrame:
        extra = [KEY, PARTITION] if with_key else []
        return df.select(*[f.name for f in self.schema.fields], *extra)

    # -- writing ---------------------------------------------------------------------

    def arranged(self, df: DataFrame) -> DataFrame:
        """Records with key and partition, laid out for writing."""
        rows = df.select(
            *[F.col(f.name).cast(optional(f.dataType)).alias(f.name) for f in self.schema.fields]
        )
        if self.key is None:
            # Each writing task deals its records out in turn; nothing is shuffled.
            turn = F.pmod(F.monotonically_increasing_id(), F.lit(self.partitions)).cast("int")
            return rows.withColumns({KEY: F.lit(None).cast("string"), PARTITION: turn})
        keyed = rows.withColumn(KEY, F.col(self.key).cast("string"))
        placed = keyed.withColumn(PARTITION, partition_of(F.col(KEY), self.partitions))
        # Rebalancing keeps a partition's records together but splits an oversized one.
        return placed.hint("rebalance", F.col(PARTITION))

    def write(self, df: DataFrame, producer: str = "plain") -> None:
        """Append a batch frame once, without a commit to replay from."""
        self.write_batch(df, producer, uuid.uuid4().hex)

    def write_batch(self, df: DataFrame, producer: str, batch_id: int | str) -> None:
        """Write a micro-batch; a replay of a committed one changes nothing."""
        if path_exists(df.sparkSession, self._folder(producer, batch_id)):
            # Run it all the same: stateful operators upstream must see each batch through.
            df.write.format("noop").mode("overwrite").save()
            return
        self.publish(df.sparkSession, self.stage(df), producer, batch_id)

    def _folder(self, producer: str, batch_id: int | str) -> str:
        return f"{self.path}/producer={producer}/batch_id={batch_id}"

    def stage(self, df: DataFrame) -> str:
        """Write records where no reader looks; returns the folder to `publish`."""
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        self.arranged(df).write.parquet(staged)
        return staged

    def publish(self, spark: SparkSession, staged: str, producer: str, batch_id: int | str) -> None:
        """Show a staged batch to readers; one that is published already stays as it is."""
        if not move_path(spark, staged, self._folder(producer, batch_id)):
            delete_path(spark, staged)


@dataclass(frozen=True)
class Group:
    """A consumer group: its checkpoint remembers what has been read.

    Replicas of a stage share a group and thus the data; different stages, or unique
    groups, each see all of it.
    """

    base: str
    app: str
    stage: str
    inlet: str
    unique: bool = False

    @property
    def id(self) -> str:
        return ".".join([self.app, self.stage, self.inlet])

    def checkpoint(self) -> str:
        """Where the offsets live. A unique group gets a new place on every call."""
        suffix = f"-{uuid.uuid4().hex}" if self.unique else ""
        return f"{self.base}/groups/{self.id}{suffix}"


def write_stream(
    stream: DataFrame, topic: Topic, checkpoint: str, producer: str, trigger: dict | None = None
) -> StreamingQuery:
    """Committed write: the source offsets are committed after each micro-batch is stored.

    A crash between the two replays the batch into the same folder. A producer must keep
    its checkpoint; use another producer name with a new one.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        topic.write_batch(batch, producer, batch_id)

    return start(stream, commit, checkpoint, trigger)


def write_stream_plain(stream: DataFrame, topic: Topic, scratch: str) -> StreamingQuery:
    """At-most-once write: a throw-away checkpoint and producer, nothing to resume from."""
    run = uuid.uuid4().hex
    return write_stream(stream, topic, f"{scratch}/{run}", f"plain-{run}")


def drain(stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Commit-only sink: read and drop, advance the offsets."""
    return (
        stream.writeStream.format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start(stream, each_batch, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run `each_batch(frame, batch_id)` on every micro-batch; by default until caught up."""
    return (
        stream.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


@dataclass(frozen=True)
class KafkaTopic:
    """The same record flow over Kafka, for sessions that have Spark's Kafka connector.

    Values are JSON. `connection` and `settings` are client options; later ones win.
    """

    name: str
    servers: str
    key: str | None = None
    connection: tuple[tuple[str, str], ...] = ()
    settings: tuple[tuple[str, str], ...] = ()

    def options(self) -> dict[str, str]:
        merged = {"bootstrap.servers": self.servers, **dict(self.connection), **dict(self.settings)}
        return {f"kafka.{k}": v for k, v in merged.items()}

    def read_stream(
        self, spark: SparkSession, position: str = "earliest", max_offsets: int | None = None
    ) -> DataFrame:
        """Raw `key` and `value` bytes; decode `value` with the codec."""
        reader = spark.readStream.format("kafka").options(**self.options())
        reader = reader.option("subscribe", self.name).option("startingOffsets", position)
        if max_offsets:
            reader = reader.option("maxOffsetsPerTrigger", max_offsets)
        return reader.load().select("key", "value")

    def write_stream(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        key = F.col(self.key).cast("string") if self.key else F.lit(None).cast("string")
        rows = stream.select(key.alias("key"), F.to_json(F.struct("*")).alias("value"))
        writer = rows.writeStream.format("kafka").options(**self.options())
        return writer.option("topic", self.name).option("checkpointLocation", checkpoint).start()
