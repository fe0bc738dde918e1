"""Replicas of a stage: members of one consumer group that share the records of a topic.

The group keeps one position per topic partition, a checkpoint each. A member reads the partitions that
fall to it and continues each from the group's position, whoever read it before; so members may come and
go. Two members that hold a partition at the same time, as during a handover, do no harm: a batch is
published once under the partition's own producer name, and Spark lets one of the two commit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.topics import PARTITION, Group, Topic, write_stream


@dataclass(frozen=True)
class Replica:
    """Member `number`, counted from 0, of the `members` that a group has now."""

    group: Group
    number: int
    members: int

    def __post_init__(self) -> None:
        if self.group.unique:
            raise ValueError("members of unique groups share nothing")
        if not 0 <= self.number < self.members:
            raise ValueError(f"member {self.number} of {self.members}")

    def partitions(self, topic: Topic) -> range:
        """Each partition falls to one member; with more members than partitions some have none."""
        return range(self.number, topic.partitions, self.members)

    def read_stream(
        self, spark: SparkSession, topic: Topic, partition: int, max_files_per_trigger: int | None = None
    ) -> DataFrame:
        """The records of one partition. The condition reaches the Parquet scan."""
        stream = topic.read_stream(spark, max_files_per_trigger=max_files_per_trigger, with_key=True)
        return stream.where(F.col(PARTITION) == partition).drop("_key", PARTITION)

    def write_stream(
        self,
        spark: SparkSession,
        source: Topic,
        process: Callable[[DataFrame], DataFrame],
        out: Topic,
        max_files_per_trigger: int | None = None,
        trigger: dict | None = None,
    ) -> list[StreamingQuery]:
        """Run `process` over this member's share into `out`, a query per partition, side by side.

        By default the queries end when they have caught up; with a trigger they run until stopped.
        """
        base = self.group.checkpoint()
        return [
            write_stream(
                process(self.read_stream(spark, source, partition, max_files_per_trigger)),
                out,
                f"{base}/partition={partition}",
                f"{self.group.id}.{partition}",
                trigger,
            )
            for partition in self.partitions(source)
        ]
