"""Wire named stages through named topics and run them as one batch plan or as streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.transforms import merge
from millrace.sources.topics import Group, Topic, start
from millrace.streaming.sinks import write_many
from millrace.streaming.supervise import Supervisor

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A function from inlet frames and a config to outlet frames.

    `inlets` and `outlets` bind port names to topic names. The same function may serve
    several stages with different bindings and configs. Stages must not keep state
    between calls; stateful flows have their own streaming operators.
    """

    name: str
    process: Callable[[Frames, Mapping[str, Any]], Frames]
    inlets: Mapping[str, str] = field(default_factory=dict)
    outlets: Mapping[str, str] = field(default_factory=dict)
    config: Mapping[str, Any] = field(default_factory=dict)

    def run(self, inputs: Frames) -> Frames:
        outputs = self.process(inputs, self.config)
        if set(outputs) != set(self.outlets):
            raise ValueError(f"{self.name}: wrote {sorted(outputs)}, declared {sorted(self.outlets)}")
        return outputs


@dataclass(frozen=True)
class Application:
    """Stages in an order where producers come before their consumers."""

    name: str
    stages: tuple[Stage, ...]

    def __post_init__(self) -> None:
        names = [s.name for s in self.stages]
        if len(set(names)) != len(names):
            raise ValueError(f"stage names must be unique: {names}")
        for i, stage in enumerate(self.stages):
            later = {t for s in self.stages[i:] for t in s.outlets.values()}
            early = sorted(set(stage.inlets.values()) & later)
            if early:
                raise ValueError(f"{stage.name} reads {early} before they are produced")

    def run_batch(
        self, spark: SparkSession, inputs: Frames, stored: Mapping[str, Topic] | None = None
    ) -> Frames:
        """Every topic as a frame. Stages fuse into one lazy plan, except that topics named
        in `stored` are written first and consumers read them back."""
        topics: Frames = dict(inputs)
        for stage in self.stages:
            outputs = stage.run({port: topics[t] for port, t in stage.inlets.items()})
            for port, topic in stage.outlets.items():
                known = topics.get(topic)
                topics[topic] = merge(known, outputs[port]) if known is not None else outputs[port]
                if stored and topic in stored:
                    stored[topic].write(outputs[port], f"{stage.name}.{port}")
                    topics[topic] = stored[topic].read(spark)
        return topics

    def run_stream(
        self,
        spark: SparkSession,
        base: str,
        topics: Mapping[str, Topic],
        max_files_per_trigger: int | None = None,
        trigger: dict | None = None,
        restarts: int = 0,
    ) -> list[StreamingQuery]:
        """One streaming query per stage; calling it again continues from the checkpoints below
        `base`.

        Without a trigger every stage is brought up to date with its inlets, producers first,
        and the queries returned have ended; a stage that fails is started again up to `restarts`
        times, and `StageFailed` is raised before its consumers start. With one all stages run side
        by side until stopped; `supervised` watches over them.
        """
        queries = []
        for name, begin in self._starts(spark, base, topics, max_files_per_trigger, trigger).items():
            if trigger is not None:
                queries.append(begin())
            elif restarts:
                queries.append(Supervisor({name: begin}, restarts, pause=0.0).run()[name])
            else:
                queries.append(begin())
                queries[-1].awaitTermination()
        return queries

    def supervised(
        self,
        spark: SparkSession,
        base: str,
        topics: Mapping[str, Topic],
        max_files_per_trigger: int | None = None,
        trigger: dict | None = None,
        restarts: int = 3,
        pause: float = 1.0,
    ) -> Supervisor:
        """All stages side by side under a supervisor: `run()` starts them, restarts those that fail from
        their checkpoints, and stops the others when one fails too often."""
        return Supervisor(self._starts(spark, base, topics, max_files_per_trigger, trigger), restarts, pause)

    def _starts(
        self, spark, base, topics, max_files_per_trigger, trigger
    ) -> dict[str, Callable[[], StreamingQuery]]:
        def begin(stage: Stage) -> Callable[[], StreamingQuery]:
            return lambda: self._stage_query(spark, stage, base, topics, max_files_per_trigger, trigger)

        return {stage.name: begin(stage) for stage in self.stages if stage.inlets}

    def _stage_query(
        self, spark, stage, base, topics, max_files_per_trigger, trigger
    ) -> StreamingQuery:
        ports = list(stage.inlets)
        # One stream carries all inlets, each in its own struct column, so that a stage has
        # one checkpoint and its outlets are committed together.
        tagged = [
            topics[stage.inlets[port]]
            .read_stream(spark, max_files_per_trigger=max_files_per_trigger)
            .select(F.lit(port).alias("port"), F.struct("*").alias(port))
            for port in ports
        ]
        stream = tagged[0]
        for other in tagged[1:]:
            stream = stream.unionByName(other, allowMissingColumns=True)

        def each(batch: DataFrame, batch_id: int) -> None:
            batch.persist()
            try:
                inputs = {p: batch.where(F.col("port") == p).select(f"{p}.*") for p in ports}
                outputs = stage.run(inputs)
                for port, topic in stage.outlets.items():
                    write_many([(outputs[port], topics[topic])], f"{stage.name}.{port}", batch_id)
            finally:
                batch.unpersist()

        checkpoint = Group(base, self.name, stage.name, "+".join(ports)).checkpoint()
        return start(stream, each, checkpoint, trigger)
