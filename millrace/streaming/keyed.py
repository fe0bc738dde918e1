"""Keyed state in Spark's state store: totals and waiting records per key, handed to each micro-batch.

What a batch adds to a key is the same in whatever order its records come, so tasks add it up before
anything is shuffled: one entry per key and part of a task's input, whatever the key's share of the data.
Keys are dealt to buckets by hash, and a stateful processor handles a bucket at a time, all of its keys in
a few array operations: it adds the entries to the state of the bucket and gives what its keys had before.
The records themselves do not pass through it; they meet what it gives in the same micro-batch, where the
batch operators put them in order and spread hot keys.

The state store keeps a version per micro-batch with the checkpoint of the query, so a replayed batch starts
from what it started from before, and a batch reads and writes the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, LongType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

KIND, TOTAL, COUNT, TOTALS, ROWS = "keyed_kind", "keyed_sum", "keyed_count", "keyed_totals", "keyed_rows"
"""Columns of a flow beside those of the stream. Names with a leading underscore do not reach a processor."""

BUCKET, CHANGED = "keyed_bucket", "keyed_changed"

RECORD, BEFORE = 0, 1
"""Kinds of rows of a micro-batch: a record, and what the keys of a bucket had before the batch."""

BUCKETS = 1024
"""Parts the keys are dealt to. A batch that touches one key reads and writes the state of its bucket, so flows of
very many keys and small batches want more. A checkpoint must keep its number."""

PART_ROWS, PART_BYTES = 200_000, 32 << 20
"""A task adds up its records in parts that reach so many rows or bytes."""


class KeyTotals(StatefulProcessor):
    """Per key a sum, a count and up to `keep` - 1 waiting records: the last of all so far, as many as are
    over when they are counted off in runs of `keep`. For each bucket a batch touches there is one row with what
    the keys of the batch had before it; keys that are new, or count nothing yet, are not in it."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], keep: int, ttl_ms: int | None = None):
        self.keys, self.order, self.keep, self.ttl_ms = list(keys), list(order), keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value, so that a bucket costs one reading and one writing.
        self.state = handle.getValueState("totals", f"{TOTALS} binary, {ROWS} binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        parts = list(rows)
        added = [unpacked(b) for part in parts for b in part[TOTALS]]
        added = pa.concat_tables([t.append_column(CHANGED, pa.array(np.full(len(t), now))) for t in added])
        had, waited = self._stored(now, added.schema)
        table = pa.concat_tables([had, added])
        records = None
        if self.keep > 1:
            last = [unpacked(b) for part in parts for b in part[ROWS]]
            records = pa.concat_tables([*([] if waited is None else [waited]), *last])
        known = [t.select(self.keys) for t in (table, records) if t is not None]
        group, first = groups(pa.concat_tables(known), self.keys)
        size, old, group, of_record = len(first), len(had), group[: len(table)], group[len(table) :]

        def summed(column: str, rows: slice) -> np.ndarray:
            values = table.column(column).to_numpy()[rows]
            out = np.zeros(size, values.dtype)
            np.add.at(out, group[rows], values)
            return out

        touched = np.zeros(size, bool)
        touched[group[old:]] = True
        changed = np.zeros(size, np.int64)
        changed[group] = table.column(CHANGED).to_numpy()
        whole = slice(None)
        sums, counts = summed(TOTAL, whole), summed(COUNT, whole)
        sums_before, counts_before = summed(TOTAL, slice(old)), summed(COUNT, slice(old))
        names = table.select(self.keys).take(pa.array(first))
        self.state.update(
            (
                packed(with_columns(names, {TOTAL: sums, COUNT: counts, CHANGED: changed})),
                None if records is None else self._left(records, of_record, waited, counts % self.keep),
            )
        )
        before = with_columns(names, {TOTAL: sums_before, COUNT: counts_before})
        told = before.filter(pa.array(touched & (counts_before > 0)))
        waiting = None
        if waited is not None:
            of_waiting = of_record[: len(waited)]
            # What waits of a key lies together, in order, up to its count.
            numbers = counts_before[of_waiting] - ahead(of_waiting)
            waiting = with_columns(waited.drop_columns(self.keys), {COUNT: numbers})
            waiting = waiting.filter(pa.array(touched[of_waiting]))
        yield pd.DataFrame(
            {
                KIND: [BEFORE],
                TOTALS: [packed(told) if len(told) else None],
                ROWS: [packed(waiting) if waiting is not None and len(waiting) else None],
            }
        )

    def _stored(self, now: int, schema: pa.Schema) -> tuple[pa.Table, pa.Table | None]:
        """Totals and waiting records of the bucket; those of keys that have outlived their time are left out."""
        totals, waited = self.state.get() or (None, None)
        had = schema.empty_table() if totals is None else unpacked(totals)
        waited = None if waited is None else unpacked(waited)
        if self.ttl_ms is None:
            return had, waited
        live = had.column(CHANGED).to_numpy() + self.ttl_ms > now
        if waited is not None and not live.all():
            group, _ = groups(pa.concat_tables([t.select(self.keys) for t in (had, waited)]), self.keys)
            lives = np.zeros(len(had), bool)
            lives[group[: len(had)]] = live
            waited = waited.filter(pa.array(lives[group[len(had) :]]))
        return had.filter(pa.array(live)), waited

    def _left(self, records: pa.Table, group: np.ndarray, waited: pa.Table | None, over: np.ndarray) -> bytes | None:
        """The last records of each key, as many as are `over`. What waited came before all of the batch, so
        it is in front."""
        held = 0 if waited is None else len(waited)
        turn = np.minimum(np.arange(len(records)), held)
        left = last_rows(records, group, ["_turn", *self.order], over, {"_turn": turn})
        return packed(left) if len(left) else None

    def close(self) -> None:
        pass


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Table:
    with pa.ipc.open_stream(bytes(raw)) as source:
        return source.read_all()


def with_columns(table: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values))
    return table


def groups(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the group of each row, a row of each group); NULL is a key."""
    numbered = with_columns(table.select(keys), {"_at": np.arange(len(table))})
    lists = numbered.group_by(list(keys), use_threads=False).aggregate([("_at", "list")]).column("_at_list")
    lists = lists.combine_chunks()
    sizes, rows = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    group = np.empty(len(table), np.int64)
    group[rows] = np.repeat(np.arange(len(sizes)), sizes)
    return group, rows[np.cumsum(sizes) - sizes]


def ahead(group: np.ndarray) -> np.ndarray:
    """For each row the number of rows of its group behind it; the rows of a group lie together."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1) if len(group) else group
    sizes = np.diff(ends, prepend=-1)
    return np.repeat(ends, sizes) - np.arange(len(group))


def last_rows(
    table: pa.Table, group: np.ndarray, order: Sequence[str], most: np.ndarray, more: dict[str, np.ndarray]
) -> pa.Table:
    """The last rows of each group by the order columns, in that order, `most[group]` of them; NULLs come first, as
    Spark sorts them. `more` holds order columns that are not in the table."""
    sortable = with_columns(table, {"_group": group, **more})
    by = [(c, "ascending") for c in ("_group", *order)]
    at = pc.sort_indices(sortable, sort_keys=by, null_placement="at_start").to_numpy()
    own = group[at]
    return table.take(pa.array(at[ahead(own) < most[own]]))


@dataclass(frozen=True)
class Batch:
    """A micro-batch: its records, and what their keys had before (`keys`, sum, count, and waiting records)."""

    records: DataFrame
    before: DataFrame
    waiting: DataFrame


class KeyedFlow:
    """A stream whose micro-batches come with the state of their keys.

    `amount` and `counts` are what a record adds to the sum and to the count of its key. With `keep` above 1 the
    records left over from runs of `keep` records wait in the state, the last by `order`; `counts` must be 1 for
    each record then. State is dropped `ttl_ms` after a key's last change, if given.
    """

    def __init__(
        self,
        stream: DataFrame,
        keys: Sequence[str],
        amount: Column,
        counts: Column,
        order: Sequence[str] = (),
        keep: int = 1,
        ttl_ms: int | None = None,
        buckets: int = BUCKETS,
    ):
        self.columns, self.keys, self.keep = stream.columns, list(keys), keep
        self.schema = stream.schema
        use_rocks(stream.sparkSession)
        self.own = [f"key{i}" for i in range(max(1, len(self.keys)))]
        key = [one_spelling(k, self.schema[k].dataType).alias(name) for k, name in zip(self.keys, self.own)]
        key = key or [F.lit(0).alias(self.own[0])]
        self.fields = list(stream.select(*key).schema.fields)
        record = F.struct(*[F.col(c) for c in self.columns]) if keep > 1 else F.lit(None).cast("int")
        blobs = [StructField(TOTALS, BinaryType()), StructField(ROWS, BinaryType())]
        bucketed = StructType([StructField(BUCKET, LongType()), *blobs])
        added = stream.select(
            F.struct(*key).alias("key"),
            F.coalesce(amount.cast("double"), F.lit(0.0)).alias(TOTAL),
            F.coalesce(counts.cast("long"), F.lit(0)).cast("long").alias(COUNT),
            record.alias("record"),
        )
        added = added.withColumn(BUCKET, F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long"))
        added = added.mapInArrow(_added_up(bucketed, self.own, list(order), keep), bucketed)
        told = added.groupBy(BUCKET).transformWithStateInPandas(
            statefulProcessor=KeyTotals(self.own, order, keep, ttl_ms),
            outputStructType=StructType([StructField(KIND, LongType()), *blobs]),
            outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
        self.flow = stream.withColumn(KIND, F.lit(RECORD).cast("long")).unionByName(told, allowMissingColumns=True)

    def divided(self, batch: DataFrame) -> Batch:
        """The parts of a micro-batch of `flow`. It must have been persisted: a state processor runs once."""
        records = batch.where(F.col(KIND) == RECORD).select(*self.columns)
        told = batch.where(F.col(KIND) == BEFORE)
        number = StructField(COUNT, LongType())
        before = _opened(told, TOTALS, StructType([*self.fields, StructField(TOTAL, DoubleType()), number]))
        named = [F.col(name).alias(k) for k, name in zip(self.keys, self.own)]
        waiting = _opened(told, ROWS, StructType([*self.schema.fields, number]))
        return Batch(records, before.select(*named, TOTAL, COUNT), waiting)


def one_spelling(key: str, kind: DataType) -> Column:
    """A key column whose equal values have equal bits: of zeros and NaNs, which Spark groups as one, one each."""
    value = F.col(key)
    if not isinstance(kind, (FloatType, DoubleType)):
        return value
    return F.when(F.isnan(value), F.lit(float("nan")).cast(kind)).otherwise(value + F.lit(0.0).cast(kind))


def _opened(told: DataFrame, column: str, schema: StructType) -> DataFrame:
    """The rows that lie packed in a column."""
    names = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                table = unpacked(raw.as_buffer())
                columns = [table.column(f.name).cast(f.type).combine_chunks() for f in names]
                yield pa.RecordBatch.from_arrays(columns, schema=names)

    return told.where(F.col(column).isNotNull()).select(column).mapInArrow(run, schema)


def _added_up(schema: StructType, keys: list[str], order: list[str], keep: int):
    """One row per bucket and part of a task's input: what the records add to each key, and the last `keep` - 1
    of each."""
    out = to_arrow_schema(schema)

    def added(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        names = pa.table(table.column("key").combine_chunks().flatten(), names=keys)
        bucket = table.column(BUCKET).to_numpy()
        group, first = groups(names, keys)
        sums, counts = np.zeros(len(first)), np.zeros(len(first), np.int64)
        np.add.at(sums, group, table.column(TOTAL).to_numpy())
        np.add.at(counts, group, table.column(COUNT).to_numpy())
        totals = with_columns(names.take(pa.array(first)), {TOTAL: sums, COUNT: counts})
        own, blobs = _by_bucket(totals, bucket[first])
        rows = pa.nulls(len(own), out.field(ROWS).type)
        if keep > 1:
            record = table.column("record").combine_chunks()
            records = pa.Table.from_arrays(
                [*names.columns, *record.flatten()], names=[*keys, *(f.name for f in record.type)]
            )
            records = with_columns(records, {BUCKET: bucket})
            last = last_rows(records, group, order, np.full(len(first), keep - 1), {})
            rows = _by_bucket(last.drop_columns([BUCKET]), last.column(BUCKET).to_numpy())[1]
        arrays = [pa.array(c, f.type) for c, f in zip((own, blobs, rows), out)]
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                part.append(batch)
            if sum(map(len, part)) >= PART_ROWS or sum(b.nbytes for b in part) >= PART_BYTES:
                yield added(part)
                part = []
        if part:
            yield added(part)

    return run


def _by_bucket(table: pa.Table, bucket: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(the buckets, in order, the packed rows of each)."""
    at = np.argsort(bucket, kind="stable")
    table, (own, starts) = table.take(pa.array(at)), np.unique(bucket[at], return_index=True)
    ends = [*starts[1:].tolist(), len(table)]
    return own, [packed(table.slice(a, b - a)) for a, b in zip(starts.tolist(), ends)]


def use_rocks(spark: SparkSession) -> None:
    """State of any size lies on the disks of the executors and, by version, with the checkpoint."""
    spark.conf.set(PROVIDER, ROCKS)
