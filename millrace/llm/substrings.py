"""Removal of repeated word windows by level-wise doubling.

A window of `size` words can only be repeated if the shorter windows in it are. At each level the
smallest hashed gram of the level's length stands for a window; only windows whose gram is found in
other documents go on to the level of twice the length, until the length is that of the window or
none is left. On the last level consecutive windows under one number form a run; a number with one
distinct run is settled by that run's first document, the others window by window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_schema, byte_slices, gram_hashes, map_text, mix, sliding_min, stored, word_numbers
from millrace.llm.registry import query, table

SIZE = 13
FIRST = 7
"""Length of the first level; shorter ones repeat by chance and weed out little."""


def levels(size: int, first: int) -> list[int]:
    """Lengths before `size`, each twice the one before."""
    out = []
    while first < size:
        out.append(first)
        first *= 2
    return out or [max(1, size - 1)]


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    sought = np.sort(wanted.view(np.uint64))
    if not len(sought) or not len(values):
        return np.zeros(len(values), dtype=bool)
    return sought[np.minimum(np.searchsorted(sought, values), len(sought) - 1)] == values


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of numbers in a column."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _set_lists(piece: dict) -> list[list[np.ndarray]]:
    """For each text of a slice the shared grams of the levels it has passed."""
    if "_sets" not in piece:
        return [[]] * len(piece["_text"])
    inner, ends = _lists(piece["_sets"].values), piece["_sets"].offsets.to_pylist()
    return [inner[a:b] for a, b in zip(ends, ends[1:])]


class Windows:
    """The windows of `size` words of some texts laid end to end: the text each starts in, whether it
    lies in that text whole and has passed the levels, and its smallest gram of the level's length."""

    def __init__(self, words: np.ndarray, bounds: list[int], sets: list[list[np.ndarray]], lengths: list[int], level: int, size: int):
        self.words, self.bounds, self.size = words, bounds, size
        self.n = max(0, len(words) - size + 1)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.doc = doc[: self.n]
        self.live = self.doc == doc[len(words) - self.n :]
        self.slices = [slice(a, max(a, b - size + 1)) for a, b in zip(bounds, bounds[1:])]
        lows = [self._lowest(length) for length in lengths[: max([level + 1, *map(len, sets)])]]
        for own, passed in zip(self.slices, sets):
            for low, wanted in zip(lows, passed):
                self.live[own] &= _among(low[own], wanted)
        self.low = lows[level]

    def _lowest(self, length: int) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.uint64)
        return sliding_min(gram_hashes(self.words, length), self.size - length + 1)

    def whole(self) -> np.ndarray:
        return gram_hashes(self.words, self.size)

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Living windows' grams, once for each text: (text, gram)."""
        at = np.flatnonzero(self.live)
        doc, value = self.doc[at], self.low[at]
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        return doc[new], value[new]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of living windows of a text with equal grams."""
        if not self.n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        new = (self.live[1:] != self.live[:-1]) | (self.low[1:] != self.low[:-1]) | (self.doc[1:] != self.doc[:-1])
        cut = np.flatnonzero(new) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [self.n]])
        met = self.live[starts]
        return starts[met], ends[met]


def _windows(piece: dict, lengths: list[int], level: int, size: int) -> Iterator[tuple[int, Windows]]:
    """(number of its first text, windows) of some texts of a slice at a time."""
    sets, start = _set_lists(piece), 0
    for words, bounds in word_numbers(piece["_text"], lower=False):
        stop = start + len(bounds) - 1
        yield start, Windows(words, bounds, sets[start:stop], lengths, level, size)
        start = stop


def _joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts).view(kind) if parts else np.empty(0, kind)


def _level(docs: DataFrame, columns: list[str], kind: T.DataType, lengths: list[int], level: int, size: int) -> DataFrame:
    """`_id`, `number`: the level's grams of the windows still alive, once for a document."""
    schema = T.StructType([T.StructField("_id", kind), T.StructField("number", T.LongType())])
    out = arrow_schema(schema)

    def run(batches):
        for piece in byte_slices(batches, columns, "_text", ("_id", "_sets")):
            ids, values = [], []
            for start, windows in _windows(piece, lengths, level, size):
                doc, value = windows.numbers()
                ids.append(doc + start)
                values.append(value)
            yield pa.RecordBatch.from_arrays(
                [piece["_id"].cast(out.field(0).type).take(pa.array(_joined(ids))), pa.array(_joined(values))], schema=out
            )

    return docs.select(*columns, "_text").mapInArrow(run, schema)


def run_names(whole: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of windows, of their hashes and places in it."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = place + np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        each = mix(whole[at] + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mix(np.add.reduceat(each, np.cumsum(sizes) - sizes))


def _runs(held: DataFrame, kind: T.DataType, lengths: list[int], size: int) -> DataFrame:
    """One row per run of living windows under one number: `_id`, `number`, `run` (a hash of its
    windows), `windows` (their hashes)."""
    schema = T.StructType(
        [
            T.StructField("_id", kind),
            T.StructField("number", T.LongType()),
            T.StructField("run", T.LongType()),
            T.StructField("windows", T.ArrayType(T.LongType())),
        ]
    )
    out = arrow_schema(schema)

    def make():
        def run(piece):
            ids, numbers, names, flat, sizes = [], [], [], [], []
            for start, windows in _windows(piece, lengths, len(lengths) - 1, size):
                a, b = windows.runs()
                whole = windows.whole()
                ids.append(windows.doc[a] + start)
                numbers.append(windows.low[a])
                names.append(run_names(whole, a, b))
                flat.append(whole[windows.live])
                sizes.append(b - a)
            ends = np.concatenate([[0], np.cumsum(_joined(sizes))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_joined(flat)))
            return {
                "_id": piece["_id"].cast(out.field(0).type).take(pa.array(_joined(ids))),
                "number": pa.array(_joined(numbers)),
                "run": pa.array(_joined(names)),
                "windows": lists.cast(out.field(3).type),
            }

        return run

    return map_text(held, ["_id", "_sets"], "_text", schema, make, ("_id", "_sets"))


def repeated_windows(
    spark: SparkSession,
    docs: DataFrame,
    row_id: str,
    text: str,
    size: int = SIZE,
    first: int = FIRST,
    keep_first: bool = True,
) -> DataFrame:
    """For documents with windows that also start in a document with a smaller id, or unless `keep_first`
    in any document of another id: `_id`, `_whole` (numbers all of whose windows go), `_parts` (hashes of
    single windows that go), `_sets`.

    Ids must be comparable. A NULL id is smaller than none and greater than none, so its rows lose
    nothing and take nothing. NULL, empty and short texts have no windows. Rows with one id are no
    others of each other. An empty table gives no rows. Windows are told apart by 128 bits.
    """
    kind = docs.schema[row_id].dataType
    lengths = levels(size, first)
    named = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    held, columns, state = named, ["_id"], None
    for level in range(len(lengths)):
        found = stored(spark, _level(held, columns, kind, lengths, level, size), "level")
        shared = found.groupBy("number").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a < b")
        own = found.join(shared.select("number"), "number").groupBy("_id").agg(F.collect_set("number").alias("_set"))
        if state is None:
            state = own.select(F.col("_id").alias("_wid"), F.array("_set").alias("_sets"))
        else:
            state = state.join(own, F.col("_wid") == F.col("_id")).select(
                "_wid", F.concat("_sets", F.array("_set")).alias("_sets")
            )
        state = stored(spark, state, "alive")
        held = named.join(state.hint("shuffle_hash"), F.col("_id") == F.col("_wid")).drop("_wid")
        columns = ["_id", "_sets"]
    runs = stored(spark, _runs(held, kind, lengths, size), "runs")
    kinds = runs.groupBy("number").agg(
        F.min("run").alias("a"), F.max("run").alias("b"), F.min("_id").alias("_first"), F.max("_id").alias("_last")
    )
    goes = F.col("_id") > F.col("_first") if keep_first else F.col("_last") > F.col("_first")
    met = runs.join(kinds, "number")
    whole = met.where((F.col("a") == F.col("b")) & goes).select(
        "_id", F.col("number"), F.lit(None).cast("bigint").alias("window")
    )
    single = stored(
        spark,
        met.where("a != b").select("_id", "number", F.explode("windows").alias("window")).distinct(),
        "windows",
    )
    bounds = single.groupBy("number", "window").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    parts = single.join(bounds, ["number", "window"]).where(goes).select("_id", "number", "window")
    gone = whole.unionByName(parts).groupBy("_id").agg(
        F.collect_set(F.when(F.col("window").isNull(), F.col("number"))).alias("_whole"),
        F.collect_set("window").alias("_parts"),
    )
    return gone.join(state, F.col("_id") == F.col("_wid")).drop("_wid")


def _held(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.withColumnRenamed("_id", "_wid").hint("shuffle_hash"), F.col("_id") == F.col("_wid"))


def _covered(piece: dict, lengths: list[int], size: int) -> Iterator[np.ndarray]:
    """For each text of a slice which words a window that goes covers."""
    whole, parts = _lists(piece["_whole"]), _lists(piece["_parts"])
    for start, windows in _windows(piece, lengths, len(lengths) - 1, size):
        grams, words = windows.whole(), np.zeros(len(windows.words) + 1, np.int64)
        out = windows.live
        for i, own in enumerate(windows.slices, start):
            out[own] &= _among(windows.low[own], whole[i]) | _among(grams[own], parts[i])
        at = np.flatnonzero(out)
        np.add.at(words, at, 1)
        np.add.at(words, at + size, -1)
        off = np.cumsum(words[:-1]) > 0
        for a, b in zip(windows.bounds, windows.bounds[1:]):
            yield off[a:b]


def _spans(off: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], off.astype(np.int8), [0]]))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def remove_windows(
    spark: SparkSession, docs: DataFrame, row_id: str, text: str, size: int = SIZE, first: int = FIRST
) -> DataFrame:
    """For every row that loses words: `row_id`, `text_key` (a hash of the text), `n_removed`, `spans`
    (of removed words), `kept` (the others joined by one space, bytes). See `repeated_windows`."""
    lengths = levels(size, first)
    gone = stored(spark, repeated_windows(spark, docs, row_id, text, size, first), "gone")
    named = docs.select(
        F.col(row_id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text")
    )
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def make():
        def run(piece):
            removed, spans, kept = [], [], []
            for raw, off in zip(piece["_text"], _covered(piece, lengths, size)):
                removed.append(int(off.sum()))
                spans.append([list(s) for s in _spans(off)])
                kept.append(b" ".join(compress(raw.split(), (~off).tolist())))
            return dict(zip(schema.names, (piece["_id"], piece["_key"], removed, spans, kept)))

        return run

    columns = ["_id", "_key", "_sets", "_whole", "_parts"]
    return map_text(_held(named, gone), columns, "_text", schema, make, ("_sets", "_whole", "_parts"))


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shared_passages(
    spark: SparkSession, docs: DataFrame, row_id: str, text: str, size: int, first: int
) -> DataFrame:
    """`row_id`, `text_key` (a hash of the text), `spans`: array of (`start`, `end`) byte spans, of the rows
    with windows of `size` words that also start in another document: one with another id or text. A
    span goes up to the next word; words are parted and told apart as `repeated_windows` does.

    NULL, empty and short texts have no windows; a NULL id is one like others; equal rows are one
    document, and each gets its spans; other columns are not read; an empty table gives no rows.
    """
    lengths = levels(size, first)
    named = docs.select(
        F.xxhash64(F.col(row_id), F.col(text)).alias("_id"),
        F.col(row_id).alias("_row"),
        F.xxhash64(F.col(text)).alias("_key"),
        F.col(text).alias("_text"),
    )
    gone = stored(spark, repeated_windows(spark, named, "_id", "_text", size, first, keep_first=False), "gone")
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField(
                "spans",
                T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
            ),
        ]
    )

    def make():
        def run(piece):
            spans = []
            for raw, off in zip(piece["_text"], _covered(piece, lengths, size)):
                at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
                spans.append([{"start": at[a], "end": at[b]} for a, b in _spans(off)])
            return dict(zip(schema.names, (piece["_row"], piece["_key"], spans)))

        return run

    columns = ["_row", "_key", "_sets", "_whole", "_parts"]
    return map_text(_held(named, gone), columns, "_text", schema, make, ("_sets", "_whole", "_parts"))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), earliest AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k
  FROM windows JOIN earliest USING (g) WHERE first < doc_id
), each AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS k, unnest(w) AS word FROM words),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS body, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query("op5_doubling_windows", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cut = remove_windows(spark, docs, "doc_id", "text").select(
        F.col("doc_id").alias("_id"),
        F.col("text_key").alias("_key"),
        F.col("n_removed").alias("_removed"),
        F.sha2("kept", 256).alias("_sha"),
    )
    cut = stored(spark, cut.dropDuplicates(["_id", "_key"]), "cut")
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return whole_words(docs, "doc_id", "text").join(cut, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_sha", "sha").alias("kept_sha256"),
    )


def whole_words(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """`row_id`, `key` (hash of the text), `n_words`, `sha` of all words joined by one space."""
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            T.StructField("key", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("sha", T.StringType()),
        ]
    )

    def make():
        import hashlib

        def run(piece):
            words = [raw.split() for raw in piece["_text"]]
            shas = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            return {row_id: piece["_id"], "key": piece["_key"], "n_words": [len(w) for w in words], "sha": shas}

        return run

    named = docs.select(F.col(row_id).alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    return map_text(named, ["_id", "_key"], "_text", schema, make)
