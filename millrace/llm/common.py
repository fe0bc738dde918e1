"""Helpers the text operators share: stored intermediates, bytes of a text column, words, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import delete_path, scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SLICE_BYTES = 8 << 20
"""Python workers take Arrow batches apart into slices of about so many text bytes."""

WORDS_BYTES = 1 << 20
"""Text bytes whose words are held at once, at least one text."""


def stored(spark: SparkSession, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """`df` written once as Parquet below `spark.checkpoint.dir` and read again. What it took
    to make it, shuffle files included, is dropped as soon as it is written; the copy
    survives lost executors. `batch_rows`: rows of the Arrow batches that go to Python meanwhile;
    long texts want few, as executor and worker both hold a whole batch."""
    path = scratch(spark, name)
    settings = {CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a `stored` frame that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete_path(spark, path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5. Remainder 0 is held out from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0).cast("bigint"))


def byte_slices(batches, columns: list[str], text: str, arrays: tuple[str, ...] = ()) -> Iterator[dict]:
    """Slices of Arrow batches as lists by column, those in `arrays` as Arrow arrays; `text` as bytes,
    NULL as empty bytes."""
    for batch in batches:
        raw = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        rest = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(raw), 0)) if len(raw) else []
        ends = np.cumsum(sizes)
        start = 0
        while start < len(raw):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            cut = {c: a.slice(start, stop - start) for c, a in zip(columns, rest)}
            piece = {c: a if c in arrays else a.to_pylist() for c, a in cut.items()}
            piece[text] = [x or b"" for x in raw.slice(start, stop - start).to_pylist()]
            yield piece
            start = stop


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_text(
    df: DataFrame,
    columns: list[str],
    text: str,
    schema: T.StructType,
    make: Callable[[], Callable[[dict], dict]],
    arrays: tuple[str, ...] = (),
) -> DataFrame:
    """`mapInArrow` over slices. `make()` runs once per task and returns the function from a
    slice (lists by column, Arrow for those in `arrays`) to result columns by name; only the named
    columns are read."""
    out = arrow_schema(schema)

    def run(batches):
        function = make()
        for piece in byte_slices(batches, columns, text, arrays):
            made = function(piece)
            yield pa.RecordBatch.from_arrays(
                [
                    made[f.name]
                    if isinstance(made[f.name], pa.Array)
                    else pa.array(made[f.name], type=f.type)
                    for f in out
                ],
                schema=out,
            )

    return df.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def filter_rows(
    df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], list[bool]]]
) -> DataFrame:
    """Rows of `df`, all columns, whose text passes. `make()` runs once per task and returns the
    function from texts (bytes, NULL as empty) to whether each row stays. Only the text travels to
    Python, and a flag comes back."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = make()
        for array in arrays:
            batch = pa.RecordBatch.from_arrays([array], names=["text"])
            passed = [ok for piece in byte_slices([batch], [], "text") for ok in function(piece["text"])]
            yield pa.array(passed, pa.bool_())

    return df.where(F.arrow_udf(run, "boolean", F.ArrowUDFType.SCALAR_ITER)(F.col(text)))


class Cache(dict):
    """A dict of at most twice `limit` entries: a full young generation replaces the old one."""

    def __init__(self, limit: int, make: Callable):
        super().__init__()
        self.old: dict = {}
        self.limit, self.make = limit, make

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def coded_words(texts: list[bytes], lower: bool) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Of some texts at a time, in order: different words, for each word of the texts its place among these,
    and the bounds of the texts in them. Words are parted by ASCII white space, with `lower` A-Z are
    lower-cased; Arrow takes the texts apart."""
    sizes = np.cumsum([len(x) for x in texts])
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + WORDS_BYTES, "right")))
        raw = pa.array(texts[start:stop], pa.large_binary())
        # Bytes need not be UTF-8; these functions look at ASCII alone.
        lines = pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers())
        split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(lines) if lower else lines)
        coded = split.values.dictionary_encode()
        _, ends, body = coded.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist()
        body = body.to_pybytes() if body else b""
        names = [body[a:b] for a, b in zip(ends, ends[1:])]
        at = coded.indices.to_numpy()
        # White space at either end of a text leaves an empty string there.
        real = at != names.index(b"") if b"" in names else np.ones(len(at), dtype=bool)
        yield names, at[real], np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]
        start = stop


def word_numbers(texts: list[bytes], lower: bool = True) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Of some texts at a time, in order, the numbers of their words, A-Z lower-cased unless `lower` is
    false, and the bounds of the texts in them. Each different word among them is hashed once."""
    import xxhash

    for names, at, bounds in coded_words(texts, lower):
        yield np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[at], bounds.tolist()


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of `size` words; fewer words give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    if len(values) < width:
        return values[:0]
    low, done = values, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low
