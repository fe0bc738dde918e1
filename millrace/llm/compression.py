"""Quality by compression: text is good if a dictionary of good text compresses it better.

Two zstandard dictionaries are built, from good and from bad labelled documents. Every text is
compressed with both in blocks, so that the dictionary counts at the end of a long text as at its
start; the difference of the sizes over the text's length is calibrated to a probability, on
differences that labelled documents get from dictionaries built without them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fold, map_text
from millrace.llm.registry import query, table
from millrace.llm.sampling import labelled_sample, platt, sigmoid

SAMPLE = 6_000
"""Labelled documents that build the dictionaries and calibrate."""

FOLDS = 5
"""A document is calibrated with dictionaries from the other folds."""

DICTIONARY_BYTES = 1 << 20
"""Of each of the two; they are sent to every task."""

BLOCK = 1024
"""Bytes of one compressed block; every byte of a text is in one."""

LEVEL = 9
SAMPLE_BYTES = 16 << 10
"""Of one sample document, so many bytes from evenly spread blocks may enter a dictionary."""


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def _spread(raw: bytes) -> list[bytes]:
    blocks = _blocks(raw)
    step = max(1, len(blocks) * BLOCK // SAMPLE_BYTES)
    return blocks[::step]


def build_dictionary(documents: list[bytes]) -> bytes:
    """Content of a dictionary: blocks taken in turn from all documents until it is full, so that
    many documents are in it. Empty without documents."""
    queues = [_spread(d) for d in documents if d]
    picked, size, turn = [], 0, 0
    while size < DICTIONARY_BYTES and any(turn < len(q) for q in queues):
        for q in queues:
            if turn < len(q) and size < DICTIONARY_BYTES:
                picked.append(q[turn][: DICTIONARY_BYTES - size])
                size += len(picked[-1])
        turn += 1
    return b"".join(picked)


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    shift: float

    def difference(self):
        """Function from a text to (bad size - good size) / length; 0 for an empty text."""
        import zstandard

        def compressor(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(level=LEVEL)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=held, write_content_size=False)

        good, bad = compressor(self.good), compressor(self.bad)

        def value(raw: bytes) -> float:
            if not raw:
                return 0.0
            total = 0
            for block in _blocks(raw):
                total += len(bad.compress(block)) - len(good.compress(block))
            return total / len(raw)

        return value


def fit_compression(docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str) -> CompressionModel:
    """Dictionaries from a bounded labelled sample; calibration across `FOLDS` of it, so that few labels
    of one kind serve both. Rows that share an id share a fold."""
    schema = T.StructType(
        [T.StructField(c, t) for c, t in (("_fold", T.IntegerType()), ("_label", T.IntegerType()), ("body", T.BinaryType()))]
    )
    sample = labelled_sample(docs, labels, row_id, text, label, SAMPLE).withColumn(
        "_fold", F.pmod(F.xxhash64(F.lit("fold"), F.col(row_id).cast("string")), F.lit(FOLDS)).cast("int")
    )

    def make():
        return lambda piece: {
            "_fold": piece["_fold"],
            "_label": piece["_label"],
            "body": [b"".join(_spread(x)) for x in piece[text]],
        }

    rows = map_text(sample, ["_fold", "_label"], text, schema, make).collect()
    # An order that depends neither on the tasks the rows came from nor on how texts begin.
    rows = sorted(((r[0], r[1], bytes(r[2])) for r in rows), key=lambda r: (xxhash.xxh3_64_intdigest(r[2]), r[:2]))

    def fitted(without: int | None) -> CompressionModel:
        build = lambda y: build_dictionary([x for k, label, x in rows if k != without and label == y])
        return CompressionModel(build(1), build(0), 0.0, 0.0)

    x, y = [], []
    for k in range(FOLDS if rows else 0):
        value = fitted(k).difference()
        held = [r for r in rows if r[0] == k]
        x += [value(r[2]) for r in held]
        y += [float(r[1]) for r in held]
    slope, shift = platt(np.array(x), np.array(y)) if rows else (0.0, 0.0)
    model = fitted(None)
    return CompressionModel(model.good, model.bad, slope, shift)


def score_quality(docs: DataFrame, row_id: str, text: str, model: CompressionModel) -> DataFrame:
    """`row_id`, `score` (probability of good), `difference` for every row, over its whole text.

    NULL and empty texts have difference 0. Without labels of both kinds every score is the share
    of good ones in the sample (0.5 without any). Repeated rows get equal scores; an empty table
    gives none. Long texts are compressed whole, block by block; other columns of any name change
    nothing, and a score that ties with a threshold is the caller's to decide.
    """
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("difference", T.DoubleType()),
        ]
    )

    def make():
        value = model.difference()

        def run(piece):
            x = np.array([value(t) for t in piece[text]], dtype=float)
            return {row_id: piece[row_id], "score": sigmoid(model.slope * x + model.shift), "difference": x}

        return run

    return map_text(docs, [row_id], text, schema, make)


@query("op10_compression_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_compression(docs, labels, "doc_id", "text", "quality")
    return score_quality(docs, "doc_id", "text", model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "difference",
    )
