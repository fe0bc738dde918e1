"""Shingle sets of op7, taken from many texts at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from millrace.llm import common, jaccard

ODD = [
    b"",
    b" \t\n\x0b\x0c\r ",
    b"one",
    b" A b C d e f ",
    b"a b c d e a b c d e a b c d e",
    b"\xff\xfe Q \xc3",
    "Été ÉTÉ\x1cx\x85y\xa0z w".encode(),
    b"\x00 \x00a",
    b"word " * 50,
]


def plain(raw: bytes, size: int) -> list[int]:
    words = raw.lower().split()
    if not words:
        return []
    numbers = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    return np.unique(common.gram_hashes(numbers, min(size, len(words)))).tolist()


class Held:
    """In the place of a frame: gives the function that tasks would run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def many_words(words: int, each: int) -> pa.RecordBatch:
    texts = [" ".join(f"word{i:07d}" for i in range(k, k + each)) for k in range(0, words, each)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})


@pytest.mark.parametrize("held", [1, 20, 1 << 20])
@pytest.mark.parametrize("size", [1, 2, 5, 13])
def test_sets_do_not_depend_on_what_is_taken_together(monkeypatch, held, size):
    monkeypatch.setattr(common, "WORDS_BYTES", held)
    assert [s.tolist() for s in jaccard.shingle_sets(ODD, size)] == [plain(x, size) for x in ODD]
    assert list(jaccard.shingle_sets([], size)) == []


def test_words_of_earlier_texts_are_not_kept(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 10_000)
    batch = many_words(400_000, 100)
    run = jaccard._describe(Held(), "doc_id", "text", 5)
    tracemalloc.start()
    try:
        rows = sum(len(made) for made in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 4_000
    assert peak < 36 << 20


def test_texts_are_taken_apart_many_at_a_time(monkeypatch):
    calls = []
    hashed = jaccard.gram_hashes
    monkeypatch.setattr(jaccard, "gram_hashes", lambda *a: calls.append(1) or hashed(*a))
    run = jaccard._describe(Held(), "doc_id", "text", 5)
    rows = sum(len(made) for made in run([many_words(20_000, 20)]))
    assert rows == 1_000
    assert len(calls) < 10
