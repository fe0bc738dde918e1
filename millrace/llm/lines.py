"""Quality rules with line labels from a linear-chain conditional random field.

Each line with a word is content (1) or boilerplate (0). The field is trained here on a bounded
sample of the documents, whose clear lines get labels from surface rules; Viterbi decoding then labels
every line of every document, and the share of words in content lines decides whether it is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_text
from millrace.llm.registry import query, table
from millrace.llm.sampling import chosen

SAMPLE = 1_500
"""Documents the field is trained on."""

TRAIN_LINES = 200
"""Of a training document, so many evenly spread runs of lines; decoding sees all lines."""

MIN_CONTENT = 0.5
"""Share of words in content lines from which a document is kept."""

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

NOTICE = re.compile(
    rb"licen[cs]ed?\b|copyright|all rights reserved|\bcookies?\b|privacy policy|terms of (use|service)"
    rb"|subscribe|newsletter|sign (in|up)|log ?in|click here|read more|share (this|on)|powered by"
    rb"|http://|https://|www\.|\S@\S+\.\w|navigation|sitemap|skip to",
    re.IGNORECASE,
)

FEATURES = (
    "always", "words_1_2", "words_3_5", "words_6_11", "words_12_29", "words_30", "sentence_end",
    "capital_start", "symbols_some", "symbols_many", "digits_many", "upper_many", "bars",
    "long_words", "short_words", "repeated", "notice", "exclaims", "list_mark", "first", "last",
)
AT = {name: i for i, name in enumerate(FEATURES)}


def words_of(raw: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged."""
    return raw.split()


def line_features(line: bytes, words: int, repeated: bool) -> list[int]:
    """The features of one line that has `words` words."""
    body = line.strip()
    size = len(body)
    on = [0]
    on.append(1 if words <= 2 else 2 if words <= 5 else 3 if words <= 11 else 4 if words <= 29 else 5)
    if body[-1:] in b".!?\"')" and body:
        on.append(AT["sentence_end"])
    if body[:1].isupper() or body[:1] >= b"\xc3":
        on.append(AT["capital_start"])
    symbols = size - len(body.translate(None, SYMBOLS))
    if symbols:
        on.append(AT["symbols_many"] if symbols * 20 >= size else AT["symbols_some"])
    if (size - len(body.translate(None, b"0123456789"))) * 6 >= size:
        on.append(AT["digits_many"])
    upper = size - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    if upper * 3 >= size and size > 3:
        on.append(AT["upper_many"])
    if body.count(b"|") >= 2:
        on.append(AT["bars"])
    if size > 12 * words:
        on.append(AT["long_words"])
    elif size < 3 * words:
        on.append(AT["short_words"])
    if repeated:
        on.append(AT["repeated"])
    if NOTICE.search(body):
        on.append(AT["notice"])
    if body.count(b"!") * 15 >= size:
        on.append(AT["exclaims"])
    if body[:1] in b"-*#>|" and body:
        on.append(AT["list_mark"])
    return on


def seed_label(on: list[int]) -> int:
    """1 content, 0 boilerplate, -1 unclear: by rules a reader would agree with."""
    has = set(on).__contains__
    if any(has(AT[n]) for n in ("notice", "symbols_many", "bars", "repeated", "exclaims", "long_words", "digits_many")):
        return 0
    if has(AT["upper_many"]):
        return 0
    if has(AT["sentence_end"]) and not any(has(AT[n]) for n in ("words_1_2", "list_mark")):
        return 1
    return -1


@dataclass(frozen=True)
class Field:
    """Weights of (feature, label), of (label, next label)."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, lines: list[list[int]]) -> list[int]:
        """The likeliest labels of a document's lines; on a tie content."""
        content = self.emit[:, 1].tolist()
        boiler = self.emit[:, 0].tolist()
        (bb, bc), (cb, cc) = self.move.tolist()
        b = c = 0.0
        back = []
        for at, on in enumerate(lines):
            eb = sum([boiler[i] for i in on])
            ec = sum([content[i] for i in on])
            if at:
                from_b, from_c = b + bb, c + cb
                to_b, to_c = b + bc, c + cc
                back.append((int(from_c >= from_b), int(to_c >= to_b)))
                b, c = max(from_b, from_c) + eb, max(to_b, to_c) + ec
            else:
                b, c = eb, ec
        if not lines:
            return []
        state = int(c >= b)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def fit_field(documents: list[list[list[int]]], rounds: int = 120) -> Field:
    """Gradient ascent on the likelihood of the clear labels; unclear lines are summed out. With
    too few documents the rules of `seed_label` are its start weights anyway."""
    emit = np.zeros((len(FEATURES), 2))
    for n in ("notice", "symbols_many", "bars", "repeated", "exclaims", "long_words", "digits_many", "upper_many"):
        emit[AT[n], 0] = 1.0
    emit[AT["sentence_end"], 1] = 1.0
    move = np.zeros((2, 2))
    documents = [d for d in documents if d]
    if not documents:
        return Field(emit, move)
    longest = max(map(len, documents))
    x = np.zeros((len(documents), longest, len(FEATURES)), dtype=np.float32)
    there = np.zeros((len(documents), longest), dtype=bool)
    allowed = np.ones((len(documents), longest, 2))
    for i, lines in enumerate(documents):
        for k, on in enumerate(lines):
            x[i, k, on] = 1
            there[i, k] = True
            label = seed_label(on)
            if label >= 0:
                allowed[i, k, 1 - label] = 0
    flat = x[there]
    total = len(flat)
    for step in range(rounds):
        scores = x @ emit.astype(np.float32)
        free_node, free_edge = _marginals(scores, move, there, np.ones_like(allowed))
        held_node, held_edge = _marginals(scores, move, there, allowed)
        rate = 4.0 / (1 + step / 40)
        difference = (held_node - free_node)[there]
        emit += rate * (flat.T @ difference / total - 1e-4 * emit)
        move += rate * ((held_edge - free_edge) / total - 1e-4 * move)
    return Field(emit, move)


def _marginals(scores, move, there, allowed):
    """Label probabilities of all lines, and sums of those of neighbours, by forward-backward."""
    n, longest, _ = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True)) * allowed
    step = np.exp(move)
    forward, back = np.zeros((n, longest, 2)), np.ones((n, longest, 2))
    a = local[:, 0]
    forward[:, 0] = a / a.sum(axis=1, keepdims=True)
    for k in range(1, longest):
        a = (forward[:, k - 1] @ step) * local[:, k]
        a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
        forward[:, k] = np.where(there[:, k, None], a, 0.5)
    for k in range(longest - 2, -1, -1):
        b = (back[:, k + 1] * local[:, k + 1]) @ step.T
        b = b / np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
        back[:, k] = np.where(there[:, k + 1, None], b, 1.0)
    node = forward * back
    node /= np.maximum(node.sum(axis=2, keepdims=True), 1e-300)
    pair = forward[:, :-1, :, None] * step * (local[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
    return node, (pair * there[:, 1:, None, None]).sum(axis=(0, 1))


def split_lines(raw: bytes) -> tuple[list[bytes], list[int], list[bool]]:
    """Lines with a word, their numbers of words, and whether an earlier line is equal."""
    lines, sizes, repeated, seen = [], [], [], set()
    for line in raw.split(b"\n"):
        size = len(line.split())
        if size:
            lines.append(line)
            sizes.append(size)
            repeated.append(line in seen)
            seen.add(line)
    return lines, sizes, repeated


def features_of(raw: bytes) -> tuple[list[list[int]], list[int], list[bool]]:
    lines, sizes, repeated = split_lines(raw)
    found = [line_features(*x) for x in zip(lines, sizes, repeated)]
    if found:
        found[0].append(AT["first"])
        found[-1].append(AT["last"])
    return found, sizes, repeated


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    triples = pairs[:-1] * len(numbers) + ids[2:]
    _, inverse, counts = np.unique(triples, return_inverse=True, return_counts=True)
    often = counts[inverse] >= 2
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def fit_lines(docs: DataFrame, row_id: str, text: str) -> Field:
    """Train on about `SAMPLE` documents, chosen by a hash of their id."""
    schema = T.StructType([T.StructField("lines", T.ArrayType(T.ArrayType(T.IntegerType())))])
    picked = docs.where(chosen(F.col(row_id), docs.count(), SAMPLE)).limit(2 * SAMPLE)

    def part(found):
        if len(found) <= TRAIN_LINES:
            return found
        start = (len(found) - TRAIN_LINES) // 2
        return found[start : start + TRAIN_LINES]

    def make():
        return lambda piece: {"lines": [part(features_of(x)[0]) for x in piece[text]]}

    rows = map_text(picked, [], text, schema, make).collect()
    return fit_field([[list(x) for x in r[0]] for r in rows])


def line_quality(docs: DataFrame, row_id: str, text: str, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """Per row: `row_id`, `n_words`, `word_chars` (code points in words), `n_symbols`,
    `n_dup_lines`, `n_repeat_words`, `content_words`, `labels` (of the lines with a word, in order),
    `content_kept` (the share of words in content lines reaches `min_content`).

    A NULL or empty text has no words and is not kept. Rows are judged one by one, over whole
    texts; ties between label sequences count as content. An empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            *[
                T.StructField(c, T.LongType())
                for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words")
            ],
            T.StructField("labels", T.ArrayType(T.IntegerType())),
            T.StructField("content_kept", T.BooleanType()),
        ]
    )

    def make():
        def judge(raw: bytes):
            words = words_of(raw)
            joined = b"".join(words)
            found, sizes, repeated = features_of(raw)
            labels = field.viterbi(found)
            content = sum(s for s, label in zip(sizes, labels) if label)
            return (
                len(words),
                len(joined.decode("utf-8", "replace")),
                len(raw) - len(raw.translate(None, SYMBOLS)),
                sum(repeated),
                repeat_words(words),
                content,
                labels,
                bool(words) and content >= min_content * len(words),
            )

        names = schema.names[1:]

        def run(piece):
            made = [judge(x) for x in piece[text]]
            columns = [list(c) for c in zip(*made)] if made else [[] for _ in names]
            return {row_id: piece[row_id]} | dict(zip(names, columns))

        return run

    return map_text(docs, [row_id], text, schema, make)


@query("op8_line_field_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    judged = line_quality(docs, "doc_id", "text", fit_lines(docs, "doc_id", "text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("content_kept")).alias("kept"),
        "content_words",
    )
