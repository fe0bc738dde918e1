"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit of the code a binary classifier over byte n-grams tells
the languages whose codewords have a 1 there from those with a 0. Decoding sums, over the bits, the loss a
codeword would have with the classifiers' outputs, each bit weighted by how far it can be trusted, and takes
the codeword of least loss; a text whose two best codewords are close is flagged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fold, map_text
from millrace.llm.registry import query, table
from millrace.llm.sampling import chosen, sigmoid

SAMPLE = 3_000
"""Labelled documents to learn from, shared out evenly among the languages; at most twice as many. A document
enters as counts of hashed n-grams, so its length does not matter to memory."""

SIZES = (1, 2, 3, 4)
"""Bytes of the n-grams; texts are lower-cased and begin with a space."""

DIMENSIONS = 1 << 13
UNKNOWN = "und"
AMBIGUOUS = 1 / 3
"""A text is flagged if the losses of its two best codewords differ by less than this share of the usual
difference, or if more bits are against its codeword than the code corrects."""

EXHAUSTIVE = 5
"""Up to so many languages the code has every split of them as a bit."""

ROUNDS = 150


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed n-grams in the whole text; zeros for an empty one."""
    text = raw.decode("utf-8", "replace").lower()
    data = np.frombuffer(b" " + " ".join(text.split()).encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS)
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, np.uint32)
        with np.errstate(over="ignore"):
            for k in range(size):
                code = code * np.uint32(0x01000193) ^ data[k : k + n]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
        counts += np.bincount(code, minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if text.strip() else np.zeros(DIMENSIONS, np.float32)


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language. All splits for a few languages; else the best of many random
    codes by the least distance of two codewords, the same in every run."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    bits = 8 * int(np.ceil(np.log2(languages))) + 7
    draw = np.random.RandomState(languages)
    best, distance = None, -1.0
    for _ in range(60):
        code = np.where(draw.rand(languages, bits) < 0.5, 1.0, -1.0)
        code[0, np.abs(code.sum(axis=0)) == languages] *= -1
        least = ((bits - code @ code.T) / 2 + 2 * bits * np.eye(languages)).min()
        if least > distance:
            best, distance = code, least
    return best


def fit_bits(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Logistic weights (with a constant as last row) for each column of `signs`, both sides of a split
    counting alike, by gradient steps with momentum."""
    design = np.concatenate([x, np.full((len(x), 1), 0.2, np.float32)], axis=1)
    up = signs > 0
    share = np.where(up, 0.5 / np.maximum(up.sum(axis=0), 1), 0.5 / np.maximum((~up).sum(axis=0), 1)).astype(np.float32)
    w = np.zeros((design.shape[1], signs.shape[1]), np.float32)
    speed = np.zeros_like(w)
    # Rows have length 1, so the loss bends by a quarter at most.
    for _ in range(ROUNDS):
        ahead = w + 0.9 * speed
        slope = design.T @ (-signs * share * sigmoid(-signs * (design @ ahead))).astype(np.float32)
        speed = 0.9 * speed - 4.0 * (slope + 1e-5 * ahead)
        w = w + speed
    return w


def gaps(loss: np.ndarray) -> np.ndarray:
    """Of each row, the second least loss less the least; infinite where there is one codeword only."""
    if loss.shape[1] < 2:
        return np.full(len(loss), np.inf)
    least = np.partition(loss, 1, axis=1)
    return least[:, 1] - least[:, 0]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    sharpness: float
    usual_gap: float

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword, for rows of classifier outputs."""
        wrong = np.logaddexp(0.0, -margins[:, None, :] * self.code[None, :, :])
        return (wrong * self.trust).sum(axis=2)

    @property
    def corrects(self) -> int:
        """Wrong bits that leave a codeword nearer than any other."""
        bits = self.code.shape[1]
        apart = (bits - self.code @ self.code.T) / 2 + bits * np.eye(len(self.code))
        return max(0, int(apart.min() - 1) // 2) if bits else 0

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the best language, its probability, whether it is ambiguous) for rows of features."""
        margins = (x @ self.weights[:-1] + 0.2 * self.weights[-1]).astype(np.float64)
        loss = self.losses(margins)
        best = loss.argmin(axis=1)
        odds = np.exp(-self.sharpness * (loss - loss.min(axis=1, keepdims=True)))
        score = odds[np.arange(len(odds)), best] / odds.sum(axis=1)
        against = (margins * self.code[best] <= 0).sum(axis=1)
        return best, score, (gaps(loss) < AMBIGUOUS * self.usual_gap) | (against > self.corrects)


def fit_model(languages: list[str], x: np.ndarray, which: np.ndarray, measure: np.ndarray) -> LanguageModel:
    """Classifiers from the rows that are not in `measure`; trust and sharpness from those that are."""
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((DIMENSIONS + 1, 0), np.float32), np.ones(0), 1.0, 0.0)
    # A language all of whose rows are measured would not be learned.
    for k in range(len(languages)):
        if measure[which == k].all():
            measure = measure & (which != k)
    signs = code[which]
    weights = fit_bits(x[~measure], signs[~measure])
    held = measure if measure.any() else ~measure
    margins = x[held] @ weights[:-1] + 0.2 * weights[-1]
    right = ((margins * signs[held] > 0).sum(axis=0) + 1) / (held.sum() + 2)
    trust = np.clip(np.log(right / (1 - right)), 0.05, None)
    model = LanguageModel(languages, code, weights, trust / trust.mean(), 1.0, 0.0)
    loss = model.losses(margins.astype(np.float64))
    usual = float(np.median(gaps(loss)))
    loss -= loss.min(axis=1, keepdims=True)
    own = which[held]

    def cost(sharpness: float) -> float:
        odds = np.exp(-sharpness * loss)
        return -np.log((odds[np.arange(len(own)), own] + 1e-9) / odds.sum(axis=1)).mean()

    return LanguageModel(languages, code, weights, model.trust, min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=cost), usual)


def fit_languages(docs: DataFrame, row_id: str, text: str, lang: str, size: int = SAMPLE) -> LanguageModel:
    """Learn from a bounded sample of the rows with a language, an id and a letter in their text whose fold is
    not the held-out one. Each language gives about the same number of rows, all it has if they are fewer."""
    usable = docs.where(
        F.col(lang).isNotNull() & F.col(row_id).isNotNull() & F.col(text).isNotNull() & (fold(F.col(row_id)) != 0)
    )
    counts = {r[0]: r[1] for r in usable.groupBy(F.col(lang).cast("string")).count().collect()}
    share = max(1, size // max(1, len(counts)))
    key, value = F.col(row_id).cast("string"), F.col(lang).cast("string")
    picked = F.lit(False)
    for name, rows in counts.items():
        picked = picked | ((value == name) & chosen(key, rows, share))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), "_key"))
    sample = usable.where(picked).select(F.col(text).alias("_text"), value.alias("_lang"), key.alias("_key"))
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("_lang", "_key")]
        + [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]
    )

    def make():
        def run(piece):
            made = [features(t) if has_letter(t.decode("utf-8", "replace")) else None for t in piece["_text"]]
            at = [None if v is None else np.flatnonzero(v).astype(np.int32) for v in made]
            return {
                "_lang": piece["_lang"],
                "_key": piece["_key"],
                "at": pa.array(at, pa.list_(pa.int32())),
                "value": pa.array([None if v is None else v[i] for v, i in zip(made, at)], pa.list_(pa.float32())),
            }

        return run

    told = map_text(sample, ["_lang", "_key"], "_text", schema, make).where("at is not null")
    rows = told.withColumn("place", place).where(F.col("place") <= 2 * share).select("_lang", "at", "value", "place")
    out = T.StructType(
        [
            T.StructField("languages", T.ArrayType(T.StringType())),
            T.StructField("weights", T.BinaryType()),
            T.StructField("trust", T.ArrayType(T.DoubleType())),
            T.StructField("sharpness", T.DoubleType()),
            T.StructField("usual_gap", T.DoubleType()),
        ]
    )
    made = rows.repartition(1).mapInArrow(_fit_sample, out).first()
    if made is None or not made["languages"]:
        return fit_model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), np.zeros(0, dtype=bool))
    code = codewords(len(made["languages"]))
    weights = np.frombuffer(bytes(made["weights"]), np.float32).reshape(DIMENSIONS + 1, code.shape[1])
    return LanguageModel(made["languages"], code, weights, np.array(made["trust"]), made["sharpness"], made["usual_gap"])


def _fit_sample(batches):
    """The model of the whole sample, in one task, as one row."""
    names, places, parts = [], [], []
    for batch in batches:
        lang, at, value, place = batch.columns
        x = np.zeros((len(batch), DIMENSIONS), np.float32)
        rows = np.repeat(np.arange(len(batch)), np.asarray(pa.compute.list_value_length(at)))
        x[rows, np.asarray(at.flatten())] = np.asarray(value.flatten())
        parts.append(x)
        names += lang.to_pylist()
        places += place.to_pylist()
    languages = sorted(set(names))
    number = {name: k for k, name in enumerate(languages)}
    which = np.array([number[n] for n in names], np.int64)
    x = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), np.float32)
    model = fit_model(languages, x, which, np.array(places, np.int64) % 4 == 0)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([languages], pa.list_(pa.string())),
            pa.array([model.weights.tobytes()], pa.binary()),
            pa.array([model.trust.tolist()], pa.list_(pa.float64())),
            pa.array([float(model.sharpness)]),
            pa.array([float(model.usual_gap)]),
        ],
        names=["languages", "weights", "trust", "sharpness", "usual_gap"],
    )


def predict_languages(docs: DataFrame, row_id: str, text: str, model: LanguageModel) -> DataFrame:
    """`row_id`, `lang_pred`, `score` (probability of that language), `ambiguous`, for every row's whole text.

    A NULL text, one without a letter, and every text where no language was learned get `und` with score 0 and
    are ambiguous. Where one language was learned every other text gets it with score 1. Of languages with equal
    losses the first in order wins. Repeated rows get equal results; NULL ids are kept; other columns are not
    read; an empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )

    def make():
        def run(piece):
            names, scores = [UNKNOWN] * len(piece[text]), np.zeros(len(piece[text]))
            unsure = np.ones(len(piece[text]), dtype=bool)
            told = [i for i, t in enumerate(piece[text]) if model.languages and has_letter(t.decode("utf-8", "replace"))]
            for start in range(0, len(told), 64):
                rows = told[start : start + 64]
                best, scores[rows], unsure[rows] = model.decode(np.stack([features(piece[text][i]) for i in rows]))
                for i, b in zip(rows, best):
                    names[i] = model.languages[b]
            return {row_id: piece[row_id], "lang_pred": names, "score": np.clip(scores, 0, 1), "ambiguous": unsure}

        return run

    return map_text(docs, [row_id], text, schema, make)


@query("op13_code_languages")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_languages(docs, "doc_id", "text", "lang")
    told = predict_languages(docs, "doc_id", "text", model)
    return told.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
