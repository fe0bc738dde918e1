"""Toxicity by weak supervision.

Many voters look at a text: lexicons (of insults, and mined from labelled documents) and patterns.
A generative label model fitted to the votes of all documents estimates how often each voter fires
on toxic and on clean text and how far voters repeat each other. Its posteriors are the labels of a
linear classifier over words and word beginnings, which scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Cache, coded_words, fold, map_text
from millrace.llm.registry import query, table
from millrace.llm.sampling import labelled_sample, platt, sigmoid

SAMPLE = 5_000
"""Labelled documents the lexicons, the classifier and its calibration are fitted on."""

SAMPLE_WORDS = 5_000
"""Different words of one sample document that are fitted on; of more, those with the least hashes."""

MISS_COST = 4
"""A toxic document that passes counts as so many clean ones that are stopped: scores are shifted so
that 0.5 is where the two risks are equal."""

PREFIXES = (4, 5, 6)
MIN_SUPPORT = 4
MAX_TERMS = 150_000
"""Terms with a weight; the most frequent ones of the sample."""

INSULTS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb "
    "imbecile filth vermin bastard retard hate kill ugly fool garbage creep pig",
    "de": "idiot dumm dummkopf trottel arschloch abschaum drecksau versager hass wertlos ekelhaft hure schwein",
    "fr": "idiot imbécile stupide connard salaud ordure débile crétin minable nul dégoûtant haine",
    "es": "idiota imbécil estúpido tonto basura escoria asqueroso patético inútil cabrón odio payaso",
}

VOTE_PATTERNS = [
    r"\byou(?:'re| are)?\s+(?:all\s+)?(?:a\s+|an\s+|such\s+)?\w*(?:idiot|moron|loser|scum|trash|clown|stupid|pathetic)",
    r"\b\w+\*{2,}\w*\b",
    r"\b(?:shut up|go away|get lost|drop dead)\b",
    r"!{3,}",
]

NEEDED = [
    [("you",), ("idiot", "moron", "loser", "scum", "trash", "clown", "stupid", "pathetic")],
    [("**",)],
    [("shut up", "go away", "get lost", "drop dead")],
    [("!!!",)],
]
"""A text without one string of each group does not fit the pattern, and is not searched for it."""

STRIPPED = " .,;:!?\"'()[]{}<>*#$%&|-_=+/\\…¡¿«»"


def plain_word(word: str) -> str:
    return word.strip(STRIPPED)


def words_of(raw: bytes) -> set[str]:
    return set(raw.decode("utf-8", "replace").lower().split())


def pattern_bits(raw: bytes) -> int:
    """The patterns a text fits."""
    text = raw.decode("utf-8", "replace").lower()
    found = 0
    for i, (pattern, groups) in enumerate(zip(VOTE_PATTERNS, NEEDED)):
        if all(any(s in text for s in group) for group in groups) and re.search(pattern, text):
            found |= 1 << i
    return found


def distinct_words(texts: list[bytes]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Of some texts at a time, in order: different words, the pairs (text, place of a word) that say which
    texts have which of them, as `words_of` would, and the number of texts. A word is lower-cased and parted
    at white space that is not ASCII once for all texts that have it."""
    for names, at, bounds in coded_words(texts, lower=False):
        size = len(bounds) - 1
        joined = b"\n".join(names).decode("utf-8", "replace").lower()
        lines, words = joined.split("\n"), joined.split()
        doc = np.repeat(np.arange(size), np.diff(bounds))
        if lines != words:
            n = np.array([len(line.split()) for line in lines], np.int64)
            each = n[at]
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            at = np.repeat((np.cumsum(n) - n)[at], each) + within
            doc = np.repeat(doc, each)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        own = coded.indices.to_numpy().astype(np.int64)
        many = max(1, len(coded.dictionary))
        pairs = np.sort(doc * many + own[at])
        doc, word = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], many)
        yield coded.dictionary, doc, word, size


def terms_of(word: str) -> list[str]:
    """The word and its beginnings; the latter tell forms of one stem."""
    return ["=" + word] + [word[:k] for k in PREFIXES if len(word) > k]


@dataclass(frozen=True)
class Voters:
    """Lexicons as term -> bits, then patterns; the order of bits is that of `names`."""

    names: list[str]
    terms: dict[str, int]
    patterns: list[str]

    def bits_of_word(self, word: str) -> int:
        found = 0
        for term in terms_of(word):
            found |= self.terms.get(term, 0)
        return found

    def bits_of_texts(self, words: np.ndarray, doc: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Votes on some texts. `words` are the bits of the words that the texts `doc` have."""
        at = len(self.names) - len(self.patterns)
        found = np.array([pattern_bits(x) << at for x in texts], np.int64)
        met = np.flatnonzero(words)
        np.bitwise_or.at(found, doc[met], words[met])
        return found


class Values:
    """What terms weigh and which voters they are, looked up for many words at a time."""

    def __init__(self, weights: dict[str, float], bits: dict[str, int]):
        terms = [*(weights.keys() | bits.keys())]
        self.weight = np.array([0.0] + [weights.get(t, 0.0) for t in terms])
        self.bits = np.array([0] + [bits.get(t, 0) for t in terms], np.int64)
        self.words = {t[1:]: i for i, t in enumerate(terms, 1) if t[0] == "="}
        self.beginnings = {t: i for i, t in enumerate(terms, 1) if t[0] != "="}

    @staticmethod
    def _places(terms: dict[str, int], sought: pa.Array) -> np.ndarray:
        get = terms.get
        return np.array([get(t, 0) for t in sought.to_numpy(zero_copy_only=False)], np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of weights, bits) of the terms of each word."""
        plain = pa.compute.utf8_trim(words, STRIPPED)
        size = pa.compute.utf8_length(plain).to_numpy()
        at = self._places(self.words, plain)
        weight, bits = self.weight[at], self.bits[at]
        for k in PREFIXES:
            coded = pa.compute.utf8_slice_codeunits(plain, 0, k).dictionary_encode()
            known = self._places(self.beginnings, coded.dictionary)
            at = np.where(size > k, known[coded.indices.to_numpy()], 0) if len(size) else at
            weight, bits = weight + self.weight[at], bits | self.bits[at]
        return weight, bits


@dataclass(frozen=True)
class Sample:
    """Labelled documents as numbers. Entry i says that document `doc[i]` has the word `word[i]`, once
    for each of its different words; entry i of the second pair that word `of_word[i]` has the term
    `term[i]`, in the order of words. `pattern_bits` are the patterns each document fits."""

    label: np.ndarray
    pattern_bits: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    of_word: np.ndarray
    term: np.ndarray
    words: list[str]
    terms: list[str]

    def support(self, label: int) -> np.ndarray:
        """In how many documents of a label each term is."""
        total = np.zeros(len(self.terms), np.int64)
        starts = np.searchsorted(self.of_word, np.arange(len(self.words) + 1))
        each = np.diff(starts)
        ends = np.searchsorted(self.doc, np.arange(len(self.label) + 1))
        for k in np.flatnonzero(self.label == label):
            own = self.word[ends[k] : ends[k + 1]]
            if len(own):
                n = each[own]
                before = np.cumsum(n) - n
                total[np.unique(self.term[np.arange(n.sum()) + np.repeat(starts[own] - before, n)])] += 1
        return total


def read_sample(rows) -> Sample:
    """From (words joined by spaces, label, bits of patterns)."""
    words: dict[str, int] = {}
    terms: dict[str, int] = {}
    lists, labels, bits = [], [], []
    for text, label, found in rows:
        lists.append(np.array([words.setdefault(w, len(words)) for w in text.split(" ") if w], np.int32))
        labels.append(label)
        bits.append(found)
    of_word, term = [], []
    for w, k in words.items():
        own = [terms.setdefault(t, len(terms)) for t in terms_of(w)]
        of_word.append(np.full(len(own), k, np.int32))
        term.append(np.array(own, np.int32))
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    return Sample(
        np.array(labels, np.int64), np.array(bits, np.int64), doc, flat(lists), flat(of_word), flat(term), [*words], [*terms]
    )


def mine_voters(sample: Sample) -> Voters:
    """Lexicons of the fixed lists, and of terms that toxic sample documents have far more often
    than clean ones: for each kind of term three, by strength."""
    toxic, clean = sample.support(1), sample.support(0)
    sizes = [(sample.label == k).sum() for k in (0, 1)]
    ratio = np.log((toxic + 0.5) / (sizes[1] + 1)) - np.log((clean + 0.5) / (sizes[0] + 1))
    strong = np.flatnonzero((toxic >= MIN_SUPPORT) & (ratio > 2.0))
    strength = {sample.terms[i]: ratio[i] * np.sqrt(toxic[i]) for i in strong}
    names, terms = [], {}

    def add(name: str, chosen_terms) -> None:
        for t in chosen_terms:
            terms[t] = terms.get(t, 0) | 1 << len(names)
        names.append(name)

    for lang, listed in INSULTS.items():
        add(f"insults_{lang}", ["=" + w for w in listed.split()])
    kinds = [("word", lambda t: t[0] == "=")] + [
        (f"begin{k}", lambda t, k=k: t[0] != "=" and len(t) == k) for k in PREFIXES
    ]
    for name, is_kind in kinds:
        own = sorted((t for t in strength if is_kind(t)), key=lambda t: (-strength[t], t))
        third = -(-len(own) // 3)
        for i in range(3):
            add(f"{name}_{i}", own[i * third : (i + 1) * third])
    return Voters(names + [f"pattern_{i}" for i in range(len(VOTE_PATTERNS))], terms, VOTE_PATTERNS)


@dataclass(frozen=True)
class LabelModel:
    """Share of toxic documents, firing rates by class, and the weight left to each voter after
    what it shares with others."""

    share: float
    fires: np.ndarray
    weight: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1]) - np.log(self.fires[0])
        off = np.log1p(-self.fires[1]) - np.log1p(-self.fires[0])
        single = votes * on + (1 - votes) * off
        return np.log(self.share / (1 - self.share)) + single @ self.weight


def fit_label_model(votes: np.ndarray, counts: np.ndarray, share: float, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over vote patterns with their counts, started at documents with
    any vote of a lexicon. After each half the conditional correlations of the voters given the
    class are estimated, and correlated voters share their weight."""
    total = counts.sum()
    share = float(np.clip(share, 0.005, 0.5))
    strong = votes.sum(axis=1)
    posterior = np.where(strong >= 2, 0.9, np.where(strong == 1, 0.3, 0.01))
    weight = np.ones(votes.shape[1])
    fires = np.full((2, votes.shape[1]), 0.5)
    for step in range(rounds):
        by_class = np.stack([(1 - posterior) * counts, posterior * counts])
        fires = (by_class @ votes + np.array([[0.5], [0.5]])) / (by_class.sum(axis=1, keepdims=True) + 2.0)
        fires = np.clip(fires, 1e-5, 1 - 1e-5)
        # A voter for "toxic" is not let to become one against it.
        fires[1] = np.maximum(fires[1], fires[0])
        share = float(np.clip(by_class[1].sum() / total, 0.005, 0.5))
        if step % 10 == 9:
            weight = _shared_weight(votes, by_class, fires)
        posterior = sigmoid(LabelModel(share, fires, weight).log_odds(votes))
    return LabelModel(share, fires, weight)


def _shared_weight(votes, by_class, fires) -> np.ndarray:
    related = np.zeros((votes.shape[1], votes.shape[1]))
    for k in (0, 1):
        size = max(by_class[k].sum(), 1e-9)
        centred = votes - fires[k]
        cov = (centred * by_class[k][:, None]).T @ centred / size
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        related += 0.5 * np.clip(cov / np.outer(spread, spread), 0, 1)
    np.fill_diagonal(related, 0)
    return 1.0 / (1.0 + related.sum(axis=1))


@dataclass(frozen=True)
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    weights: dict[str, float]
    dense: np.ndarray
    offset: float
    slope: float
    shift: float

    def scorer(self):
        """Function from texts (bytes) to their scores."""

        values = Values(self.weights, self.voters.terms)
        matters = {1 << i: float(w) for i, w in enumerate(self.dense)}
        votes_value = Cache(100_000, lambda votes: sum(w for bit, w in matters.items() if votes & bit))

        def score(texts: list[bytes]) -> np.ndarray:
            out, start = [np.zeros(0)], 0
            for words, doc, word, size in distinct_words(texts):
                weight, bits = values.of(words)
                votes = self.voters.bits_of_texts(bits[word], doc, texts[start : start + size])
                total = np.bincount(doc, weight[word], size) / np.maximum(1.0, np.sqrt(np.bincount(doc, minlength=size)))
                margin = self.offset + total + np.array([votes_value[v] for v in votes.tolist()])
                out.append(sigmoid(self.slope * margin + self.shift))
                start += size
            return np.concatenate(out)

        return score


def vote_counts(docs: DataFrame, row_id: str, text: str, voters: Voters) -> DataFrame:
    """How many documents have each combination of votes, over all documents."""
    schema = T.StructType([T.StructField("votes", T.LongType())])

    def make():
        values = Values({}, voters.terms)

        def votes(texts):
            out, start = [np.zeros(0, np.int64)], 0
            for words, doc, word, size in distinct_words(texts):
                out.append(voters.bits_of_texts(values.of(words)[1][word], doc, texts[start : start + size]))
                start += size
            return np.concatenate(out)

        return lambda piece: {"votes": votes(piece[text])}

    return map_text(docs, [], text, schema, make).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


def _unpack(votes: np.ndarray, size: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(size)) & 1).astype(float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, row_id: str, text: str, label: str) -> ToxicityModel:
    """Fit voters, label model and classifier. The sample is bounded by `SAMPLE` and `SAMPLE_WORDS`
    and held as arrays; the votes are counted over all documents and come back as one number per
    combination."""
    schema = T.StructType(
        [T.StructField("words", T.StringType()), T.StructField("_label", T.IntegerType()), T.StructField("bits", T.LongType())]
    )

    def make():
        import xxhash

        def chosen(raw):
            own = sorted({plain_word(w) for w in words_of(raw)} - {""})
            if len(own) > SAMPLE_WORDS:
                own = sorted(own, key=lambda w: (xxhash.xxh3_64_intdigest(w), w))[:SAMPLE_WORDS]
            return " ".join(own)

        return lambda piece: {
            "words": [chosen(x) for x in piece[text]],
            "_label": piece["_label"],
            "bits": [pattern_bits(x) for x in piece[text]],
        }

    picked = labelled_sample(docs, labels, row_id, text, label, SAMPLE)
    sample = read_sample(map_text(picked, ["_label"], text, schema, make).toLocalIterator())
    voters = mine_voters(sample)
    found = vote_counts(docs, row_id, text, voters).collect()
    size = len(voters.names)
    patterns = np.array([r[0] for r in found], dtype=np.int64)
    counts = np.array([r[1] for r in found], dtype=float)
    if not len(patterns):
        patterns, counts = np.zeros(1, np.int64), np.ones(1)
    told = len(sample.label)
    model = fit_label_model(_unpack(patterns, size), counts, sample.label.mean() if told else 0.1)
    own = sample.pattern_bits << (size - len(voters.patterns))
    word_bits = np.array([voters.bits_of_word(w) for w in sample.words], np.int64)
    np.bitwise_or.at(own, sample.doc, word_bits[sample.word])
    votes = _unpack(own, size)
    posterior = sigmoid(model.log_odds(votes)) if told else np.zeros(0)
    weights, dense, offset, margins = _train(sample, votes, posterior)
    slope, shift = platt(margins, sample.label.astype(float)) if told else (1.0, -2.0)
    return ToxicityModel(voters, model, weights, dense, offset, slope, shift + float(np.log(MISS_COST)))


def _train(sample: Sample, votes, posterior, rounds: int = 80):
    """Logistic regression on the posteriors, by full-batch Adam with weight decay. A document is
    its words' terms over the root of its number of words, and its votes."""
    n = len(sample.label)
    if not n:
        return {}, np.zeros(0), 0.0, np.zeros(0)
    support = sample.support(0) + sample.support(1)
    kept = np.flatnonzero(support >= MIN_SUPPORT)
    kept = kept[np.argsort(-support[kept], kind="stable")][:MAX_TERMS]
    number = np.full(len(sample.terms), -1)
    number[kept] = np.arange(len(kept))
    # A word's weight is the sum of its terms' weights, so documents are only touched word by word.
    known = number[sample.term] >= 0
    of_word, column = sample.of_word[known].astype(np.intp), number[sample.term[known]]
    doc, word = sample.doc.astype(np.intp), sample.word.astype(np.intp)
    m, j, v_size = len(kept), votes.shape[1], len(sample.words)
    scale = 1.0 / np.maximum(1.0, np.sqrt(np.bincount(doc, minlength=n)))
    w, v, b = np.zeros(m), np.zeros(j), float(np.log(max(posterior.mean(), 1e-3)))
    state = [np.zeros(m), np.zeros(m), np.zeros(j), np.zeros(j), 0.0, 0.0]

    def margin():
        by_word = np.bincount(of_word, w[column], v_size)
        return np.bincount(doc, by_word[word], n) * scale + votes @ v + b

    for t in range(1, rounds + 1):
        error = (sigmoid(margin()) - posterior) / n
        by_word = np.bincount(word, (error * scale)[doc], v_size)
        gradients = (
            np.bincount(column, by_word[of_word], m) + 1e-4 * w / n * 100,
            votes.T @ error + 1e-4 * v,
            error.sum(),
        )
        moved = []
        for k, g in enumerate(gradients):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
            first = state[2 * k] / (1 - 0.9**t)
            second = state[2 * k + 1] / (1 - 0.999**t)
            moved.append(0.1 * first / (np.sqrt(second) + 1e-8))
        w, v, b = w - moved[0], v - moved[1], b - moved[2]
    return {sample.terms[t]: float(x) for t, x in zip(kept, w) if abs(x) > 1e-3}, v, float(b), margin()


def score_toxicity(docs: DataFrame, row_id: str, text: str, model: ToxicityModel) -> DataFrame:
    """`row_id`, `score` in 0 to 1 for every row, over its whole text.

    NULL and empty texts get the score of a text without words. Repeated rows get equal scores;
    an empty table gives none. Only the text is looked at.
    """
    schema = T.StructType(
        [T.StructField(row_id, docs.schema[row_id].dataType), T.StructField("score", T.DoubleType())]
    )

    def make():
        score = model.scorer()
        return lambda piece: {row_id: piece[row_id], "score": score(piece[text])}

    return map_text(docs, [row_id], text, schema, make)


@query("op3_weak_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_toxicity(docs, labels, "doc_id", "text", "toxic")
    scored = score_toxicity(docs, "doc_id", "text", model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
