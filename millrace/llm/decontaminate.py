"""Benchmark decontamination: passages near to a benchmark item in edit distance.

The CGK random walk embeds a word sequence so that few edits leave most of the embedded positions
alike: each step writes the current word and, by a random bit of (step, word), stays or moves on.
Windows of the size of the items begin at every word (at every second for items from 32 words on, and
so on). Windows and items whose embeddings agree at a few sampled positions become candidates; the
number of repetitions, each with its own walk and positions, is the least that finds the target share
of simulated items with as many edits as are allowed, whatever that number of edits is. Sizes that do
not reach it are searched for exactly: of `edits + 1` disjoint word runs of an item one is left as it
is, so a passage holds one of them. Candidates are verified by their edit distance.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Cache, filter_rows, gram_hashes, map_text, stored
from millrace.llm.registry import query, table

MIN_WORDS = 8
"""Shorter items have no edits and are searched for exactly, as whole word runs."""

EDIT_PERCENT = 12
"""Words of an item that may be replaced, dropped or put in."""

SAMPLED = 3
TARGET = 0.95
MOST_REPEATS = 12
TRIALS = 200
"""Simulated passages for each number of edits."""

WALK_BYTES = 64 << 20
"""Walks of a class that would take more are not tried; its items are searched for exactly."""

MAX_ITEMS, MAX_ITEM_WORDS = 20_000, 50_000
MAX_CELLS = 1 << 27
"""Items, their distinct words, and the product of both, that one search takes: they go to every task (up
to about 1 KB for each distinct word). A larger benchmark is searched for in parts; an item that is beyond
a bound by itself is a part of its own."""

STRIPPED = " .,;:!?\"'()[]{}…¡¿«»"

ASCII_STRIPPED = bytes(c for c in STRIPPED.encode() if c < 128)
BLOCK = 1 << 15
"""Starts searched at once; their positions stay in a core's cache."""

PAIRS = 1 << 20
"""Starts with an item each that are looked at together."""


def plain(word: bytes) -> bytes:
    return word.decode("utf-8", "replace").lower().strip(STRIPPED).encode("utf-8")


def plain_words(raw: bytes) -> list[bytes]:
    """Words, lower-cased, without punctuation at their ends; what is only punctuation is left out."""
    return [w for w in map(plain, raw.split()) if w]


def allowed_edits(size: int) -> int:
    return size * EDIT_PERCENT // 100


def edit_span(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, first, end) of the part of `text` nearest to `item`, if it is within `most` edits; on
    ties the earliest end, then the latest start. Bit-parallel over the item's words."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)

    def best_end(masks, words):
        up, down, score, best = full, 0, len(item), (len(item), 0)
        for k, w in enumerate(words, 1):
            eq = masks.get(w, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if plus & top:
                score += 1
            if minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if score < best[0]:
                best = (score, k)
        return best

    edits, end = best_end(masks, text)
    if edits > most:
        return None
    back: dict[int, int] = {}
    for i, w in enumerate(reversed(item)):
        back[w] = back.get(w, 0) | 1 << i
    return edits, end - best_end(back, text[:end][::-1])[1], end


@dataclass(frozen=True)
class Repeat:
    """One walk with its sampled positions, what the items show at the first of them, at the first two
    and so on, and the items by all they show."""

    bits: np.ndarray
    samples: list[int]
    known: list[np.ndarray]
    sizes: np.ndarray
    offsets: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class SizeClass:
    """Items of `size` to `2 * size - 1` words."""

    size: int
    stride: int
    repeats: list[Repeat]


@dataclass(frozen=True)
class Runs:
    """Disjoint runs of `length` words, one more than its edits of each item: their hashes, and the item
    and the place in it by hash. `least` is the size of the shortest item."""

    length: int
    least: int
    known: np.ndarray
    sizes: np.ndarray
    offsets: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray


def _embed(words: list[int], bits: np.ndarray, samples: list[int]) -> tuple[int, ...]:
    at, out = 0, []
    for step in range(samples[-1] + 1):
        word = words[at] if at < len(words) else 0
        if step in samples:
            out.append(word)
        at += int(bits[step, word])
    return tuple(out)


class Index:
    """The items of all sizes, ready to be searched for."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int = 7):
        found = [(i, plain_words(raw)) for i, raw in items]
        self.items = [(i, w) for i, w in found if w]
        words = sorted({w for _, own in self.items for w in own})
        self.numbers = {w: k for k, w in enumerate(words, 1)}
        self.other = len(words) + 1
        self.coded = [[self.numbers[w] for w in own] for _, own in self.items]
        self.classes, exact = [], [k for k, c in enumerate(self.coded) if len(c) < MIN_WORDS]
        size = MIN_WORDS
        random = np.random.RandomState(seed)
        while any(len(c) >= size for c in self.coded):
            own = [k for k, c in enumerate(self.coded) if size <= len(c) < 2 * size]
            if own:
                made = self._class(size, own, random)
                if made:
                    self.classes.append(made)
                else:
                    exact += own
            size *= 2
        self.exact = set(exact)
        by_length: dict[int, list[int]] = {}
        for k in exact:
            by_length.setdefault(len(self.coded[k]) // (allowed_edits(len(self.coded[k])) + 1), []).append(k)
        self.runs = [self._runs(length, own) for length, own in sorted(by_length.items())]
        self.longest = max((len(c) for c in self.coded), default=0)

    def _class(self, size: int, own: list[int], random) -> SizeClass | None:
        """None if the walks do not find the target share of the items of each number of edits."""
        steps, stride = size * 3 // 2, max(1, size // 16)
        if MOST_REPEATS * steps * (self.other + 1) > WALK_BYTES:
            return None
        # The step and the sampled positions come before the end of the shortest item most times.
        walks = []
        for _ in range(MOST_REPEATS):
            bits = random.randint(0, 2, (steps, self.other + 1)).astype(np.int8)
            walks.append((bits, sorted(random.choice(steps, SAMPLED, replace=False).tolist())))
        by_edits: dict[int, list[int]] = {}
        for k in own:
            by_edits.setdefault(allowed_edits(len(self.coded[k])), []).append(k)
        count = 1
        for _, alike in sorted(by_edits.items(), reverse=True):
            hits = np.zeros((TRIALS, MOST_REPEATS), dtype=bool)
            for row in range(TRIALS):
                item = self.coded[alike[row % len(alike)]]
                other = self._edited(item, stride, random)
                for r, (bits, samples) in enumerate(walks):
                    hits[row, r] = _embed(item, bits, samples) == _embed(other, bits, samples)
            enough = np.flatnonzero(np.logical_or.accumulate(hits, axis=1).mean(axis=0) >= TARGET)
            if not len(enough):
                return None
            count = max(count, int(enough[0]) + 1)
        return SizeClass(size, stride, [self._repeat(own, *w) for w in walks[:count]])

    def _runs(self, length: int, own: list[int]) -> Runs:
        hashes, items, places = [], [], []
        for k in own:
            at = np.arange(allowed_edits(len(self.coded[k])) + 1) * length
            hashes.append(gram_hashes(np.array(self.coded[k], np.uint64), length)[at])
            items.append(np.full(len(at), k))
            places.append(at)
        keys = np.concatenate(hashes)
        by = np.argsort(keys, kind="stable")
        known, sizes = np.unique(keys, return_counts=True)
        mask = np.zeros(1 << max(16, (16 * len(known)).bit_length()), dtype=bool)
        mask[(known & np.uint64(len(mask) - 1)).astype(np.int64)] = True
        least = min(len(self.coded[k]) for k in own)
        return Runs(
            length, least, known, sizes, np.cumsum(sizes) - sizes, np.concatenate(items)[by], np.concatenate(places)[by], mask
        )

    def _edited(self, words: list[int], stride: int, random) -> list[int]:
        """The item with as many random edits as are allowed, begun up to half a stride off."""
        out = list(words)
        for _ in range(allowed_edits(len(words))):
            at, kind = random.randint(0, len(out)), random.randint(0, 3)
            if kind == 0:
                out[at] = self.other
            elif kind == 1:
                out.insert(at, self.other)
            else:
                del out[at]
        off = random.randint(0, stride // 2 + 1)
        return out[off:] if random.randint(0, 2) else [self.other] * off + out

    def _repeat(self, own: list[int], bits: np.ndarray, samples: list[int]) -> Repeat:
        shown = {k: _embed(self.coded[k], bits, samples) for k in own}
        known = []
        for depth in range(1, SAMPLED + 1):
            known.append(np.unique(np.array([self._key(s[:depth]) for s in shown.values()], dtype=np.int64)))
        keys = np.array([self._key(s) for s in shown.values()], dtype=np.int64)
        by = np.argsort(keys, kind="stable")
        _, sizes = np.unique(keys, return_counts=True)
        items = np.array(list(shown), dtype=np.int64)[by]
        return Repeat(bits[: samples[-1]], samples, known, sizes, np.cumsum(sizes) - sizes, items)

    def _key(self, words) -> int:
        key = 0
        for w in words:
            key = key * (self.other + 1) + w
        return key

    def searcher(self):
        """Function from texts to, for each, its matches (item, first word, end, edits)."""
        numbers, other = self.numbers, self.other

        def number(word: bytes) -> int:
            """0 is the gap between documents; -1 a word without anything left of it."""
            word = word.strip(ASCII_STRIPPED).lower() if word.isascii() else plain(word)
            return numbers.get(word, other) if word else -1

        cache = Cache(400_000, number)
        gap = np.zeros(max([1, *(3 * c.size for c in self.classes), *(r.length for r in self.runs)]), np.int64)
        member = np.zeros((len(self.coded), other + 1), dtype=np.int8)
        for k, own in enumerate(self.coded):
            member[k, own] = 1
        edits = np.array([allowed_edits(len(c)) for c in self.coded], dtype=np.int64)

        def walk(repeat: Repeat, words: np.ndarray, starts: np.ndarray):
            """Starts whose embedding shows what some item shows, with the key."""
            at, begun, key, step = starts.copy(), starts, None, 0
            for depth, sample in enumerate(repeat.samples):
                while step < sample:
                    at += repeat.bits[step].take(words.take(at))
                    step += 1
                seen = words.take(at)
                if key is None:
                    table_ = np.zeros(other + 1, dtype=bool)
                    table_[repeat.known[0]] = True
                    kept = table_.take(seen)
                    key = seen
                else:
                    key = key * (other + 1) + seen
                    known = repeat.known[depth]
                    kept = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                at, begun, key = at[kept], begun[kept], key[kept]
            return begun, key

        def near(words: np.ndarray, begun, items, spare, size: int):
            """Which of the starts have, among their first `size` words, no more than `spare` that are
            foreign to the item."""
            left = np.arange(len(begun))
            for d in range(size):
                spare = spare - (member[items, words.take(begun + d, mode="clip")] == 0)
                if d % 4 == 3 or d == size - 1:
                    kept = spare >= 0
                    begun, items, spare, left = begun[kept], items[kept], spare[kept], left[kept]
            return left

        def each(slot: np.ndarray, sizes: np.ndarray, offsets: np.ndarray):
            """(rows of `slot`, entries) for every entry of every slot, a bounded number at a time."""
            ends = np.cumsum(sizes[slot])
            low = 0
            while low < len(slot):
                base = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
                n = sizes[slot[low:high]]
                rows = np.repeat(np.arange(low, high), n)
                yield rows, np.repeat(offsets[slot[low:high]] - np.cumsum(n) + n, n) + np.arange(len(rows))
                low = high

        def candidates(words: np.ndarray, starts: np.ndarray, firsts: np.ndarray) -> set[tuple[int, int, int]]:
            """(document, start, item)."""
            found: set[tuple[int, int, int]] = set()
            document = np.searchsorted(firsts, starts, "right") - 1
            place = starts - firsts[document]

            def add(at, begun, items):
                found.update(zip((np.searchsorted(firsts, at, "right") - 1).tolist(), begun.tolist(), items.tolist()))

            for group in self.classes:
                grid = starts[place % group.stride == 0]
                for low, repeat in itertools.product(range(0, len(grid), BLOCK), group.repeats):
                    at, key = walk(repeat, words, grid[low : low + BLOCK])
                    slot = np.searchsorted(repeat.known[-1], key)
                    for rows, entries in each(slot, repeat.sizes, repeat.offsets):
                        begun, items = at[rows], repeat.items[entries]
                        # Of the first words at most the edits and the offset can be foreign to the item.
                        left = near(words, begun, items, edits[items] + group.stride // 2, group.size)
                        add(begun[left], begun[left], items[left])
            coded = words.astype(np.uint64) if self.runs else None
            for runs in self.runs:
                hashed = gram_hashes(coded, runs.length)
                at = np.flatnonzero(runs.filter.take((hashed & np.uint64(len(runs.filter) - 1)).astype(np.int64)))
                slot = np.minimum(np.searchsorted(runs.known, hashed[at]), len(runs.known) - 1)
                met = runs.known[slot] == hashed[at]
                at, slot = at[met], slot[met]
                for rows, entries in each(slot, runs.sizes, runs.offsets):
                    items = runs.items[entries]
                    begun = at[rows] - runs.places[entries]
                    # An edit before the run moves the start or is one foreign word; so does one behind it.
                    left = near(words, begun, items, edits[items], runs.least)
                    add(at[rows][left], begun[left], items[left])
            return found

        def search(texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
            coded, bases, at = [], [], 0
            for raw in texts:
                split = raw.split()
                own = np.fromiter(map(cache.__getitem__, split), np.int64, len(split))
                own = own[own >= 0]
                bases.append((at, at + len(own)))
                coded += [own, gap]
                at += len(own) + len(gap)
            out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
            if not at or not self.coded:
                return out
            words = np.concatenate(coded)
            starts = np.concatenate([np.arange(a, b) for a, b in bases])
            firsts = np.array([a for a, _ in bases])
            hits: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
            last: dict[tuple[int, int], int] = {}
            for doc, begun, k in sorted(candidates(words, starts, firsts)):
                a, b = bases[doc]
                most, size = int(edits[k]), len(self.coded[k])
                if k in self.exact:
                    # The slack takes in the starts right behind one that has been looked at.
                    if (doc, k) in last and begun - last[doc, k] <= self._slack(size):
                        continue
                    last[doc, k] = begun
                low = max(a, begun - most - self._slack(size))
                high = min(b, begun + size + most + self._slack(size))
                hit = edit_span(self.coded[k], words[low:high].tolist(), most)
                if hit:
                    hits.setdefault((doc, k), set()).add((hit[0], low + hit[2] - a, a - low - hit[1]))
            for (doc, k), own in hits.items():
                # Seen from a start beside it, a passage shows a worse match that overlaps it.
                taken: list[tuple[int, int]] = []
                for cost, end, minus_first in sorted(own):
                    i = bisect.bisect(taken, (-minus_first, end))
                    if (i == 0 or taken[i - 1][1] <= -minus_first) and (i == len(taken) or end <= taken[i][0]):
                        taken.insert(i, (-minus_first, end))
                        out[doc].append((self.items[k][0], -minus_first, end, cost))
            return [sorted(m, key=lambda x: (x[1], x[2], str(x[0]))) for m in out]

        return search

    @staticmethod
    def _slack(size: int) -> int:
        return max(1, size // 16)


def read_parts(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in parts below the bounds, one at a time on the driver; an empty one is one part."""
    part: list[tuple] = []
    words: set[bytes] = set()
    for row in items.select(item_id, F.col(text).cast("binary")).toLocalIterator():
        raw = bytes(row[1] or b"")
        own = set(plain_words(raw))
        n, distinct = len(part) + 1, len(words) + sum(w not in words for w in own)
        if part and (n > MAX_ITEMS or distinct > MAX_ITEM_WORDS or n * distinct > MAX_CELLS):
            yield part
            part, words = [], set()
        part.append((row[0], raw))
        words |= own
    yield part


def find_passages(docs: DataFrame, row_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """`row_id`, `matches`: array of (`item`, `first`, `end`, `edits`) by word numbers, for every row.

    Words are lower-cased and stripped of punctuation at their ends. NULL and empty texts have no
    matches; items without words are not looked for; repeated items match
    each, repeated rows are searched each. Matches of an item do not overlap: the one of least edits
    stands. An empty table gives no rows. A benchmark of several parts reads `docs` once for each and once
    to put the matches together.
    """
    match = T.StructType(
        [T.StructField("item", items.schema[item_id].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("first", "end", "edits")]
    )
    schema = T.StructType(
        [T.StructField(row_id, docs.schema[row_id].dataType), T.StructField("matches", T.ArrayType(match))]
    )

    def searched(rows: DataFrame, columns: list[str], index: Index, kinds: T.StructType) -> DataFrame:
        def make():
            search = index.searcher()

            def run(piece):
                made = [[dict(zip(match.names, m)) for m in found] for found in search(piece[text])]
                return {**{c: piece[c] for c in columns}, "matches": made}

            return run

        return map_text(rows, columns, text, kinds, make)

    parts = read_parts(items, item_id, item_text)
    part, following = next(parts), next(parts, None)
    if following is None:
        return searched(docs, [row_id], Index(part), schema)
    keyed = docs.select(
        F.col(row_id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias(text)
    )
    kinds = T.StructType(
        [T.StructField("_id", docs.schema[row_id].dataType), T.StructField("_key", T.LongType()), schema["matches"]]
    )
    found = None
    for part in itertools.chain([part, following], parts):
        own = searched(keyed, ["_id", "_key"], Index(part), kinds).where(F.size("matches") > 0)
        # Rows that are repeated, id and text, have the same matches.
        own = stored(docs.sparkSession, own.dropDuplicates(["_id", "_key"]), "part-matches")
        found = own if found is None else found.unionByName(own)
    whole = found.select("_id", "_key", F.explode("matches").alias("m")).groupBy("_id", "_key").agg(
        F.sort_array(
            F.collect_list(F.struct("m.first", "m.end", F.col("m.item").cast("string").alias("name"), "m"))
        )["m"].alias("matches")
    )
    rows = docs.select(F.col(row_id).alias("_row"), F.xxhash64(F.col(text)).alias("_text"))
    same = (F.col("_text") == F.col("_key")) & F.col("_row").eqNullSafe(F.col("_id"))
    return rows.join(whole, same, "left").select(
        F.col("_row").alias(row_id),
        F.coalesce("matches", F.array().cast(schema["matches"].dataType)).alias("matches"),
    )


def without_passages(docs: DataFrame, row_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The rows of `docs`, all columns, that have no match. See `find_passages`."""
    parts = read_parts(items, item_id, item_text)
    part, following = next(parts), next(parts, None)

    def filtered(rows: DataFrame, keep: bool, index: Index) -> DataFrame:
        def make():
            search = index.searcher()
            return lambda texts: [bool(found) != keep for found in search(texts)]

        return filter_rows(rows, text, make)

    if following is None:
        return filtered(docs, True, Index(part))
    keyed = docs.select(
        F.col(row_id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias(text)
    )
    found = None
    for part in itertools.chain([part, following], parts):
        own = filtered(keyed, False, Index(part)).select("_id", "_key").distinct()
        own = stored(docs.sparkSession, own, "part-contaminated")
        found = own if found is None else found.unionByName(own)
    same = (F.xxhash64(docs[text]) == found["_key"]) & docs[row_id].eqNullSafe(found["_id"])
    return docs.join(found, same, "left_anti")


@query("op6_embedded_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = find_passages(docs, "doc_id", "text", items, "item_id", "text")
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("matches.item"))).alias("item_ids"),
        F.size("matches").cast("bigint").alias("n_passages"),
        F.array_min(F.col("matches.edits")).alias("least_edits"),
    )
