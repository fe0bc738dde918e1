"""Removal of repeated byte strings with run-length compressed suffix indexes.

Every window of `length` bytes is filed under its smallest hashed gram, so equal windows meet under
the same number. Consecutive windows with the same number form a piece of text. Numbers that occur
once in the corpus are done; equal pieces are one entry with its count; the different pieces of the
other numbers go in blocks to tasks that build a run-length Burrows-Wheeler index of them: suffix order,
runs, and samples at the ends of runs only. The longest match of a run's first and last suffix
with its neighbours is compared directly; the matching statistics of all other positions follow from
the sample before them, one less for each byte, in one pass over the text. A window whose statistic
reaches `length` is marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_schema, byte_slices, map_text, mix, sliding_min, stored
from millrace.llm.registry import query, table

LENGTH = 400
GRAM = 128
PIECE = 1024
"""Most windows of one piece; long runs under one number are cut."""

BLOCK_BYTES = 3 << 20
"""Mean text of a block."""

MANY = 1_000
"""Different pieces of one number that may meet in a block; more are first cut down to the windows
they share. Both ways mark the same windows."""

SEEN = 100_000
"""Pieces a task remembers to send equal ones once."""

MULTIPLIER = 0x9E3779B97F4A7C15
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


class Grams:
    """Hashes of all runs of `size` bytes of a text, from running sums of powers."""

    def __init__(self, size: int):
        self.size = size
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(MULTIPLIER, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("powers", MULTIPLIER), ("inverses", inverse)):
                    factors = np.full(n, base, np.uint64)
                    factors[0] = 1
                    setattr(self, name, np.multiply.accumulate(factors))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n, k = len(data), self.size
        self._reach(n)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(SYMBOLS[data] * self.powers[:n], out=sums[1:])
            return mix((sums[k:] - sums[:-k]) * self.inverses[: n - k + 1])


def numbers(raw: bytes, grams: Grams, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of every window of `length` bytes, the numbers of the chosen grams: one for each
    position that is the smallest of some window)."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    width = length - grams.size + 1
    hashed = grams(data)
    low = sliding_min(hashed, width)
    # A gram is chosen if the largest minimum of the windows around it is its own value.
    padded = np.concatenate([np.full(width - 1, ~np.uint64(0)), ~low, np.full(width - 1, ~np.uint64(0))])
    high = ~sliding_min(padded, width)
    return low, hashed[hashed == high]


def pieces(low: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int]]:
    """(first window, end, number) of the runs of windows whose number is in the sorted `wanted`."""
    if not len(low) or not len(wanted):
        return []
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(low)]])
    values = low[starts]
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    met = wanted[at] == values
    out = []
    for a, b, v in zip(starts[met].tolist(), ends[met].tolist(), values[met].tolist()):
        out += [(c, min(b, c + PIECE), v) for c in range(a, b, PIECE)]
    return out


def suffix_order(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each position) of texts laid end to end; `left` is the number of bytes
    from a position to the end of its text. Ends differ from every byte and from each other. Ranks
    are refined by doubling; only suffixes that are not yet told apart are sorted again."""
    n, first = len(data), 7
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(first):
        byte = np.where(left > k, padded[k : k + n], 0).astype(np.uint64)
        key = (key << np.uint64(8)) | byte
    key = (key << np.uint64(8)) | np.minimum(left, first).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(n, np.int64)

    def settle(slots, members, changed):
        """Give groups of equal keys the slot of their first member; return what is still tied."""
        head = np.flatnonzero(changed)
        sizes = np.diff(np.append(head, len(members)))
        rank[members] = np.repeat(slots[head], sizes)
        tied = np.repeat(sizes > 1, sizes)
        return slots[tied], members[tied]

    slots, members = settle(np.arange(n), order, np.concatenate([[True], key[1:] != key[:-1]]) if n else key.astype(bool))
    step = first
    while len(members):
        ended = left[members] <= step
        after = np.where(ended, members, n + rank[np.minimum(members + step, n - 1)])
        key = rank[members] * (2 * n + 1) + after
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[slots] = members
        slots, members = settle(slots, members, np.concatenate([[True], key[1:] != key[:-1]]))
        step *= 2
    return order, rank


def common_prefix(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the match of the suffixes at `a` and `b`, within their texts."""
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    words = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    going = np.arange(len(a))
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        differ = words[x] ^ words[y]
        same = differ == 0
        lowest = differ & (~differ + np.uint64(1))
        with np.errstate(divide="ignore"):
            equal_bytes = np.where(same, 8, np.floor(np.log2(np.maximum(lowest, 1).astype(np.float64))).astype(np.int64) // 8)
        out[going] += equal_bytes
        on = same & (out[going] < most[going])
        going = going[on]
    return np.minimum(out, most)


class RunIndex:
    """Run-length compressed Burrows-Wheeler index of texts laid end to end: the runs, and for the
    first and the last suffix of each run its position and its match with the suffix before it and
    after it."""

    def __init__(self, data: np.ndarray, left: np.ndarray, start: np.ndarray):
        """`start`: whether a text begins at the position."""
        order, _ = suffix_order(data, left)
        before = np.where(start[order], 256 + np.arange(len(order)), data[order - 1])
        edge = before[1:] != before[:-1]
        heads = np.concatenate([[0], np.flatnonzero(edge) + 1])
        tails = np.concatenate([np.flatnonzero(edge), [len(order) - 1]])
        self.symbols = before[heads]
        self.head_at, self.tail_at = order[heads], order[tails]
        up, down = heads[heads > 0], tails[tails < len(order) - 1]
        self.head_match = np.zeros(len(heads), np.int64)
        self.tail_match = np.zeros(len(tails), np.int64)
        self.head_match[heads > 0] = common_prefix(data, left, order[up], order[up - 1])
        self.tail_match[tails < len(order) - 1] = common_prefix(data, left, order[down], order[down + 1])

    def statistics(self, size: int) -> np.ndarray:
        """For each position the length of its longest match that begins at another position."""
        best = np.zeros(size, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            # Between samples a match loses one byte for each step: the last sample + its position.
            reach = np.full(size, -1, np.int64)
            reach[at] = at
            reach = np.maximum.accumulate(reach)
            value = np.zeros(size, np.int64)
            value[at] = match + at
            best = np.maximum(best, value[reach] - np.arange(size))
        return best


def long_matches(bodies: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each of some different texts the spans (first window, end) of windows of `length` bytes that
    also begin elsewhere in them."""
    if not bodies:
        return []
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    start = np.zeros(len(data), dtype=bool)
    start[ends - sizes] = True
    marked = RunIndex(data, left, start).statistics(len(data)) >= length
    # The statistic of a text's first byte has a sample of its own, so texts don't run together.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        while a < b:
            k = int(np.searchsorted(ends, a, "right"))
            stop = min(b, int(ends[k]))
            base = int(ends[k] - sizes[k])
            out[k].append((a - base, stop - base))
            a = stop
    return out


def repeated_spans(
    spark: SparkSession, docs: DataFrame, row_id: str, text: str, length: int = LENGTH
) -> DataFrame:
    """`row_id`, `text_key` (a hash of the text), `spans`: array of (`start`, `end`) byte spans, not
    merged, of the rows that have windows of `length` bytes which also begin elsewhere, in this row
    or another. Equal rows come once.

    NULL, empty and short texts have no windows; repeated rows repeat each other; other columns are
    not read; an empty table gives no rows. Groups of copies are counted, not indexed, so they
    add one text to a block whatever their number.
    """
    gram = min(GRAM, max(8, length // 3))
    kind = docs.schema[row_id].dataType
    keyed = docs.select(
        F.col(row_id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text")
    )
    found = stored(spark, _chosen(keyed, kind, gram, length), "window-numbers")
    shared = found.groupBy("number").agg(F.sum("n").alias("n")).where("n > 1").select("number")
    wanted = found.select("_id", "_key", "number").join(shared, "number").groupBy("_id", "_key").agg(
        F.collect_set("number").alias("_numbers")
    )
    wanted = stored(spark, wanted, "shared-numbers").select(
        F.col("_id").alias("_wid"), F.col("_key").alias("_wkey"), "_numbers"
    )
    held = keyed.join(
        wanted.hint("shuffle_hash"), (F.col("_key") == F.col("_wkey")) & F.col("_id").eqNullSafe(F.col("_wid"))
    ).select("_id", "_key", "_text", "_numbers")
    cut = stored(spark, _pieces(held, kind, gram, length), "pieces")
    bodies = cut.where("body is not null").select("number", "piece", "body")
    different = cut.select("number", "piece").distinct().groupBy("number").count()
    hot = stored(spark, different.where(F.col("count") > MANY).select("number"), "hot-numbers")
    if hot.isEmpty():
        marked = _marked(bodies, length)
    else:
        marked = _marked(bodies.join(hot, "number", "left_anti"), length).unionByName(
            _hot_spans(spark, bodies.join(hot, "number", "left_semi"), length)
        )
    members = cut.select("_id", "_key", "piece", "start", "size")
    many = members.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("end"))
    whole = many.where("n > 1").select("piece", F.lit(0).alias("first"), "end")
    spans = stored(spark, marked.unionByName(whole), "marked")
    return (
        members.join(spans, "piece")
        .select(
            "_id",
            "_key",
            F.struct(
                (F.col("start") + F.col("first")).alias("start"),
                (F.col("start") + F.col("end") + length - 1).alias("end"),
            ).alias("span"),
        )
        .groupBy("_id", "_key")
        .agg(F.collect_set("span").alias("spans"))
        .select(F.col("_id").alias(row_id), F.col("_key").alias("text_key"), "spans")
    )


def _marked(bodies: DataFrame, length: int) -> DataFrame:
    """`piece`, `first`, `end`: repeated windows among the pieces of each number, block by block."""
    blocks = 1 + (bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // BLOCK_BYTES
    dealt = bodies.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_index_block(length), "piece binary, first int, end int")


def _hot_spans(spark: SparkSession, bodies: DataFrame, length: int) -> DataFrame:
    """As `_marked`, for numbers with so many different pieces that they must not meet in a block.

    The starts of windows are counted by hash, which Spark does map-side, and the pieces cut down to
    the windows that start twice or more, in one piece or in several. What surrounds a common passage
    falls away, and the passage is left as a few equal pieces, which are indexed like all others.
    """
    bodies = stored(spark, bodies.dropDuplicates(["piece"]), "hot-pieces")

    def windows():
        grams = Grams(length)

        def run(piece):
            found = [np.unique(grams(np.frombuffer(x, np.uint8)), return_counts=True) for x in piece["body"]]
            own = [f[0] for f in found]
            rows = np.repeat(np.arange(len(own)), [len(o) for o in own])
            flat = np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)
            starts = np.concatenate([f[1] for f in found]) if own else np.empty(0, np.int64)
            return {
                "number": np.array(piece["number"], np.int64)[rows] if len(own) else flat,
                "piece": pa.array(piece["piece"], pa.binary()).take(pa.array(rows)),
                "window": flat,
                "starts": starts,
            }

        return run

    kinds = T.StructType(
        [
            T.StructField("number", T.LongType()),
            T.StructField("piece", T.BinaryType()),
            T.StructField("window", T.LongType()),
            T.StructField("starts", T.LongType()),
        ]
    )
    seen = stored(spark, map_text(bodies, ["number", "piece"], "body", kinds, windows), "hot-windows")
    shared = seen.groupBy("number", "window").agg(F.sum("starts").alias("n")).where("n > 1").select("number", "window")
    wanted = seen.join(shared, ["number", "window"]).groupBy("piece").agg(F.collect_set("window").alias("windows"))

    def trim():
        import xxhash

        grams, sent = Grams(length), set()

        def run(piece):
            rows = []
            for number, name, body, found in zip(*(piece[c] for c in ("number", "piece", "body", "windows"))):
                own = grams(np.frombuffer(body, np.uint8))
                sought = np.array(found, dtype=np.int64).view(np.uint64)
                met = np.concatenate([[0], np.isin(own, sought).astype(np.int8), [0]])
                edge = np.flatnonzero(np.diff(met))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    part = body[a : b + length - 1]
                    short = xxhash.xxh3_128_digest(part)
                    if len(sent) >= SEEN:
                        sent.clear()
                    new = short not in sent
                    sent.add(short)
                    rows.append((number, name, a, b - a, short, part if new else None))
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in cut.names]
            return dict(zip(cut.names, columns))

        return run

    cut = T.StructType(
        [
            T.StructField("number", T.LongType()),
            T.StructField("whole", T.BinaryType()),
            T.StructField("offset", T.IntegerType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("piece", T.BinaryType()),
            T.StructField("part", T.BinaryType()),
        ]
    )
    parts = map_text(bodies.join(wanted, "piece"), ["number", "piece", "windows"], "body", cut, trim)
    parts = stored(spark, parts, "hot-parts")
    marked = _marked(parts.where("part is not null").select("number", "piece", F.col("part").alias("body")), length)
    many = parts.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("end"))
    spans = marked.unionByName(many.where("n > 1").select("piece", F.lit(0).alias("first"), "end"))
    return parts.select("whole", "offset", "piece").join(spans, "piece").select(
        F.col("whole").alias("piece"),
        (F.col("offset") + F.col("first")).alias("first"),
        (F.col("offset") + F.col("end")).alias("end"),
    )


def _chosen(keyed: DataFrame, kind: T.DataType, gram: int, length: int) -> DataFrame:
    schema = T.StructType(
        [T.StructField("_id", kind)] + [T.StructField(c, T.LongType()) for c in ("_key", "number", "n")]
    )
    out = arrow_schema(schema)

    def run(batches):
        grams = Grams(gram)
        for piece in byte_slices(batches, ["_id", "_key"], "_text"):
            values, counts, rows = [], [], []
            for i, raw in enumerate(piece["_text"]):
                own, n = np.unique(numbers(raw, grams, length)[1], return_counts=True)
                values.append(own)
                counts.append(n)
                rows.append(np.full(len(own), i))
            rows = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(piece["_id"], out.field(0).type).take(rows),
                    pa.array(piece["_key"], pa.int64()).take(rows),
                    pa.array(np.concatenate(values).view(np.int64) if values else [], pa.int64()),
                    pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                ],
                schema=out,
            )

    return keyed.mapInArrow(run, schema)


def _pieces(held: DataFrame, kind: T.DataType, gram: int, length: int) -> DataFrame:
    """One row per piece; its text comes with the first of equal pieces of a task."""
    schema = T.StructType(
        [
            T.StructField("_id", kind),
            T.StructField("_key", T.LongType()),
            T.StructField("number", T.LongType()),
            T.StructField("piece", T.BinaryType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("body", T.BinaryType()),
        ]
    )

    def make():
        import xxhash

        grams, seen = Grams(gram), set()

        def run(piece):
            rows = []
            for doc, key, raw, wanted in zip(piece["_id"], piece["_key"], piece["_text"], piece["_numbers"]):
                low, _ = numbers(raw, grams, length)
                sought = np.sort(np.array(wanted, dtype=np.int64).view(np.uint64))
                for start, end, number in pieces(low, sought):
                    body = raw[start : end + length - 1]
                    name = xxhash.xxh3_128_digest(body)
                    if len(seen) >= SEEN:
                        seen.clear()
                    new = name not in seen
                    seen.add(name)
                    signed = number - (1 << 64) if number >> 63 else number
                    rows.append((doc, key, signed, name, start, end - start, body if new else None))
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in schema]
            return dict(zip(schema.names, columns))

        return run

    return map_text(held, ["_id", "_key", "_numbers"], "_text", schema, make)


def _index_block(length: int):
    def run(block: pa.Table) -> pa.Table:
        by_number: dict[int, dict[bytes, bytes]] = {}
        for batch in block.to_batches():
            for number, name, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("number", "piece", "body"))):
                by_number.setdefault(number, {})[name] = body
        # A number with one piece has nothing to match but its own copies, which are counted, and
        # itself, where it holds its gram twice; that shows in a piece of several windows.
        names, bodies = [], []
        for own in by_number.values():
            names += own
            bodies += own.values()
        out = [(n, a, b) for n, spans in zip(names, long_matches(bodies, length)) for a, b in spans]
        columns = [list(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()))],
            names=["piece", "first", "end"],
        )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap, joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside merged spans."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    row_id: str,
    text: str,
    length: int = LENGTH,
    as_text: bool = False,
    more: DataFrame | None = None,
) -> DataFrame:
    """For every row of `docs` that loses bytes: `row_id`, `text_key`, `n_removed`, `spans` (merged),
    `kept` (bytes, or with `as_text` a string without characters that were cut through). Rows that lose nothing are not listed; equal rows come once. See
    `repeated_spans` for odd input. `more`: further spans to remove, in the columns of `repeated_spans`; rows with
    such spans then have `kept_without`, what would be kept without these, and the others NULL."""
    spans = repeated_spans(spark, docs, row_id, text, length)
    carried = ["spans"]
    if more is not None:
        carried.append("more")
        none = F.lit(None).cast(spans.schema["spans"].dataType)
        further = more.select(row_id, "text_key", none.alias("spans"), F.col("spans").alias("more"))
        spans = spans.withColumn("more", none).unionByName(further).groupBy(row_id, "text_key").agg(
            *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in carried]
        )
    spans = stored(spark, spans, "spans")
    keyed = docs.select(
        F.col(row_id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text")
    )
    held = keyed.join(
        spans.select(F.col(row_id).alias("_wid"), F.col("text_key").alias("_wkey"), *carried).hint("shuffle_hash"),
        (F.col("_key") == F.col("_wkey")) & F.col("_id").eqNullSafe(F.col("_wid")),
    ).select("_id", "_key", "_text", *carried)
    body = T.StringType() if as_text else T.BinaryType()
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("kept", body),
        ]
        + ([] if more is None else [T.StructField("kept_without", body)])
    )

    def rest(raw, own):
        kept = cut_out(raw, own)
        return kept.decode("utf-8", "ignore") if as_text else kept

    def make():
        def run(piece):
            out = []
            for doc, key, raw, *found in zip(*(piece[c] for c in ("_id", "_key", "_text", *carried))):
                found = [[(s["start"], s["end"]) for s in spans] for spans in found]
                own = merged(sum(found, []))
                row = (doc, key, sum(b - a for a, b in own), [list(s) for s in own], rest(raw, own))
                if len(carried) > 1:
                    row += (rest(raw, merged(found[0])) if found[1] else None,)
                out.append(row)
            columns = [list(c) for c in zip(*out)] if out else [[] for _ in schema]
            return dict(zip(schema.names, columns))

        return run

    return map_text(held, ["_id", "_key", *carried], "_text", schema, make)


@query("op4_run_length_index")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cut = remove_repeats(spark, docs, "doc_id", "text").select(
        F.col("doc_id").alias("_id"),
        F.col("text_key").alias("_key"),
        F.col("n_removed").alias("_removed"),
        F.size("spans").cast("bigint").alias("_spans"),
        F.sha2("kept", 256).alias("_sha"),
    )
    cut = stored(spark, cut.dropDuplicates(["_id", "_key"]), "cut")
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    whole = docs.select(
        "doc_id", F.xxhash64("text").alias("key"), F.octet_length(body).cast("bigint").alias("n_bytes"),
        F.sha2(body, 256).alias("sha"),
    )
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return whole.join(cut, same, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("_sha", "sha").alias("kept_sha256"),
    )
