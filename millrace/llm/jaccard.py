"""Exact Jaccard join of word n-gram sets, by a size-aware heavy-light join.

Equal sets become one class first. Every set is put in one global order, frequent shingles last, so
that two similar sets must share an element among the first few of each (its prefix). Light sets
enumerate the 2-subsets of a prefix that is one longer; two light sets meet only where they share a
whole subset. Heavy sets scan the inverted lists of their prefix elements. The size that divides
them is the one of least estimated cost. Sets that meet are verified by their full intersection.

In a list only a few members, its heads, are compared with the others at first. Lists whose members are
all connected by then are done, which settles groups of copies in linear time; the others drop their heads
and go on with more of them, until every member has been one. That gives the components
(`jaccard_classes`); the join itself, every link, is `jaccard_links`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_schema, byte_slices, discard, gram_hashes, map_text, mix, stored, word_numbers
from millrace.llm.components import components
from millrace.llm.registry import query, table

WORDS = 5
PERCENT = 80

FREQUENT = 400_000
"""At most so many of the most frequent shingles are sent to the tasks (8 bytes each) to be put last
in the order. Any order gives the same links; this one keeps lists short."""

FREQUENT_FROM = 6
BLOCK = 2_000_000
"""Shingles a task counts at once when it looks for frequent ones."""

HEADS = 4
"""Members of a list that all others are compared with in the first round."""

HEADS_GROW = 16
"""Times as many in each further round, so that the rounds are few whatever the length of a list."""

SPREAD = 1_000
"""Members of a list that are compared with as many others in one group, where every pair is asked for."""

TEXTS = 1_000
"""Rows with texts that go to Python in one Arrow batch."""

PAIR_BYTES = 4 << 20
"""Text bytes of the pairs that a task verifies at once."""

KNOWN = 1_000_000
"""Shingles of verified sets a task remembers for the next pairs, before it starts anew."""

BOUNDARIES = (1, 2, 4, 8, 12, 16, 24, 32, 48, 64)
SEEN = 200_000
"""Set ids a task remembers to post equal sets once."""


def shingle_sets(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes, A-Z lower-cased; fewer words than `size` are
    one shingle; no words, none."""
    for numbers, bounds in word_numbers(texts):
        runs = gram_hashes(numbers, size)
        for a, b in zip(bounds, bounds[1:]):
            grams = np.sort(runs[a : b - size + 1] if b - a >= size else gram_hashes(numbers[a:b], max(1, b - a)))
            yield grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams


def set_id(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that identify a set."""
    import xxhash

    digest = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def required(size, percent: int):
    """Least intersection with any set that reaches `percent`."""
    return -(-size * percent // 100)


def in_order(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set in the global order. `frequent` is sorted by hash, with the rank in its second row."""
    if not frequent.shape[1] or not len(grams):
        return grams
    at = np.minimum(np.searchsorted(frequent[0], grams), frequent.shape[1] - 1)
    often = frequent[0][at] == grams
    if not often.any():
        return grams
    ranks = frequent[1][at[often]]
    return np.concatenate([grams[~often], grams[often][np.argsort(ranks, kind="stable")]])


def signatures(
    grams: np.ndarray, boundary: int, percent: int, frequent: np.ndarray
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(signatures, positions in the order). What a set is posted under: subsets of a light set, and
    single elements of a heavy set or of a light one that a heavy set could match. The last bit
    tells subsets (0) from elements (1)."""
    n = len(grams)
    if n < 2:
        return []
    ordered = in_order(grams, frequent)
    prefix = n - required(n, percent) + 1
    out = []
    if n <= boundary:
        first = np.sort(ordered[: prefix + 1])
        i, k = np.triu_indices(len(first), 1)
        with np.errstate(over="ignore"):
            subsets = mix(first[i] * np.uint64(0x9E3779B97F4A7C15) + first[k]) & ~np.uint64(1)
        out.append((subsets, np.zeros(len(subsets), np.int32)))
    if n > boundary or 100 * n >= percent * (boundary + 1):
        out.append((ordered[:prefix] | np.uint64(1), np.arange(prefix, dtype=np.int32)))
    return out


def _describe(docs: DataFrame, row_id: str, text: str, size: int) -> DataFrame:
    """Two kinds of rows from one reading: `kind` 0 has a document with its set's id and size,
    `kind` 1 a shingle that occurs in several sets of a block, with that number."""
    id_type = docs.schema[row_id].dataType
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("doc", id_type)]
        + [T.StructField(c, T.LongType()) for c in ("n", "sid", "check")]
    )
    out = arrow_schema(schema)

    def run(batches):
        held, number, seen = [], 0, set()

        def repeated():
            if not held:
                return None
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= 2
            grams, counts = grams[many], counts[many]
            empty = pa.nulls(len(grams), out.field("doc").type)
            one = pa.array(np.ones(len(grams), np.int32))
            return pa.RecordBatch.from_arrays(
                [one, empty, pa.array(counts.astype(np.int64)), pa.array(grams.view(np.int64)), pa.nulls(len(grams), pa.int64())],
                schema=out,
            )

        for piece in byte_slices(batches, [row_id], text):
            rows = []
            for doc, grams in zip(piece[row_id], shingle_sets(piece[text], size)):
                sid, check = set_id(grams)
                rows.append((0, doc, len(grams), sid, check))
                if len(seen) >= SEEN:
                    seen.clear()
                if sid not in seen:
                    seen.add(sid)
                    held.append(grams)
                    number += len(grams)
                if number >= BLOCK:
                    yield repeated()
                    held, number = [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)], schema=out
            )
        if (last := repeated()) is not None:
            yield last

    return docs.select(row_id, text).mapInArrow(run, schema)


def _postings(docs: DataFrame, text: str, size: int, percent: int, boundary: int, frequent: np.ndarray) -> DataFrame:
    """`sig`, `sid`, `n`, `pos`: every set under each of its signatures; a task posts equal sets once."""
    schema = T.StructType(
        [T.StructField("sig", T.LongType()), T.StructField("sid", T.LongType())]
        + [T.StructField(c, T.IntegerType()) for c in ("n", "pos")]
    )

    def make():
        seen = set()

        def run(piece):
            sigs, sids, sizes, places = [], [], [], []
            for grams in shingle_sets(piece[text], size):
                sid = set_id(grams)[0]
                if len(seen) >= SEEN:
                    seen.clear()
                if sid in seen:
                    continue
                seen.add(sid)
                for part, place in signatures(grams, boundary, percent, frequent):
                    sigs.append(part)
                    places.append(place)
                    sids.append(np.full(len(part), sid, np.int64))
                    sizes.append(np.full(len(part), len(grams), np.int32))
            join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
            return {
                "sig": join(sigs, np.uint64).view(np.int64),
                "sid": join(sids, np.int64),
                "n": join(sizes, np.int32),
                "pos": join(places, np.int32),
            }

        return run

    return map_text(docs, [], text, schema, make)


def choose_boundary(histogram: list[tuple[int, int]], partners: float, percent: int) -> int:
    """Largest size of a light set: posting a subset costs 1, posting an element 1 and, for a heavy
    set, its expected partners in the list as well."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in histogram:
            prefix = n - required(n, percent) + 1
            if n <= boundary:
                total += count * (prefix + 1) * prefix / 2
            if n > boundary:
                total += count * prefix * (1 + partners)
            elif 100 * n >= percent * (boundary + 1):
                total += count * prefix
        return total

    return min(BOUNDARIES, key=lambda b: (cost(b), b))


def _close(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _verify(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (`a`, `b`) whose sets reach `percent`. Texts travel, not sets: they are smaller."""
    left = bodies.select(F.col("sid").alias("a"), F.col("body").alias("x"))
    right = bodies.select(F.col("sid").alias("b"), F.col("body").alias("y"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    out = arrow_schema(schema)

    def run(batches):
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            texts = [batch.column(i) for i in (2, 3)]
            ends = np.cumsum(sum(np.asarray(pa.compute.binary_length(c)).astype(np.int64) for c in texts))
            start = 0
            while start < len(batch):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + PAIR_BYTES, "right")))
                if held > KNOWN:
                    known, held = {}, 0
                missing = {}
                for sids, column in zip((a, b), texts):
                    for i in range(start, stop):
                        if sids[i] not in known and sids[i] not in missing:
                            missing[sids[i]] = column[i].as_py()
                for sid, grams in zip(missing, shingle_sets(list(missing.values()), size)):
                    known[sid] = grams
                    held += len(grams)
                kept = []
                for i in range(start, stop):
                    p, q = known[a[i]], known[b[i]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        kept.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[i] for i in kept], pa.int64()) for c in (a, b)], schema=out
                )
                start = stop

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def _bodies(
    docs: DataFrame, row_id: str, text: str, wanted: DataFrame, size: int, unique: bool
) -> DataFrame:
    """`sid`, `body` (a text with the set) of the wanted sets (`sid`, `doc`: a document that has it).
    Where ids are unique the join alone gives them; else texts are checked against the set."""
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("body", T.BinaryType())])
    named = docs.select(F.col(row_id).alias("_doc"), F.col(text).alias("_text"))
    met = named.join(
        wanted.select(F.col("doc").alias("_want"), "sid").hint("shuffle_hash"), F.col("_doc").eqNullSafe(F.col("_want"))
    ).select("sid", "_text")
    if unique:
        return met.select("sid", F.col("_text").cast("binary").alias("body"))

    def make():
        seen = set()

        def run(piece):
            made = []
            for sid, raw, grams in zip(piece["sid"], piece["_text"], shingle_sets(piece["_text"], size)):
                # The rows of an id are in one task. They may repeat a text, or bring another along.
                if sid not in seen and set_id(grams)[0] == sid:
                    seen.add(sid)
                    made.append((sid, raw))
            return {"sid": [m[0] for m in made], "body": [m[1] for m in made]}

        return run

    return map_text(met, ["sid"], "_text", schema, make)


def jaccard_classes(
    spark: SparkSession, docs: DataFrame, row_id: str, text: str, size: int = WORDS, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """(`row_id`, `n_shingles`, `component_id`, `root` for every row; verified links `a`, `b` of sets).

    `component_id` is the smallest `row_id` reachable by links; equal sets are linked. A NULL, empty
    or blank text has an empty set and is its own component. Repeated rows come back as often as they
    came; NULL ids are never a component id. `root` numbers the component (NULL for empty sets). An empty table gives no rows. Sets are compared by
    64-bit shingle hashes; two sets with equal 64-bit ids but unequal contents raise an error. The
    links found are enough to connect every component: two sets already connected are not compared. For
    all links see `jaccard_links`.
    """
    about, classes, lists, bodies, boundary = _gathered(spark, docs, row_id, text, size, percent)
    links, roots = _link(spark, lists, bodies, boundary, size, percent)
    discard(spark, bodies)

    named = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "doc", F.coalesce("root", "sid").alias("root")
    )
    first = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    answer = about.join(named.select("sid", "root").join(first, "root"), "sid", "left").select(
        F.col("doc").alias(row_id),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
        "root",
    )
    return answer, links


def jaccard_links(
    spark: SparkSession, docs: DataFrame, row_id: str, text: str, size: int = WORDS, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """(`row_id`, `n_shingles`, `set_id`, `n_links` for every row; all links `a` < `b` of different sets).

    `n_links` is the number of other rows whose set reaches `percent` with the row's. Rows with equal
    sets have one `set_id`, which is what `a` and `b` hold, and are linked. An empty set has no links.
    Every pair that could reach `percent` is verified, so a group of n near copies costs its square. See
    `jaccard_classes` for odd input.
    """
    about, _, lists, bodies, boundary = _gathered(spark, docs, row_id, text, size, percent)
    groups = lists.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("groups"))
    held = lists.join(groups, "sig").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("groups")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    left = held.select("sig", "sid", "n", "pos", F.col("own").alias("l"), each.alias("r"))
    right = held.select(
        "sig", F.col("sid").alias("o"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("own").alias("r"), each.alias("l")
    )
    met = left.join(right, ["sig", "l", "r"]).where("sid < o")
    pairs = stored(spark, _candidates(met, boundary, percent), "all-candidates")
    links = stored(spark, _verify(pairs, bodies, size, percent), "all-links", TEXTS)
    discard(spark, pairs)
    discard(spark, bodies)

    copies = about.where("n > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.col("a").alias("sid"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("sid"), F.col("a").alias("other"))
    )
    near = ends.join(copies.withColumnRenamed("sid", "other"), "other").groupBy("sid").agg(F.sum("copies").alias("near"))
    answer = about.join(copies.join(near, "sid", "left"), "sid", "left").select(
        F.col("doc").alias(row_id),
        F.col("n").alias("n_shingles"),
        F.col("sid").alias("set_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
    )
    return answer, links


def _gathered(spark: SparkSession, docs: DataFrame, row_id: str, text: str, size: int, percent: int):
    """(documents with their sets, different sets, lists of the sets that meet, their texts, the
    largest size of a light set)."""
    told = stored(spark, _describe(docs, row_id, text, size), "shingle-sets", TEXTS)
    about = told.where("kind = 0")
    classes = stored(
        spark,
        about.where("n > 0").groupBy("sid").agg(
            F.min("doc").alias("doc"), F.first("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")
        ),
        "set-classes",
    )
    if not classes.where("lo != hi").isEmpty():
        raise ValueError("two different sets have the same 64-bit id")
    often = (
        told.where("kind = 1").groupBy(F.col("sid").alias("gram")).agg(F.sum("n").alias("c"))
        .where(F.col("c") >= FREQUENT_FROM).orderBy(F.desc("c"), "gram").limit(FREQUENT).toPandas()
    )
    grams, counts = often["gram"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.float64)
    by_hash = np.argsort(grams)
    ranks = np.empty(len(grams), np.uint64)
    ranks[np.lexsort((grams, counts))] = np.arange(len(grams), dtype=np.uint64)
    frequent = np.stack([grams[by_hash], ranks[by_hash]])
    histogram = [(r[0], r[1]) for r in classes.where("n > 1").groupBy("n").count().collect()]
    total = sum(n * c for n, c in histogram)
    boundary = choose_boundary(histogram, float(counts.sum()) / max(1, total), percent)

    posted = stored(spark, _postings(docs, text, size, percent, boundary, frequent), "postings", TEXTS)
    shared = posted.groupBy("sig").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("sig")
    lists = stored(spark, posted.join(shared, "sig").distinct(), "lists")
    discard(spark, posted)
    met = stored(spark, lists.select("sid").distinct().join(classes.select("sid", "doc"), "sid"), "met-sets")
    unique = about.groupBy("doc").count().where("count > 1").isEmpty()
    bodies = stored(spark, _bodies(docs, row_id, text, met, size, unique), "bodies", TEXTS)
    return about, classes, lists, bodies, boundary


def _candidates(met: DataFrame, boundary: int, percent: int) -> DataFrame:
    """The pairs `a` < `b` that may reach `percent` of members (`sid`, `n`, `pos`) and (`o`, `m`, `q`)
    that meet in a list."""
    light_pair = (F.col("n") <= boundary) & (F.col("m") <= boundary) & (F.col("sig").bitwiseAND(1) == 1)
    return (
        met.where(_close(F.col("n"), F.col("m"), percent) & ~light_pair)
        # Where an element is the first that two sets share, no more than what follows it in
        # either can be shared; a close pair passes in the list of its first one.
        .where((100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("q")) >= percent * (F.col("n") + F.col("m")))
        .select(F.least("sid", "o").alias("a"), F.greatest("sid", "o").alias("b"))
        .distinct()
    )


def _link(
    spark: SparkSession, lists: DataFrame, bodies: DataFrame, boundary: int, size: int, percent: int
):
    """(links `a`, `b`; `node`, `root` of every linked set), from lists of `sig`, `sid`, `n`, `pos`."""
    # Nothing yet. A frame made from a list would start Python workers of another kind on every executor.
    links = done = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    labels, heads = None, HEADS
    while True:
        # Only lists with members that are not known to be connected go on.
        named = lists.withColumn("root", F.col("sid"))
        if labels is not None:
            named = lists.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        mixed = named.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
        lists = stored(spark, named.join(mixed.where("lo < hi").select("sig", "size"), "sig"), "open-lists")
        longest = lists.agg(F.max("size")).first()[0]
        if longest is None:
            break
        placed = _placed(lists, heads)
        new = _candidates(_head_pairs(placed), boundary, percent).join(done, ["a", "b"], "left_anti")
        new = stored(spark, new, "candidates")
        done = done.unionByName(new)
        links = links.unionByName(stored(spark, _verify(new, bodies, size, percent), "verified", TEXTS))
        if longest <= heads:
            break
        labels = _labels(spark, links)
        lists = placed.where((F.col("size") > heads) & ~F.col("head")).select("sig", "sid", "n", "pos")
        heads *= HEADS_GROW
    return links, stored(spark, components(spark, links), "components")


def _placed(lists: DataFrame, heads: int) -> DataFrame:
    """Whether a member is one of about `heads` heads of its list, and the list before this one in which the
    set still is. Heads are drawn by one hash of the set, so a head of a list is one of every shorter list
    it is in; a list of up to `heads` members has heads only."""
    turn = F.pmod(F.xxhash64(F.lit("head"), "sid"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    kind = F.col("sig").bitwiseAND(1)
    before = Window.partitionBy("sid", kind).orderBy("pos")
    return lists.withColumns(
        {
            "head": (F.col("size") <= heads) | (turn * F.col("size") < heads),
            # Light sets have many subsets at one place; those are not in order.
            "prev": F.when(kind == 1, F.lag("sig").over(before)),
            "prev_size": F.lag("size").over(before),
        }
    )


def _head_pairs(placed: DataFrame) -> DataFrame:
    """Members with the heads of their lists, if not known to be connected. Sets that have met in the list
    before, where the head is one too, do not meet again."""
    heads = placed.where("head").select(
        "sig",
        *[F.col(c).alias(a) for c, a in zip(("sid", "n", "root", "pos", "prev"), ("o", "m", "p", "q", "o_prev"))],
    )
    met_before = F.coalesce((F.col("prev") == F.col("o_prev")) & (F.col("prev_size") <= F.col("size")), F.lit(False))
    once = (F.col("sid") < F.col("o")) | (~F.col("head") & (F.col("sid") != F.col("o")))
    return placed.join(heads, "sig").where(once & (F.col("root") != F.col("p")) & ~met_before)


def _labels(spark: SparkSession, links: DataFrame) -> DataFrame:
    """`node`, `root`: smallest sets of neighbourhoods, passed on in two rounds, the second between those of the
    first. Equal labels are connected; the other way round it need not hold, and `components` comes last."""
    first = stored(spark, _smallest_near(links), "labels")
    top = lambda end: first.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = links.join(top("a"), "a").join(top("b"), "b").where("a_root != b_root")
    second = _smallest_near(between.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    second = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    merged = first.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(spark, merged, "labels")


def _smallest_near(links: DataFrame) -> DataFrame:
    """`node`, `root`: the smallest set within two links of a set, or still nearer to those."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    near = both.join(low.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("near"))
    return low.join(near, "a").select(F.col("a").alias("node"), F.least("low", "near").alias("root"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * common >= 80 * (s.n + t.n - common)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
"""


@query("op7_jaccard_components", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jaccard_classes(spark, docs, "doc_id", "text")[0].drop("root")
