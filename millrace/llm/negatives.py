"""Hard negatives by bounds along a spanning tree of the anchors.

Rows meet anchors in blocks. The anchors of a block are joined by a minimum spanning tree of their
distances. All rows are scored at its root; from there on a row's score at an anchor lies within
the score (or the bounds) at the parent, plus or minus the edge's length times the row's norm. Only rows
whose bounds overlap a window of the anchor are scored there, exactly. A window asks for the best few
scores between two limits; its lower limit rises to the last of the best found so far, or to what the
bounds alone promise, so bounds cut more off as rows go by.

The search runs twice: within each label for the positives (a window without limits), then over
all rows of other labels for the negatives, each positive being a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import stored
from millrace.llm.registry import query, table
from millrace.llm.vectors import integer_vector, largest, matrix, usable

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
"""A negative's score lies between so many hundredths of the positive's."""

ANCHORS = 512
CANDIDATES = 8192
"""Mean rows of a block of anchors and of one of candidates, which meet in one task."""

CHUNK = 2048
"""Candidates whose bounds are held at once for all anchors of a block."""

NO_ID = np.iinfo(np.int64).max
"""Stands for a NULL id in the order of equal scores: NULLs last."""


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors in the order they join the tree, parent of each anchor, length of the edge to it), by
    distance; the first anchor is the root and its own parent."""
    m = len(vectors)
    x = vectors.astype(np.float64)
    squares = (x * x).sum(axis=1)
    order, parent, edge = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
    gap = np.full(m, np.inf)
    done = np.zeros(m, dtype=bool)
    now = 0
    for k in range(m):
        order[k], done[now] = now, True
        own = squares + squares[now] - 2 * (x @ x[now])
        closer = ~done & (own < gap)
        gap[closer], parent[closer] = own[closer], now
        if k + 1 < m:
            now = int(np.where(done, np.inf, gap).argmin())
            # Taken again from the difference: the expanded square loses digits for near anchors.
            edge[now] = np.sqrt(((x[now] - x[parent[now]]) ** 2).sum())
    return order, parent, edge


class Best:
    """The best `size` of (score, id, row) for each window: higher scores, then smaller ids, then rows."""

    def __init__(self, size: int, windows: int):
        self.size = size
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(windows)]

    def add(self, window: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > self.size:
            enough = scores >= np.partition(scores, len(scores) - self.size)[-self.size]
            scores, ids, rows = scores[enough], ids[enough], rows[enough]
        held = [np.concatenate(pair) for pair in zip(self.held[window], (scores, ids, rows))]
        first = np.lexsort((held[2], held[1], -held[0]))[: self.size]
        self.held[window] = tuple(h[first] for h in held)

    def least(self, window: int, limits: tuple[float, float], low: np.ndarray, high: np.ndarray) -> float:
        """A score below this cannot enter the window. `low` and `high` bound the scores still to come: as
        many of them as there are places, all sure to lie in the window, count before they are known."""
        scores = self.held[window][0]
        if len(scores) == self.size:
            return max(limits[0], float(scores[-1]))
        sure = low[(low >= limits[0]) & (high <= limits[1])]
        if len(sure) < self.size:
            return limits[0]
        return max(limits[0], float(np.partition(sure, len(sure) - self.size)[-self.size]))


def united(limits: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Windows that overlap, as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(w for w in limits if w[0] <= w[1]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class Counted(dict):
    """What a search did, for tests and reports: `pairs` of anchor and candidate, and those `scored`."""


def tree_search(
    anchors: np.ndarray,
    windows: list[list[tuple[float, float]]],
    candidates: np.ndarray,
    ids: np.ndarray,
    rows: np.ndarray,
    barred,
    size: int,
    count: Counted | None = None,
) -> list[Best]:
    """For each anchor the best `size` candidates of each of its windows (least and greatest score).

    `barred(a)` tells which candidates anchor `a` may not have; it takes a slice of them as second argument.
    """
    best = [Best(size, len(w)) for w in windows]
    if not len(anchors) or not len(candidates):
        return best
    order, parent, edge = spanning_tree(anchors)
    # Inner products, partial sums included, are whole numbers a double holds, or else Python's.
    most = largest(anchors) * largest(candidates) * max(1, anchors.shape[1])
    kind = np.float64 if most < 1 << 53 else object
    a, x = anchors.astype(kind), candidates.astype(kind)
    norms = np.sqrt((candidates.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    slack = 1 + 1e-12 * float(most)
    for start in range(0, len(x), CHUNK):
        part = slice(start, start + CHUNK)
        own, norm = x[part], norms[part]
        low, high = np.empty((len(a), len(own))), np.empty((len(a), len(own)))
        for k, at in enumerate(order):
            if k:
                reach = edge[at] * norm + slack
                low[at], high[at] = low[parent[at]] - reach, high[parent[at]] + reach
                open_ = ~barred(at, part)
                limits = [(best[at].least(w, l, low[at, open_], high[at, open_]), l[1]) for w, l in enumerate(windows[at])]
                overlap = np.zeros(len(own), dtype=bool)
                for lo, hi in united(limits):
                    overlap |= (high[at] >= lo) & (low[at] <= hi)
                sel = np.flatnonzero(overlap & open_)
            else:
                sel = np.arange(len(own))
            if count is not None:
                count["pairs"] = count.get("pairs", 0) + len(own)
                count["scored"] = count.get("scored", 0) + len(sel)
            if not len(sel):
                continue
            if 2 * len(sel) > len(own):
                exact = own @ a[at]
                low[at] = high[at] = exact.astype(np.float64)
                exact = exact[sel]
            else:
                exact = own[sel] @ a[at]
                low[at, sel] = high[at, sel] = exact.astype(np.float64)
            if not k:
                open_ = ~barred(at, part)
                sel, exact = sel[open_], exact[open_]
                limits = windows[at]
            for w, (lo, hi) in enumerate(limits):
                inside = np.flatnonzero((exact >= lo) & (exact <= hi))
                if len(inside):
                    chosen = sel[inside] + start
                    best[at].add(w, exact[inside].astype(np.int64), ids[chosen], rows[chosen])
    return best


def _dealt(rows: DataFrame, groups: list[str], anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and anchors with block numbers `i` (of anchors) and `j` (of candidates); every pair of
    blocks of a group meets once. Blocks are dealt by a hash of the row, so a large group is many."""
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows")).join(
        anchors.groupBy(*groups).agg(F.count(F.lit(1)).alias("_anchors")), groups
    )
    blocks = counts.select(
        *groups,
        F.ceil(F.col("_anchors") / ANCHORS).cast("int").alias("_i"),
        F.ceil(F.col("_rows") / CANDIDATES).cast("int").alias("_j"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    left = anchors.join(blocks, groups).select("*", own("_i").alias("i"), every("_j").alias("j")).drop("_i", "_j")
    right = rows.join(blocks, groups).select("*", own("_j").alias("j"), every("_i").alias("i")).drop("_i", "_j")
    # Both sides come from one table; new columns keep them apart.
    return right, left.toDF(*left.columns)


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides as numbers."""
    both = pa.chunked_array([*left.chunks, *right.chunks], left.type).combine_chunks().dictionary_encode()
    codes = np.asarray(both.indices)
    return codes[: len(left)], codes[len(left) :]


def _search(rows: DataFrame, anchors: DataFrame, groups: list[str], size: int, same_label: bool) -> DataFrame:
    """`anchor`, `window` (from 0), `row`, `id`, `score`: per pair of blocks the best rows of each window of
    each anchor. `anchors` have `windows`, an array of (`lo`, `hi`)."""

    def run(block: pa.Table, centers: pa.Table) -> pa.Table:
        x, a = matrix(block["x"]), matrix(centers["x"])
        row, mine = np.asarray(block["row"]), np.asarray(centers["row"])
        ids = np.asarray(block["id"].fill_null(NO_ID))
        theirs, own = _codes(block["label"], centers["label"])
        windows = [[(w["lo"], w["hi"]) for w in held] for held in centers["windows"].to_pylist()]
        windows = [[(-np.inf if lo is None else lo, np.inf if hi is None else hi) for lo, hi in held] for held in windows]
        if same_label:
            barred = lambda k, part: row[part] == mine[k]
        else:
            barred = lambda k, part: theirs[part] == own[k]
        found = tree_search(a, windows, x, ids, row, barred, size)
        parts = [(mine[k], w, *held) for k, b in enumerate(found) for w, held in enumerate(b.held) if len(held[0])]
        sizes = [len(p[2]) for p in parts]
        stack = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64)
        id_ = stack(3)
        return pa.table(
            [
                pa.array(np.repeat(np.array([p[0] for p in parts], np.int64), sizes)),
                pa.array(np.repeat(np.array([p[1] for p in parts], np.int32), sizes)),
                pa.array(stack(4)),
                pa.array(id_, mask=id_ == NO_ID),
                pa.array(stack(2)),
            ],
            names=["anchor", "window", "row", "id", "score"],
        )

    right, left = _dealt(rows, groups, anchors)
    keys = [*groups, "i", "j"]
    met = right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(
        run, "anchor bigint, window int, row bigint, id bigint, score bigint"
    )
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)


def hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    row_id: str,
    label: str,
    vector: str,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    Scores are inner products of the integer array column `vector`. An anchor's positives are the `positives`
    other rows of its label with the highest scores, equal scores by smaller id; a positive's negatives are
    the first `negatives` rows of other labels whose score lies between `low` and `high` hundredths of the
    positive's, limits included. A positive without such rows gives none.

    Rows whose label or vector is NULL take no part. A row with a NULL id is never an anchor where
    `is_anchor` is NULL for it, and comes after all others of its score. Rows that repeat an id, or a whole
    row, count as often as they come, also as anchors. Vectors meet only those of their length; empty ones
    score 0 with each other. Scores must fit in a long. An empty table gives no rows.
    """
    held = stored(
        spark,
        rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
            F.col(row_id).cast("bigint").alias("id"),
            F.col(label).alias("label"),
            F.col(vector).alias("x"),
            F.size(vector).alias("length"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    candidates = held.drop("is_anchor")
    anchors = held.where("is_anchor").drop("is_anchor")
    anywhere = F.array(F.struct(F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi")))
    near = _search(candidates, anchors.withColumn("windows", anywhere), ["length", "label"], positives, True)
    near = stored(spark, near, "positives").withColumnRenamed("rank", "place")
    # Limits in whole scores: the least not below `low` hundredths, the greatest not above `high`.
    windows = near.select(
        "anchor",
        "place",
        (-F.expr(f"floor(-{low} * cast(score as decimal(38,0)) / 100)")).cast("bigint").alias("lo"),
        F.expr(f"floor({high} * cast(score as decimal(38,0)) / 100)").cast("bigint").alias("hi"),
    )
    listed = windows.groupBy(F.col("anchor").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))), lambda w: F.struct(w["lo"], w["hi"])).alias("windows")
    )
    # `place` counts from 1 without gaps, so the windows of an anchor are its positives in order.
    found = _search(candidates, anchors.join(listed, "row"), ["length"], negatives, False)
    positive = near.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.withColumn("place", F.col("window") + 1)
        .join(positive, ["anchor", "place"])
        .join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other))::INTEGER AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@query("op12_tree_bound_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(usable(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    held = rows.select("vec_id", moved.alias("label"), integer_vector(F.col("embedding")).alias("x"))
    return hard_negatives(spark, held, "vec_id", "label", "x", F.col("vec_id") % 50 == 0)
