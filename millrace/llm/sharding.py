"""Shards of bounded size by extendible hashing.

Rows are hashed to 60 bits. The directory starts with one bucket; only a bucket above the byte
limit splits on its next bit. Sizes are summed by Spark, `STEP` bits in a pass, and a pass after
the first reads only the rows of buckets that are still too large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.registry import query, table

SHARD_BYTES = 1 << 20
"""Limit of the registered query: small, as the tables are; 256 MB is usual for a corpus."""

KEY_BITS = 32
BITS = 60
STEP = 6


def _bits(hex_digest: Column, digits: int) -> Column:
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("bigint")


def hash_bits(key: Column, row: Column) -> Column:
    """60 bits: 32 of the key, then 28 of the whole row. Rows of one key stay together while
    they fit; a key that alone is too large goes on splitting by its rows."""
    return F.shiftleft(_bits(F.md5(key), KEY_BITS // 4), BITS - KEY_BITS) + _bits(
        F.md5(row), (BITS - KEY_BITS) // 4
    )


def _text(column: Column) -> Column:
    """The column as bytes; NULL differs from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("")).cast("binary")


@dataclass(frozen=True)
class Shards:
    """`rows`: the id columns with `shard` (its bits as text), `n_bytes`. `directory`: one row
    per shard with `depth`, `prefix`, `shard_bytes`, `shard_rows`, `fits`."""

    rows: DataFrame
    directory: DataFrame


def shards(
    spark: SparkSession, df: DataFrame, ids: list[str], key: str, text: str, limit: int
) -> Shards:
    """Divide `df` into shards of at most `limit` bytes of `text` by the bits of hash(`key`).

    - NULL ids and keys are values like any other; a NULL or empty text has 0 bytes.
    - Equal rows (same key and text) cannot be told apart by any bit. A shard that holds nothing
      else, or a single row above the limit, may exceed it and is marked `fits = false`.
    - An empty table has no shard. Other columns are not read.
    - The directory has about 2 * total / limit rows; it is joined, never collected or
      broadcast by hand.
    """
    sized = stored(
        spark,
        df.select(
            *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)],
            hash_bits(_text(F.col(key)), F.concat(_text(F.col(key)), _text(F.col(text)))).alias("_h"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("_bytes"),
        ),
        "shard-sizes",
    )
    total, count = sized.agg(F.sum("_bytes"), F.count(F.lit(1))).first()
    found: list[DataFrame] = []
    base, todo = 0, sized.withColumn("_p", F.lit(0).cast("bigint"))
    first = min(BITS, max(STEP, int((total or 0) // limit).bit_length() + 2))
    while count:
        deep = min(BITS, base + (STEP if base else first))
        leaves = stored(spark, _leaves(todo, base, deep, limit), "shard-directory")
        found.append(leaves.where("_leaf").drop("_leaf"))
        large = leaves.where("not _leaf").select(F.col("prefix").alias("_p"))
        base = deep
        if base >= BITS or large.isEmpty():
            break
        todo = sized.withColumn("_p", F.shiftright("_h", BITS - base)).join(large, "_p", "left_semi")
    schema = "depth int, prefix bigint, shard_bytes bigint, shard_rows bigint"
    directory = spark.createDataFrame([], schema)
    for part in found:
        directory = directory.unionByName(part)
    directory = directory.withColumn(
        "shard", F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    ).withColumn("fits", F.col("shard_bytes") <= limit)
    return Shards(_assign(sized, directory, ids), directory)


def _leaves(rows: DataFrame, base: int, deep: int, limit: int) -> DataFrame:
    """Sizes of all prefixes from `base` to `deep` bits; a shard is the shortest prefix that
    fits. Prefixes that are too large at `deep` bits come back with `_leaf` false."""
    fine = rows.groupBy(F.shiftright("_h", BITS - deep).alias("_q")).agg(
        F.sum("_bytes").alias("_b"), F.count(F.lit(1)).alias("_n")
    )
    levels = fine.withColumn(
        "_at",
        F.expr(
            f"explode(transform(sequence({base}, {deep}), d -> "
            f"named_struct('depth', d, 'prefix', shiftright(_q, {deep} - d))))"
        ),
    ).select("_at.*", "_b", "_n")
    sums = levels.groupBy("depth", "prefix").agg(
        F.sum("_b").alias("shard_bytes"), F.sum("_n").alias("shard_rows")
    )
    too_large = sums.where(F.col("shard_bytes") > limit).select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up")
    )
    inner = sums.withColumn("_up", F.shiftright("prefix", 1))
    below = inner.where(F.col("depth") > base).join(too_large, ["depth", "_up"], "left_semi")
    top = inner.where(F.col("depth") == base)
    candidates = top.unionByName(below)
    last = deep == BITS
    return (
        candidates.where((F.col("shard_bytes") <= limit) | (F.col("depth") == deep))
        .withColumn("_leaf", (F.col("shard_bytes") <= limit) | F.lit(last))
        .select("depth", "prefix", "shard_bytes", "shard_rows", "_leaf")
    )


def _assign(sized: DataFrame, directory: DataFrame, ids: list[str]) -> DataFrame:
    """Each row with its shard. The few depths in use are read off the directory; a row looks
    itself up under its prefix of each, and finds exactly one."""
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())
    lists = ", ".join(f"named_struct('d', {d}, 'p', shiftright(_h, {BITS - d}))" for d in depths)
    looked = sized.withColumn("_at", F.expr(f"explode(array({lists}))")) if depths else None
    if looked is None:
        looked = sized.withColumn("_at", F.expr("named_struct('d', 0, 'p', bigint(0))"))
    named = [F.col(f"_id{i}").alias(c) for i, c in enumerate(ids)]
    return looked.join(
        directory,
        (F.col("_at.d") == F.col("depth")) & (F.col("_at.p") == F.col("prefix")),
    ).select(
        *named, "shard", "depth", F.col("_bytes").alias("n_bytes"), "shard_bytes", "shard_rows", "fits"
    )


def write_shards(
    spark: SparkSession, df: DataFrame, key: str, text: str, limit: int, path: str
) -> DataFrame:
    """Write `df` with one folder `shard=<bits>` per shard below `path`; return the directory.

    The join back is on (key, text), so repeated rows all arrive and none is added. A column
    `shard` of `df` is replaced.
    """
    made = shards(spark, df, [key, text], key, text, limit)
    place = made.rows.select(
        F.col(key).alias("_k"), F.col(text).alias("_t"), F.concat(F.lit("b"), "shard").alias("_shard")
    ).distinct()
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col(text).eqNullSafe(F.col("_t"))
    joined = df.drop("shard").join(place, same).drop("_k", "_t").withColumnRenamed("_shard", "shard")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)
    return made.directory


OP1_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    (('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, '')), 1, 8))::UBIGINT::BIGINT << 28)
    + ('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, '') || coalesce('=' || text, '')), 1, 7))::UBIGINT::BIGINT AS h
  FROM documents
), split AS (
  SELECT doc_id, n_bytes, h, 0 AS depth, 0::BIGINT AS prefix,
    sum(n_bytes) OVER ()::BIGINT AS shard_bytes, count(*) OVER () AS shard_rows
  FROM sized
  UNION ALL
  SELECT doc_id, n_bytes, h, depth + 1, h >> ({BITS} - depth - 1),
    sum(n_bytes) OVER (PARTITION BY h >> ({BITS} - depth - 1))::BIGINT,
    count(*) OVER (PARTITION BY h >> ({BITS} - depth - 1))
  FROM split WHERE shard_bytes > {SHARD_BYTES} AND depth < {BITS}
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
  depth, n_bytes, shard_bytes, shard_rows, shard_bytes <= {SHARD_BYTES} AS fits
FROM split WHERE shard_bytes <= {SHARD_BYTES} OR depth = {BITS}
"""


@query("op1_extendible_shards", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return shards(spark, docs, ["doc_id"], "doc_id", "text", SHARD_BYTES).rows
