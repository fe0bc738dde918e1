"""Schema contracts, typed columns, keys and references."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from millrace.functions.scalars import fingerprint
from millrace.operators import quality
from millrace.operators.schema import resolve
from millrace.plans.catalog.registry import query, table

READER = StructType(
    [
        StructField("c_nationkey", LongType()),
        StructField("region", StringType()),
        StructField("c_name", StringType()),
        StructField("c_custkey", DoubleType()),
    ]
)


@query(
    "schema_resolve",
    """SELECT c_nationkey::BIGINT AS c_nationkey, 'unknown' AS region, c_name,
              c_custkey::DOUBLE AS c_custkey FROM customer""",
)
def schema_resolve(spark, folder):
    return resolve(table(spark, folder, "customer"), READER, {"region": "unknown"})


@query(
    "typed_validate",
    """SELECT c_custkey, 'c_acctbal' AS "column", CAST(c_acctbal AS VARCHAR) AS value
         FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment
         FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
       UNION ALL SELECT c_custkey, 'c_name', c_name FROM customer""",
)
def typed_validate(spark, folder):
    customer = table(spark, folder, "customer")
    text = customer.select(*[F.col(c).cast("string") for c in customer.columns])
    failures = quality.typed_failures(
        text, "c_custkey",
        [
            quality.Check("c_acctbal", "memorysize"),
            quality.Check("c_mktsegment", "string", "BUILDING|MACHINERY"),
            quality.Check("c_name", "double"),
            quality.Check("c_nationkey", "int32"),
        ],
    )
    return failures.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query(
    "duplicate_keys",
    r"""WITH trimmed AS (SELECT *, regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM documents)
       SELECT doc_id, sha256(t) IS NOT NULL AS has_text FROM trimmed WHERE t IN
       (SELECT t FROM trimmed GROUP BY t HAVING count(*) > 1)""",
)
def duplicate_keys(spark, folder):
    """Documents whose text occurs more than once; digests stand in for the long texts."""
    documents = table(spark, folder, "documents").select(
        "doc_id", fingerprint(F.trim("text")).alias("digest")
    )
    repeated = quality.duplicate_keys(documents, "digest")
    return repeated.select("doc_id", F.col("digest").isNotNull().alias("has_text"))


@query(
    "orphans_left",
    "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def orphans_left(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return quality.orphans(documents, "doc_id", table(spark, folder, "labels"), "doc_id")


@query(
    "orphans_right",
    "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)
def orphans_right(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return quality.orphans(orders, "o_orderkey", table(spark, folder, "lineitem"), "l_orderkey")


@query(
    "bound_to_many",
    """SELECT DISTINCT l_partkey, l_suppkey, parents FROM lineitem JOIN
         (SELECT l_partkey, count(DISTINCT l_suppkey) AS parents FROM lineitem
          GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1) m USING (l_partkey)""",
)
def bound_to_many(spark, folder):
    return quality.bound_to_many(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey")
