"""What Spark sends to Python at once while an intermediate is stored."""

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import common, jaccard

DEFAULT = "10000"


def test_stored_bounds_the_rows_of_a_batch(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(batch)], pa.int64())})

    before = spark.conf.get(common.BATCH_ROWS, DEFAULT)
    sizes = spark.range(0, 50, 1, 1).mapInArrow(run, "rows bigint")
    few = common.stored(spark, sizes, "few", 7).agg(F.max("rows"), F.sum("rows")).first()
    assert tuple(few) == (7, 50)
    assert spark.conf.get(common.BATCH_ROWS, DEFAULT) == before
    assert common.stored(spark, sizes, "all").agg(F.max("rows")).first()[0] == 50


def test_no_links_start_no_python(spark):
    lists = spark.range(0).selectExpr("id AS sig", "id AS sid", "cast(id AS int) AS n", "cast(id AS int) AS pos")
    links, roots = jaccard._link(spark, lists, None, 1, 5, 80)
    assert "ExistingRDD" not in links._jdf.queryExecution().toString()
    assert links.count() == 0
    assert roots.count() == 0
