"""Claims as queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import capture
from verdigris.plans.base import query, table


@query(
    "claims_as_queries",
    """SELECT claim_id, CASE WHEN expected AND n_violations > 0 THEN 'xfail' WHEN expected THEN 'xpass' WHEN n_violations > 0 THEN 'failed' ELSE 'passed' END AS outcome, strength, n_violations FROM (
         SELECT 'orders have customers' AS claim_id, 'strong' AS strength, false AS expected, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n_violations
         UNION ALL SELECT 'orders have lines', 'moderate', true, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
         UNION ALL SELECT 'lines are small', 'weak', false, (SELECT count(*) FROM lineitem WHERE l_quantity > 10))""",
)
def claims_as_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    strangers = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    empty = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    told = capture.claim("orders have customers", strangers, "strong")
    return told.unionByName(capture.claim("orders have lines", empty, "moderate", expected_failure=True)).unionByName(capture.claim("lines are small", lines.where("l_quantity > 10"), "weak"))
