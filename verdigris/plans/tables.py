"""Reshaping, multisets and comparisons on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as fn
from verdigris.operators import multiset as ms
from verdigris.operators import reshape
from verdigris.plans.base import query, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDER = ", ".join(ALL_COLUMNS[1:])


def _scaled(column: str) -> F.Column:
    return F.floor(F.col(column).cast("double") * 10_000 + 0.5).cast("long")


@query(
    "melt_long",
    " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS name, floor({c} * 10000 + 0.5)::BIGINT AS value FROM lineitem" for c in MEASURES),
)
def melt_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ms.melted(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], MEASURES)
    return long.withColumn("value", _scaled("value"))


@query(
    "flatten_wide",
    """SELECT event_type, user_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT AS sub_index,
              event_type || '_' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS name, event_id FROM events""",
)
def flatten_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.running_names(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "user_id", "sub_index", "name", "event_id")


@query(
    "typed_columns",
    """WITH l AS (SELECT 'c_name' AS name, regexp_extract(c_name, '#([0-9]+)', 1) AS v FROM customer UNION ALL SELECT 'c_custkey', c_custkey::VARCHAR FROM customer
                  UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_masked', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_custkey::VARCHAR END FROM customer),
       s AS (SELECT name, count(*) AS n, count(*) FILTER (v = '') AS n_blank, count(*) FILTER (regexp_matches(v, '^-?[0-9]+$')) AS n_whole, count(*) FILTER (regexp_matches(v, '^-?0[0-9]+$')) AS n_leading_zero FROM l GROUP BY name)
       SELECT *, CASE WHEN n_whole + n_blank <> n OR n_whole = 0 THEN 'text' WHEN n_blank > 0 OR n_leading_zero > 0 THEN 'identifier' ELSE 'integer' END AS kind FROM s""",
)
def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.regexp_extract("c_name", "#([0-9]+)", 1).alias("c_name"), F.col("c_custkey").cast("string"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_custkey").cast("string")).alias("c_masked"))
    return ms.typed_columns(rows, rows.columns)


@query(
    "measurement_multiset",
    "WITH m AS (" + " UNION ALL ".join(f"SELECT floor({c} * 10000 + 0.5)::BIGINT AS key FROM lineitem WHERE {c} <> floor({c})" for c in MEASURES) + ") SELECT key, count(*) AS n FROM m GROUP BY key",
)
def measurement_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ms.melted(table(spark, sf_dir, "lineitem"), [], MEASURES)
    number = F.col("value").cast("double")
    return ms.counts(long.where(number != F.floor(number)), _scaled("value"))


@query(
    "multiset_lost",
    """WITH k AS (SELECT l_returnflag = 'R' AS legacy, floor(l_extendedprice * 10000 + 0.5)::BIGINT AS key FROM lineitem),
       c AS (SELECT key, count(*) FILTER (legacy) AS n, count(*) FILTER (NOT legacy) AS found FROM k GROUP BY key)
       SELECT key, n, found, n - found AS lost FROM c WHERE n > found""",
)
def multiset_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    legacy, made = (ms.counts(lines.where(w), _scaled("l_extendedprice")) for w in ("l_returnflag = 'R'", "l_returnflag <> 'R'"))
    return ms.difference(legacy, made)


@query(
    "cell_coverage",
    """WITH c AS (SELECT o_orderkey, o_orderpriority AS f, unnest([floor(o_totalprice * 1000000 + 0.5)::BIGINT::VARCHAR, lower(o_orderstatus)]) AS k, unnest(['n:', 't:']) AS p FROM orders),
       legacy AS (SELECT f, p || k AS key, count(*) AS n FROM c WHERE o_orderkey % 3 = 0 GROUP BY ALL), u AS (SELECT p || k AS key, count(*) AS found FROM c WHERE o_orderkey % 3 = 1 GROUP BY ALL),
       j AS (SELECT f, n, greatest(0, n - coalesce(found, 0)) AS lost FROM legacy LEFT JOIN u USING (key))
       SELECT f AS file, sum(n)::BIGINT AS n_cells, sum(lost)::BIGINT AS n_lost, count(*) FILTER (lost > 0) AS n_keys_lost FROM j GROUP BY f""",
)
def cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cells = orders.select("o_orderkey", F.col("o_orderpriority").alias("file"), F.explode(F.array(F.col("o_totalprice").cast("string"), "o_orderstatus")).alias("value"))
    return ms.coverage(cells.where("o_orderkey % 3 = 0"), cells.where("o_orderkey % 3 = 1"), "file")


@query(
    "tolerance_compare",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS position FROM lineitem),
        p AS (SELECT unnest(['l_quantity', 'l_extendedprice']) AS name, unnest([l_quantity, l_extendedprice]) AS a,
                     unnest([CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END, CASE WHEN l_partkey % 5 = 0 THEN l_extendedprice * 1.0005 ELSE l_extendedprice END]) AS b FROM r)
        SELECT name, count(*) AS n, count(*) FILTER (a = b) AS n_exact, count(*) FILTER (a <> b AND abs(a - b) <= greatest(0.001 * greatest(abs(a), abs(b)), 0.000001)) AS n_close,
               count(*) FILTER (abs(a - b) > greatest(0.001 * greatest(abs(a), abs(b)), 0.000001)) AS n_different FROM p GROUP BY name""",
)
def tolerance_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ms.positional(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ALL_COLUMNS[1:])
    part = F.col("l_partkey")
    right = left.withColumn("l_quantity", F.when(part % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).withColumn("l_extendedprice", F.when(part % 5 == 0, F.col("l_extendedprice") * 1.0005).otherwise(F.col("l_extendedprice")))
    return ms.tolerance_compare(left, right, ["l_orderkey", "position"], ["l_quantity", "l_extendedprice"])


@query(
    "cell_keys",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'n:' || floor(s_acctbal * 1000000 + 0.5)::BIGINT WHEN 2 THEN 't:' || lower(s_name) ELSE 'n:1234000' END AS key FROM supplier""",
)
def cell_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.get(F.array(F.lit(" N/A"), F.col("s_acctbal").cast("string"), F.col("s_name"), F.lit("1,234")), F.pmod("s_suppkey", F.lit(4)).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fn.cell_key(cell).alias("key"))
