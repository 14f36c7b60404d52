"""Ledger and lineage on the driver's tables.

The tables have no ledger; documents stand in for recorded inputs, and region, nation, customer and
order for a chain of artifacts. Breaks are induced by fixed remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import ledger as lg
from verdigris.operators import lineage as ln
from verdigris.plans.base import query, table

_DISK = "SELECT doc_id AS path, CASE WHEN doc_id % 11 = 3 THEN sha256(text || 'x') ELSE sha256(text) END AS sha, source FROM documents WHERE doc_id % 13 <> 5"
_RECORDED = "SELECT doc_id AS path, sha256(text) AS sha, source FROM documents WHERE doc_id % 17 <> 2"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 17 <> 2").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "source")


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.when(F.col("doc_id") % 11 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("doc_id % 13 <> 5").select(F.col("doc_id").alias("path"), F.sha2(edited.cast("binary"), 256).alias("sha"), "source")


_STALE = f"""WITH r AS ({_RECORDED}), d AS ({_DISK}),
  v AS (SELECT coalesce(r.path, d.path) AS path, CASE WHEN r.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'missing' WHEN r.sha = d.sha THEN 'current' ELSE 'changed' END AS verdict FROM r FULL JOIN d ON r.path = d.path)"""


@query("staleness_diff", _STALE + " SELECT * FROM v")
def staleness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.staleness(_recorded(spark, sf_dir), _disk(spark, sf_dir), "path", "sha")


@query(
    "staleness_status",
    _STALE + """, s AS (SELECT source, count(*) FILTER (verdict = 'current') AS n_current, count(*) FILTER (verdict = 'changed') AS n_changed, count(*) FILTER (verdict = 'missing') AS n_missing, count(*) FILTER (verdict = 'added') AS n_added
                FROM v JOIN documents ON path = doc_id GROUP BY source)
       SELECT *, CASE WHEN n_current + n_changed + n_missing = 0 THEN 'no-provenance' WHEN n_changed + n_missing + n_added = 0 THEN 'up-to-date' ELSE 'stale' END AS status FROM s""",
)
def staleness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lg.staleness(_recorded(spark, sf_dir), _disk(spark, sf_dir), "path", "sha")
    return lg.status(told.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source"), "path"), ["source"])


@query("added_files", f"SELECT path FROM ({_DISK}) WHERE path NOT IN (SELECT path FROM ({_RECORDED}))")
def added_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disk(spark, sf_dir).join(_recorded(spark, sf_dir), "path", "left_anti").select("path")


@query(
    "review_inputs",
    """WITH f AS (SELECT doc_id AS path FROM documents WHERE doc_id % 2 = 0), d AS (SELECT doc_id AS path FROM documents WHERE doc_id % 3 = 0), p AS (SELECT doc_id AS path FROM documents WHERE doc_id % 7 <> 1),
       a AS (SELECT path FROM f UNION SELECT path FROM d)
       SELECT path, CASE WHEN path IN (SELECT path FROM f) AND path IN (SELECT path FROM d) THEN 'both' WHEN path IN (SELECT path FROM f) THEN 'folder' ELSE 'declared' END AS origin, path IN (SELECT path FROM p) AS present FROM a""",
)
def review_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    return lg.review_inputs(docs.where("path % 2 = 0"), docs.where("path % 3 = 0"), docs.where("path % 7 <> 1"), "path")


@query(
    "ledger_merge",
    """SELECT o_orderkey AS artifact, o_orderstatus AS sha, 'old' AS reviewed FROM orders WHERE o_orderkey % 4 <> 1 AND NOT (o_orderkey % 4 = 2)
       UNION ALL SELECT o_orderkey, o_orderpriority, 'new' FROM orders WHERE o_orderkey % 4 IN (1, 2)""",
)
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = lambda where, sha, name: orders.where(where).select(F.col("o_orderkey").alias("artifact"), F.col(sha).alias("sha"), F.lit(name).alias("reviewed"))
    return lg.merged(edges("o_orderkey % 4 <> 1", "o_orderstatus", "old"), edges("o_orderkey % 4 in (1, 2)", "o_orderpriority", "new"), "artifact")


_EDGES = """SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, child: str, c: str, parent: str, p: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(c), F.col(child).cast("string")).alias("child"), F.concat(F.lit(p), F.col(parent).cast("string")).alias("parent"))

    return part("orders", "o_orderkey", "o", "o_custkey", "c").unionByName(part("customer", "c_custkey", "c", "c_nationkey", "n")).unionByName(part("nation", "n_nationkey", "n", "n_regionkey", "r"))


_WALK = f"""WITH RECURSIVE e AS ({_EDGES}), roots AS (SELECT 'o' || o_orderkey AS node FROM orders),
  walk(root, node, depth) AS (SELECT node, node, 0 FROM roots UNION ALL SELECT root, parent, depth + 1 FROM walk JOIN e ON node = child)"""


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))


@query("lineage_closure", _WALK + " SELECT root, node, min(depth)::INTEGER AS depth FROM walk GROUP BY root, node")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.closure(_edges(spark, sf_dir), _roots(spark, sf_dir))


@query("lineage_closure_recursive", _WALK + " SELECT root, node, min(depth)::INTEGER AS depth FROM walk GROUP BY root, node")
def lineage_closure_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.closure_sql(spark, _edges(spark, sf_dir), _roots(spark, sf_dir))


_NODES = f"""nodes AS (SELECT node, hash % 1000 <> 0 AND NOT node IN ('n3', 'c17') AS present, node LIKE 'r%' AND node <> 'r2' AS raw, node LIKE 'c%5' AS drifted
  FROM (SELECT DISTINCT node, 1 AS hash FROM (SELECT child AS node FROM ({_EDGES}) UNION ALL SELECT parent FROM ({_EDGES}))))"""
_BREAKS = _WALK + f""", {_NODES}, made AS (SELECT DISTINCT child AS node FROM e),
  breaks AS (SELECT DISTINCT root, w.node, CASE WHEN NOT present THEN 'missing' WHEN drifted THEN 'drifted' WHEN m.node IS NULL AND NOT raw THEN 'unsourced' END AS kind
             FROM walk w JOIN nodes USING (node) LEFT JOIN made m USING (node))"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    node = F.col("node")
    return edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct().select("node", (~node.isin("n3", "c17")).alias("present"), (node.startswith("r") & (node != "r2")).alias("raw"), node.rlike("^c.*5$").alias("drifted"))


@query("trace_breaks", _BREAKS + " SELECT root, node, kind FROM breaks WHERE kind IS NOT NULL")
def trace_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.trace(_edges(spark, sf_dir), _roots(spark, sf_dir), _nodes(spark, sf_dir))


@query(
    "report_trace",
    _BREAKS + """, n AS (SELECT root, count(*) AS n FROM breaks WHERE kind IS NOT NULL GROUP BY root), r AS (SELECT DISTINCT root FROM walk JOIN nodes USING (node) WHERE raw)
       SELECT node AS root, coalesce(n, 0)::BIGINT AS n_breaks, CASE WHEN n > 0 THEN 'BROKEN' ELSE 'GROUNDED' END AS status, r.root IS NOT NULL AS reaches_raw,
              CASE WHEN n > 0 OR r.root IS NULL THEN 'BROKEN' ELSE 'GROUNDED' END AS status_strict FROM roots LEFT JOIN n ON n.root = node LEFT JOIN r ON r.root = node""",
)
def report_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, roots, nodes = _edges(spark, sf_dir), _roots(spark, sf_dir), _nodes(spark, sf_dir)
    return ln.verdicts(roots, ln.trace(edges, roots, nodes), ln.reaching(edges, nodes.where("raw")))
