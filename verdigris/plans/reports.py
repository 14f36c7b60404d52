"""Reports on the driver's tables: orders are claims and artifacts, customers write reports about their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import reports as rp
from verdigris.plans.base import query, table

#: Every order is a claim of its customer's nation; every supplier one with a name that others share.
_CLAIMS = """claims AS (
  SELECT 'E' || c_nationkey || '::test_orders.py::o' || o_orderkey AS claim_id, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'xpass' END AS outcome,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'strong' WHEN '2' THEN 'moderate' WHEN '3' THEN 'moderate' ELSE 'weak' END AS strength, 'order of ' || o_custkey AS statement, o_orderkey AS k, c_nationkey AS home, o_custkey AS cust
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'E' || s_nationkey || '::test_supply.py::s' || s_name || (s_suppkey % 2), 'passed', 'strong', 'supplier', s_suppkey, s_nationkey, NULL FROM supplier)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("home"))
    return table(spark, sf_dir, "orders").join(people, "o_custkey").select("o_orderkey", "o_custkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("level"), "home")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    outcome = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("xpass")
    strength = F.when(F.col("level") == "1", "strong").when(F.col("level").isin("2", "3"), "moderate").otherwise("weak")
    orders = _orders(spark, sf_dir).select(text("E", F.col("home").cast("string"), "::test_orders.py::o", F.col("o_orderkey").cast("string")).alias("claim_id"), outcome.alias("outcome"), strength.alias("strength"), text("order of ", F.col("o_custkey").cast("string")).alias("statement"))
    supply = table(spark, sf_dir, "supplier").select(text("E", F.col("s_nationkey").cast("string"), "::test_supply.py::s", F.col("s_name"), (F.col("s_suppkey") % 2).cast("string")).alias("claim_id"), F.lit("passed").alias("outcome"), F.lit("strong").alias("strength"), F.lit("supplier").alias("statement"))
    return orders.unionByName(supply)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each customer: a line for each order, which cites the order's claim (by its full id, its name, or a name that is none) and shows its figure; a fence hides the rest."""
    k = F.col("o_orderkey").cast("string")
    ref = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), k)).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("E"), F.col("home").cast("string"), F.lit("::test_orders.py::o"), k)).otherwise(F.concat(F.lit("o"), k))
    line = F.concat(F.lit("Order "), k, F.lit(" holds [claim: "), ref, F.lit("], see ![fig](analysis/o"), k, F.lit(".csv)"))
    hidden = F.concat(F.lit("[claim:hidden"), k, F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"), hidden.alias("hidden")))), lambda x: x)
    told = _orders(spark, sf_dir).groupBy("o_custkey").agg(lines.alias("l"))
    body = F.concat(F.lit("# Report\n\n## Orders\n"), F.array_join(F.transform("l", lambda x: x.line), "\n"), F.lit("\n```\n"), F.array_join(F.transform("l", lambda x: x.hidden), "\n"), F.lit("\n```\n[claim:no such claim] ![far](https://example.org/a.png)"))
    return told.select(F.col("o_custkey").alias("report"), body.alias("text"))


_CITED = f"""{_CLAIMS}, n AS (SELECT k, cust, home, outcome, strength, row_number() OVER (PARTITION BY cust ORDER BY k) AS r, count(*) OVER (PARTITION BY cust) AS n FROM claims WHERE cust IS NOT NULL),
  a AS (SELECT cust AS report, (r + 3)::INTEGER AS line, 'citation' AS what, CASE k % 5 WHEN 0 THEN 'x' || k WHEN 1 THEN 'E' || home || '::test_orders.py::o' || k ELSE 'o' || k END AS ref,
               CASE WHEN k % 5 = 0 THEN 'missing' WHEN outcome IN ('passed', 'xpass') AND strength IN ('strong', 'moderate') THEN 'backed' ELSE 'weak-backing' END AS verdict FROM n
        UNION ALL SELECT cust, (r + 3)::INTEGER, 'embed', 'analysis/o' || k || '.csv', CASE WHEN k % 3 = 0 AND k % 7 = 0 THEN 'dangling' WHEN k % 3 = 0 THEN 'untracked' WHEN k % 7 = 0 THEN 'missing' WHEN k % 10 = 1 THEN 'drifted' ELSE 'current' END FROM n
        UNION ALL SELECT cust, (2 * max(n) + 6)::INTEGER, 'citation', 'no such claim', 'missing' FROM n GROUP BY cust
        UNION ALL SELECT cust, (2 * max(n) + 6)::INTEGER, 'embed', 'https://example.org/a.png', 'untracked' FROM n GROUP BY cust)"""


def _artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the ledger recorded of figures, and what is there: some unrecorded, some gone, some edited."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("analysis/o"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("path"), F.sha2(F.col("o_orderstatus").cast("binary"), 256).alias("sha"))
    there = rows.where("o_orderkey % 7 <> 0").select("path", F.when(F.col("o_orderkey") % 10 == 1, F.lit("edited")).otherwise(F.col("sha")).alias("sha"))
    return rows.where("o_orderkey % 3 <> 0").select("path", "sha"), there


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded, disk = _artifacts(spark, sf_dir)
    return rp.audited(_reports(spark, sf_dir), _claims(spark, sf_dir), recorded, disk)


@query("report_audit", f"WITH {_CITED} SELECT report, line, what, ref, verdict FROM a")
def report_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("report", "line", "what", "ref", "verdict")


@query("report_audit_status", f"WITH {_CITED} SELECT report, count(*) FILTER (what = 'citation') AS n_citations, count(*) FILTER (what = 'embed') AS n_embeds, count(*) FILTER (verdict NOT IN ('backed', 'current')) AS n_findings, 'BROKEN' AS status FROM a GROUP BY report")
def report_audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.audit_status(_reports(spark, sf_dir), _audited(spark, sf_dir))


@query(
    "report_findings",
    f"""WITH {_CITED} SELECT report, line, '  line ' || line || ': ' || verdict || CASE WHEN what = 'embed' THEN '-embed' WHEN verdict = 'weak-backing' THEN '' ELSE '-claim' END || ' ' || ref AS text FROM a WHERE verdict NOT IN ('backed', 'current')""",
)
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.finding_lines(_audited(spark, sf_dir))


@query(
    "report_assembled",
    f"""WITH {_CITED}, c AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY line) AS number FROM a WHERE what = 'citation')
       SELECT report, 0 AS section, line, 'Order ' || regexp_extract(ref, '([0-9]+)$', 1) || ' holds [^claim-' || number || '], see ![fig](analysis/o' || regexp_extract(ref, '([0-9]+)$', 1) || '.csv)' AS text FROM c WHERE ref <> 'no such claim'
       UNION ALL SELECT report, 0, line, '[^claim-' || number || '] ![far](https://example.org/a.png)' FROM c WHERE ref = 'no such claim'
       UNION ALL SELECT report, 1, number::INTEGER, '[^claim-' || number || ']: ' || CASE WHEN verdict = 'missing' THEN 'claim `' || ref || '` (unresolved)' ELSE '**' || claim_id || '** — ' || statement || ' _[' || outcome || ' · ' || strength || ']_' END
         FROM c LEFT JOIN claims ON try_cast(regexp_extract(ref, '([0-9]+)$', 1) AS BIGINT) = k AND cust = report AND ref NOT LIKE 'x%'""",
)
def report_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the frame of each report: its title, heading, fence and what is hidden there."""
    return rp.assembled(_reports(spark, sf_dir), _claims(spark, sf_dir)).where("section = 1 or text like '%[^claim-%'")


@query("report_sections", f"""WITH {_CLAIMS}, n AS (SELECT cust, k, row_number() OVER (PARTITION BY cust ORDER BY k) AS r, count(*) OVER (PARTITION BY cust) AS n FROM claims WHERE cust IS NOT NULL)
       SELECT cust AS report, 0 AS number, NULL AS heading, '' AS summary FROM n GROUP BY cust UNION ALL
       SELECT cust, 1, 'Orders', string_agg('Order ' || k || ' holds , see', ' ' ORDER BY k) || ' ``` ' || string_agg('', ' ' ORDER BY k) FROM n WHERE false GROUP BY cust UNION ALL
       SELECT cust, 1, 'Orders', string_agg('Order ' || k || ' holds , see', ' ' ORDER BY k) || ' ```' FROM n GROUP BY cust""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden lines hold citations only, which are taken out, so the paragraph ends behind the opening fence."""
    return rp.sections(_reports(spark, sf_dir))


#: A ledger: an order's figure is made from its customer's table, and that from a raw file of the nation.
_LEDGER = """edges AS (SELECT 'analysis/o' || o_orderkey || '.csv' AS child, 'data/c' || o_custkey || '.csv' AS parent FROM orders WHERE o_orderkey % 11 <> 0
    UNION ALL SELECT 'analysis/o' || o_orderkey || '.csv', 'notes/c' || o_custkey || '.md' FROM orders WHERE o_orderkey % 11 = 0
    UNION ALL SELECT 'data/c' || c_custkey || '.csv', 'raw/n' || c_nationkey || '.xlsx' FROM customer),
  made AS (SELECT DISTINCT child FROM edges),
  there AS (SELECT 'analysis/o' || o_orderkey || '.csv' AS path FROM orders UNION SELECT 'data/c' || c_custkey || '.csv' FROM customer WHERE c_custkey % 97 <> 0 UNION SELECT 'raw/n' || n_nationkey || '.xlsx' FROM nation WHERE n_nationkey <> 4 UNION SELECT 'notes/c' || c_custkey || '.md' FROM customer),
  inputs AS (SELECT 'E::o' || o_orderkey AS claim_id, CASE o_orderkey % 13 WHEN 0 THEN 'docs/protocol.pdf' WHEN 1 THEN 'analysis/lost' || o_orderkey || '.csv' ELSE 'analysis/o' || o_orderkey || '.csv' END AS path FROM orders),
  broken AS (SELECT child AS path, 'unsourced' AS kind FROM (SELECT child, max(parent LIKE 'data/%') AS fed FROM edges WHERE child LIKE 'analysis/%' GROUP BY child) WHERE NOT fed
    UNION ALL SELECT DISTINCT parent, 'missing' FROM edges WHERE parent NOT IN (SELECT path FROM there)
    UNION ALL SELECT 'data/c' || c_custkey || '.csv', 'drifted' FROM customer WHERE c_custkey % 50 = 1 AND c_custkey % 97 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 <> 0)),
  t AS (SELECT claim_id, claim_id AS path, 'ungrounded' AS kind FROM inputs WHERE path LIKE 'docs/%' UNION ALL SELECT claim_id, path, 'dangling' FROM inputs WHERE path LIKE 'analysis/lost%'
    UNION SELECT i.claim_id, b.path, b.kind FROM inputs i JOIN broken b ON b.path = i.path
    UNION SELECT i.claim_id, b.path, b.kind FROM inputs i JOIN edges e ON e.child = i.path JOIN broken b ON b.path = e.parent
    UNION SELECT i.claim_id, b.path, b.kind FROM inputs i JOIN edges e ON e.child = i.path JOIN edges f ON f.child = e.parent JOIN broken b ON b.path = f.parent)"""


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """inputs of claims, edges, what is there, and what was recorded."""
    named = lambda folder, column, suffix: F.concat(F.lit(folder), F.col(column).cast("string"), F.lit(suffix))
    orders, people, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    figure, own, raw, notes = named("analysis/o", "o_orderkey", ".csv"), named("data/c", "c_custkey", ".csv"), named("raw/n", "c_nationkey", ".xlsx"), named("notes/c", "c_custkey", ".md")
    edges = orders.select(figure.alias("child"), F.when(F.col("o_orderkey") % 11 != 0, named("data/c", "o_custkey", ".csv")).otherwise(named("notes/c", "o_custkey", ".md")).alias("parent")).unionByName(people.select(own.alias("child"), raw.alias("parent")))
    tables = people.where("c_custkey % 97 <> 0").select(own.alias("path"), F.when(F.col("c_custkey") % 50 == 1, "edited").otherwise("as recorded").alias("sha"))
    rest = orders.select(figure.alias("path")).union(nations.where("n_nationkey <> 4").select(named("raw/n", "n_nationkey", ".xlsx"))).union(people.select(notes))
    disk = tables.unionByName(rest.withColumn("sha", F.lit("as recorded")))
    recorded = edges.select(F.col("parent").alias("path"), F.lit("as recorded").alias("sha")).distinct()
    part = F.col("o_orderkey") % 13
    inputs = orders.select(named("E::o", "o_orderkey", "").alias("claim_id"), F.when(part == 0, "docs/protocol.pdf").when(part == 1, named("analysis/lost", "o_orderkey", ".csv")).otherwise(figure).alias("path"))
    return inputs, edges, disk, recorded


@query("claim_trace", f"WITH {_LEDGER} SELECT claim_id, path, kind FROM t")
def claim_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, edges, disk, recorded = _ledger(spark, sf_dir)
    return rp.claim_trace(inputs, edges, disk, recorded)


@query(
    "report_claim_trace",
    f"""WITH {_LEDGER}, c AS (SELECT o_custkey AS report, 'o' || o_orderkey AS cite, 'E::o' || o_orderkey AS claim_id, o_orderkey % 17 = 0 AS lost FROM orders)
       SELECT report, CASE WHEN lost THEN cite || '?' ELSE cite END AS cite, CASE WHEN lost THEN cite || '?' ELSE path END AS path, CASE WHEN lost THEN 'dangling' ELSE kind END AS kind FROM c LEFT JOIN t USING (claim_id) WHERE lost OR kind IS NOT NULL
       GROUP BY ALL""",
)
def report_claim_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, edges, disk, recorded = _ledger(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    cite = F.concat(F.lit("[claim:o"), k, F.when(F.col("o_orderkey") % 17 == 0, "?").otherwise(""), F.lit("]"))
    reports = orders.groupBy(F.col("o_custkey").alias("report")).agg(F.array_join(F.collect_list(cite), "\n").alias("text"))
    claims = orders.select(F.concat(F.lit("E::o"), k).alias("claim_id"), F.lit("passed").alias("outcome"), F.lit("strong").alias("strength"), F.lit("").alias("statement"))
    return rp.report_trace(reports, claims, rp.claim_trace(inputs, edges, disk, recorded))


@query(
    "trace_terminals",
    """WITH a AS (SELECT s_nationkey AS experiment, CASE s_suppkey % 4 WHEN 0 THEN 'README.md' WHEN 1 THEN 'analysis/s' || s_suppkey || '.csv' ELSE 'data/s' || s_suppkey || '.csv' END AS terminal, CASE s_suppkey % 4 WHEN 0 THEN 'readme' WHEN 1 THEN 'analysis' ELSE 'data' END AS kind FROM supplier),
       c AS (SELECT c_nationkey AS experiment, c_name AS terminal, 'claim' AS kind FROM customer WHERE c_nationkey % 3 = 0), r AS (SELECT *, 1 AS tier FROM c UNION ALL SELECT DISTINCT *, CASE WHEN kind = 'data' THEN 3 ELSE 2 END FROM a)
       SELECT DISTINCT experiment, terminal, kind FROM (SELECT *, min(tier) OVER (PARTITION BY experiment) AS best FROM r) WHERE tier = best""",
)
def trace_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, name = F.col("s_suppkey") % 4, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".csv"))
    child = F.when(part == 0, "README.md").when(part == 1, F.concat(F.lit("analysis/"), name)).otherwise(F.concat(F.lit("data/"), name))
    claims = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").select(F.col("c_nationkey").alias("experiment"), F.col("c_name").alias("claim_id"))
    return rp.terminals(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("experiment"), child.alias("child")), claims)


@query(
    "composed_claims",
    """WITH d AS (SELECT s_nationkey AS file, 'p' || (s_suppkey % 7) AS name FROM supplier), u AS (SELECT DISTINCT c_nationkey AS file, 'p' || (c_custkey % 9) AS used FROM customer), n AS (SELECT name, count(*) AS n FROM d GROUP BY name)
       SELECT u.file, used, CASE WHEN h.file IS NOT NULL THEN 1 ELSE coalesce(n, 0) END::BIGINT AS n, CASE WHEN h.file IS NOT NULL THEN 'same-file' WHEN n = 1 THEN 'unique' WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS verdict
       FROM u LEFT JOIN (SELECT DISTINCT * FROM d) h ON h.file = u.file AND h.name = used LEFT JOIN n ON n.name = used""",
)
def composed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c, n: F.concat(F.lit("p"), (F.col(c) % n).cast("string"))
    claims = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), named("s_suppkey", 7).alias("name"))
    return rp.composed(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), named("c_custkey", 9).alias("used")).distinct(), claims)
