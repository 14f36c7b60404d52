"""Claims and reports on the driver's tables: documents and labels stand in for claims, pages for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import claims as cl
from verdigris.plans.base import query, table

_CLAIMS = """SELECT d.doc_id, source, CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS outcome,
  CASE WHEN toxic IS NULL THEN 'unspecified' WHEN toxic = 1 THEN 'weak' WHEN d.doc_id % 2 = 0 THEN 'strong' ELSE 'moderate' END AS strength, lang AS kind FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), "skipped").otherwise(cl.outcome_of(F.col("quality") == 0, F.lit(False), F.lit(False)))
    strength = F.when(F.col("toxic").isNull(), "unspecified").when(F.col("toxic") == 1, "weak").when(F.col("doc_id") % 2 == 0, "strong").otherwise("moderate")
    return joined.select("doc_id", "source", outcome.alias("outcome"), strength.alias("strength"), F.col("lang").alias("kind"))


@query("claim_rollup", f"WITH c AS ({_CLAIMS}) " + " UNION ALL ".join(f"SELECT '{f}' AS facet, {f} AS value, count(*) AS n FROM c GROUP BY {f}" for f in ("outcome", "kind", "strength")))
def claim_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.rollup(_claims(spark, sf_dir), ["outcome", "kind", "strength"])


@query("per_experiment", f"WITH c AS ({_CLAIMS}), n AS (SELECT source, outcome, count(*) AS n FROM c GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n_claims, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS counts FROM n GROUP BY source")
def per_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = cl.per_experiment(_claims(spark, sf_dir), "source", "outcome")
    return nested.withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ","))


@query(
    "cross_experiment",
    """SELECT o_orderkey, c_nationkey AS home, array_to_string(list_sort(list(DISTINCT s_nationkey)), ',') AS others FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey
       JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY o_orderkey, c_nationkey""",
)
def cross_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("home"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("experiment"))
    crossed = cl.cross_experiment(orders.join(lines, "o_orderkey"), "o_orderkey", "home", "experiment")
    return crossed.withColumn("others", F.array_join(F.col("others").cast("array<string>"), ","))


@query("grounded_filter", f"SELECT doc_id FROM ({_CLAIMS}) WHERE outcome IN ('passed', 'xpass') AND strength IN ('strong', 'moderate')")
def grounded_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).where(cl.is_grounded(F.col("outcome"), F.col("strength"))).select("doc_id")


@query("claim_drift", "SELECT event_id, user_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before <> event_type")
def claim_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.drift(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type", "before")


_HREF = 'href="([^"]*)"'
_FOUND = r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS t, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages),
  f AS (SELECT page_id, line, unnest(regexp_extract_all(t, 'href="([^"]*)"', 1)) AS id, generate_subscripts(regexp_extract_all(t, 'href="([^"]*)"', 1), 1) AS place FROM l)"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.references(table(spark, sf_dir, "pages"), "page_id", "html", _HREF)


@query("citation_extract", _FOUND + ", o AS (SELECT page_id, id, min(struct_pack(l := line, k := place)) AS p FROM f GROUP BY ALL) SELECT page_id AS report, trim(id) AS id, row_number() OVER (PARTITION BY page_id ORDER BY p, id)::INTEGER AS number FROM o")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.footnotes(_references(spark, sf_dir))


_RESOLVED = _FOUND + r""", c AS (SELECT replace(replace(url, '://', '::'), '/', '::') AS claim_id, min(page_id) % 3 <> 0 AS grounded FROM pages GROUP BY 1),
  q AS (SELECT DISTINCT page_id AS report, replace(replace(trim(id), '://', '::'), '/', '::') AS id FROM f),
  t AS (SELECT string_split(claim_id, '::')[-1] AS tail, count(*) AS n, bool_or(grounded) AS g FROM c GROUP BY 1)"""


@query(
    "citation_resolve",
    _RESOLVED + """ SELECT report, id, CASE WHEN c.claim_id IS NULL AND n IS NULL THEN 'missing' WHEN c.claim_id IS NULL AND n > 1 THEN 'ambiguous' WHEN (CASE WHEN c.claim_id IS NOT NULL THEN grounded ELSE g END) THEN 'backed' ELSE 'weak-backing' END AS verdict
       FROM q LEFT JOIN c ON q.id = c.claim_id LEFT JOIN t ON string_split(q.id, '::')[-1] = t.tail""",
)
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = lambda c: F.replace(F.replace(c, F.lit("://"), F.lit("::")), F.lit("/"), F.lit("::"))
    pages = table(spark, sf_dir, "pages").groupBy(dotted(F.col("url")).alias("claim_id")).agg((F.min("page_id") % 3 != 0).alias("grounded"))
    return cl.resolved(_references(spark, sf_dir).select("report", dotted(F.col("id")).alias("id")).distinct(), pages)


@query(
    "embed_verdicts",
    """WITH t AS (SELECT o_orderkey AS target FROM orders), r AS (SELECT o_orderkey AS target, o_orderstatus AS sha FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT o_orderkey AS target, CASE WHEN o_orderkey % 10 = 1 THEN 'x' ELSE o_orderstatus END AS sha FROM orders WHERE o_orderkey % 5 <> 0)
       SELECT target, CASE WHEN r.sha IS NULL AND p.sha IS NULL THEN 'dangling' WHEN r.sha IS NULL THEN 'untracked' WHEN p.sha IS NULL THEN 'missing' WHEN r.sha = p.sha THEN 'current' ELSE 'drifted' END AS verdict FROM t LEFT JOIN r USING (target) LEFT JOIN p USING (target)""",
)
def embed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("sha"))
    disk = orders.where("path % 5 <> 0").withColumn("sha", F.when(F.col("path") % 10 == 1, "x").otherwise(F.col("sha")))
    return cl.embeds(orders.select(F.col("path").alias("target")), orders.where("path % 3 <> 0"), disk).select("target", "verdict")
