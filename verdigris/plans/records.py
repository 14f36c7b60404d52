"""Records on the driver's tables: customers are papers, orders answers of registries and inputs of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import records as rc
from verdigris.plans.base import query, table


@query(
    "registry_records",
    """SELECT c_custkey, 'Of ' || c_name AS title, c_mktsegment || ', A; Doe' AS authors_text, CASE WHEN c_custkey % 3 <> 0 THEN 1990 + c_nationkey END AS year, CASE WHEN c_custkey % 2 = 0 THEN '10.1/' || c_custkey END AS doi, CASE WHEN c_custkey % 2 = 0 THEN 'https://doi.org/10.1/' || c_custkey END AS source_url,
       CASE WHEN c_custkey % 5 = 0 THEN 'misc' ELSE 'article' END AS bibtex_type FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 7 = 0""",
)
def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.to_json(
        F.struct(
            F.array(F.concat(F.lit("<i>Of</i> "), "c_name")).alias("title"),
            F.array(F.struct(F.col("c_mktsegment").alias("family"), F.lit("A").alias("given")), F.struct(F.lit("Doe").alias("family"), F.lit("").alias("given"))).alias("author"),
            F.struct(F.array(F.array(F.when(k % 3 != 0, F.col("c_nationkey") + 1990))).alias("date-parts")).alias("issued"),
            F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("DOI"),
            F.when(k % 5 == 0, "posted-content").otherwise("journal-article").alias("type"),
        )
    )
    told = table(spark, sf_dir, "customer").select("c_custkey", rc.from_registry(F.when(k % 7 == 0, F.lit("<html>")).otherwise(body)).alias("r"))
    return told.select("c_custkey", *[F.col(f"r.{c}") for c in ("title", "authors_text", "year", "doi", "source_url", "bibtex_type")])


_CANDIDATES = """t AS (SELECT c_custkey AS citekey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 1),
  c AS (SELECT o_custkey AS citekey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE WHEN o_orderkey % 6 <> 0 THEN '10.1/' || o_orderkey END AS doi, 2000 + o_orderkey % 5 AS year, (o_orderkey % 11) / 10.0 AS overlap, CASE WHEN o_custkey % 2 = 0 THEN 2002 END AS file_year FROM orders),
  v AS (SELECT citekey, arg_min(doi, rank) FILTER (overlap >= 0.34 AND doi IS NOT NULL AND (file_year IS NULL OR abs(year - file_year) <= 1)) AS chosen, arg_max(coalesce(doi, '-'), struct_pack(o := overlap, r := -rank)) AS best, max(overlap) AS score FROM c GROUP BY citekey)"""


@query("enrichment_choice", f"WITH {_CANDIDATES} SELECT citekey, chosen, nullif(best, '-') AS best, coalesce(score, 0)::DOUBLE AS score, CASE WHEN chosen IS NULL THEN 'review' ELSE 'apply' END AS verdict FROM t LEFT JOIN v USING (citekey)")
def enrichment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k, o = F.col("o_custkey"), F.col("o_orderkey")
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("citekey"), F.when(F.col("c_custkey") % 3 == 0, "pdf").otherwise("crossref").alias("source"), F.when(F.col("c_custkey") % 4 != 1, 2000).alias("year"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    candidates = table(spark, sf_dir, "orders").select(k.alias("citekey"), rank.alias("rank"), F.when(o % 6 != 0, F.concat(F.lit("10.1/"), o.cast("string"))).alias("doi"), (o % 5 + 2000).alias("year"), ((o % 11) / 10.0).alias("overlap"), F.when(k % 2 == 0, 2002).alias("file_year"))
    return rc.enrichment(papers.where(rc.to_enrich(F.col("source"), F.col("year"))), candidates)


@query(
    "file_resolution",
    """SELECT doc_id || '.pdf' AS path, CASE doc_id % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'pmcid' WHEN 2 THEN 'doi' END AS kind, CASE doc_id % 4 WHEN 0 THEN '10.1234/own.' || doc_id WHEN 1 THEN 'PMC' || doc_id WHEN 2 THEN '10.1234/cited.' || doc_id END AS value,
       CASE doc_id % 4 WHEN 0 THEN 'trusted' WHEN 1 THEN 'trusted' WHEN 2 THEN 'suspect' END AS tier FROM documents""",
)
def file_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter has its own DOI in front, a quarter a PMC id; one cites a work of its own title, one a foreign work."""
    k = F.col("doc_id").cast("string")
    part = F.col("doc_id") % 4
    front = F.when(part == 0, F.concat(F.lit("doi 10.1234/own."), k)).when(part == 1, F.concat(F.lit("PMC"), k)).otherwise(F.lit("Wonderful mitochondrial dynamics"))
    text = F.concat(front, F.lit("\nReferences\n10.1234/cited."), k, F.lit("."))
    files = table(spark, sf_dir, "documents").select(F.concat(k, F.lit(".pdf")).alias("path"), text.alias("text"), "doc_id")
    title = F.when(part == 3, "Entirely other matters").otherwise("Mitochondrial dynamics, wonderful")
    told = F.explode(F.array(F.struct(F.lit("doi").alias("kind"), F.concat(F.lit("10.1234/own."), k).alias("value")), F.struct(F.lit("pmcid").alias("kind"), F.concat(F.lit("PMC"), k).alias("value")), F.struct(F.lit("doi").alias("kind"), F.concat(F.lit("10.1234/cited."), k).alias("value"))))
    answers = table(spark, sf_dir, "documents").select(title.alias("title"), told.alias("i")).select("i.kind", "i.value", "title")
    return rc.resolved_files(files.select("path", "text"), answers)


@query(
    "records_reenriched",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS title, c_mktsegment AS original_path, CASE WHEN c_custkey % 3 = 0 THEN 'unverified' END AS enriched_from, CASE WHEN c_custkey % 3 = 0 THEN 'day2' ELSE 'day1' END AS updated_at FROM customer""",
)
def records_reenriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("original_path"), F.lit("day1").alias("updated_at"))
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.upper("title").alias("title"), F.lit("lost").alias("original_path"))
    return rc.reenriched(old, new, "c_custkey", F.lit("day2"))


@query("metadata_edit", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'name=' || c_name || ',note=new' ELSE 'name=edited,note=new,old=1' END AS record, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'old' END AS unknown FROM customer")
def metadata_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    text = lambda c: F.lit(c).cast("string")
    before = F.create_map(F.lit("name"), F.col("c_name"), F.lit("old"), text("1"))
    change = F.when(even, F.create_map(F.lit("note"), text("new"), F.lit("old"), text(None))).otherwise(F.create_map(F.lit("note"), text("new"), F.lit("name"), text("edited")))
    after = rc.edited(before, change)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(after)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("record"), F.array_join(rc.unknown_keys(after, ["name", "note"]), ",").alias("unknown"))


@query(
    "stubs_attached",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'stub' ELSE 'full' END AS content_state, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'new/' || c_custkey WHEN c_custkey % 2 <> 0 THEN 'old/' || c_custkey END AS file_path, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'n' WHEN c_custkey % 2 <> 0 THEN 'o' END AS sha FROM customer",
)
def stubs_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(k % 2 == 0, "stub").otherwise("full").alias("content_state"), F.when(k % 2 != 0, F.concat(F.lit("old/"), k.cast("string"))).alias("file_path"), F.when(k % 2 != 0, "o").alias("sha"))
    files = old.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new/"), k.cast("string")).alias("path"), F.lit("n").alias("sha"))
    return rc.attached(old, files, "c_custkey")


@query(
    "claim_marker_drift",
    """WITH h AS (SELECT 'p' || (user_id % 40) AS path, event_id AS ev, event_type AS sha FROM events), c AS (SELECT o_orderkey AS claim_id, 'p' || (o_orderkey % 40) AS path FROM orders UNION ALL SELECT o_orderkey, 'p' || (o_orderkey % 7) FROM orders),
       m AS (SELECT o_orderkey AS claim_id, 'commit' || lpad(o_orderkey::VARCHAR, 8, '0') AS "commit", (o_orderkey * 37) % 1000 AS mark FROM orders WHERE o_orderkey % 5 <> 0),
       n AS (SELECT path, arg_max(sha, ev) AS now FROM h GROUP BY path), d AS (SELECT DISTINCT claim_id, c.path, mark FROM c JOIN m USING (claim_id)),
       marks AS (SELECT DISTINCT path, mark FROM d), s AS (SELECT marks.path, mark, arg_max(sha, ev) FILTER (ev <= mark) AS state FROM marks JOIN h USING (path) GROUP BY marks.path, mark),
       x AS (SELECT claim_id, array_to_string(list_sort(list(DISTINCT d.path)), ',') AS changed FROM d JOIN s ON d.path = s.path AND d.mark = s.mark JOIN n ON n.path = d.path WHERE state IS DISTINCT FROM now GROUP BY claim_id)
       SELECT claim_id, "commit" IS NOT NULL AS checked, changed IS NOT NULL AS stale, substr("commit", 1, 10) AS "commit", coalesce(changed, '') AS changed FROM (SELECT DISTINCT claim_id FROM c) LEFT JOIN m USING (claim_id) LEFT JOIN x USING (claim_id)""",
)
def claim_marker_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of forty paths over the events; claims with the same mark and path share the work."""
    k = F.col("o_orderkey")
    named = lambda n: F.concat(F.lit("p"), n.cast("string"))
    orders = table(spark, sf_dir, "orders")
    claims = orders.select(k.alias("claim_id"), F.explode(F.array(named(k % 40), named(k % 7))).alias("path"))
    marks = orders.where("o_orderkey % 5 <> 0").select(k.alias("claim_id"), F.concat(F.lit("commit"), F.lpad(k.cast("string"), 8, "0")).alias("commit"), ((k * 37) % 1000).alias("at"))
    history = table(spark, sf_dir, "events").select(named(F.col("user_id") % 40).alias("path"), F.col("event_id").alias("at"), F.col("event_type").alias("sha"))
    told = rc.marker_drift(claims, marks, history)
    return told.withColumn("changed", F.array_join("changed", ","))


@query(
    "review_stamped",
    """WITH e AS (SELECT 'c' || o_custkey AS artifact, 'o' || o_orderkey AS path, 'old' AS sha, 'day1' AS reviewed_at, o_custkey FROM orders), s AS (SELECT 'c' || c_custkey AS artifact, 'f' || (c_custkey % 5) AS folder FROM customer WHERE c_custkey % 4 = 0),
       t AS (SELECT 'o' || o_orderkey AS path, o_orderstatus AS sha, 'f' || (o_orderkey % 5) AS folder FROM orders WHERE o_orderkey % 200 = 1 OR o_orderkey % 9 <> 2), f AS (SELECT * FROM t WHERE path IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 100 = 1))
       SELECT artifact, path, sha, reviewed_at FROM e WHERE artifact NOT IN (SELECT artifact FROM s) UNION SELECT s.artifact, f.path, f.sha, 'day2' FROM s JOIN f ON s.folder = f.folder UNION SELECT e.artifact, e.path, t.sha, 'day2' FROM e JOIN s USING (artifact) JOIN (SELECT path, sha, CASE WHEN path IN (SELECT path FROM f) THEN folder ELSE 'elsewhere' END AS folder FROM t) t ON t.path = e.path WHERE t.folder <> s.folder""",
)
def review_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few orders lie in folders, the others elsewhere."""
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    orders, o = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    edges = orders.select(named("c", F.col("o_custkey")).alias("artifact"), named("o", o).alias("path"), F.lit("old").alias("sha"), F.lit("day1").alias("reviewed_at"))
    stamps = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(named("c", F.col("c_custkey")).alias("artifact"), named("f", F.col("c_custkey") % 5).alias("folder"), F.lit("day2").alias("at"))
    there = orders.where("o_orderkey % 200 = 1 or o_orderkey % 9 <> 2").select(named("o", o).alias("path"), F.col("o_orderstatus").alias("sha"), F.when(o % 100 == 1, named("f", o % 5)).otherwise("elsewhere").alias("folder"))
    return rc.reviewed(edges, there, stamps)


@query("claims_indexed", "SELECT 'E' || c_nationkey AS exp_id, o_orderkey AS claim_id, CASE WHEN c_nationkey = 3 THEN 'failed' ELSE 'passed' END AS outcome, substr(o_orderpriority, 1, 1) AS strength FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 OR o_orderkey % 2 = 0")
def claims_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("E"), F.col("c_nationkey").cast("string")).alias("exp_id"))
    old = table(spark, sf_dir, "orders").join(people, "o_custkey").select("exp_id", F.col("o_orderkey").alias("claim_id"), F.lit("passed").alias("outcome"), F.substring("o_orderpriority", 1, 1).alias("strength"))
    report = old.where("exp_id = 'E3' and claim_id % 2 = 0").select("claim_id", F.lit("failed").alias("outcome"), "strength")
    return rc.claims_indexed(old, report, "E3")


@query(
    "viewer_orders",
    """WITH p AS (SELECT n_nationkey AS k, n_name AS title, CASE WHEN n_nationkey % 4 <> 0 THEN 2000 + n_nationkey % 3 END AS year, 'A' || n_regionkey AS a FROM nation)
       SELECT k, row_number() OVER (ORDER BY coalesce(year, 0) DESC, title, k)::INTEGER AS newest, row_number() OVER (ORDER BY coalesce(year, 0), title, k)::INTEGER AS oldest, row_number() OVER (ORDER BY a, coalesce(year, 0) DESC, k)::INTEGER AS author, row_number() OVER (ORDER BY title, k)::INTEGER AS title FROM p""",
)
def viewer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") % 3 + 2000).alias("year"), F.concat(F.lit("A"), F.col("n_regionkey").cast("string")).alias("authors_text"))
    for name, order in (("newest", "year-desc"), ("oldest", "year-asc"), ("author", "author"), ("by_title", "title")):
        rows = rc.placed(rows, order, "k").withColumnRenamed("place", name)
    return rows.select("k", "newest", "oldest", "author", F.col("by_title").alias("title"))


@query("numeric_suffixes", "SELECT c_nationkey, string_agg('C-' || c_custkey, ',' ORDER BY c_custkey) AS names FROM customer GROUP BY c_nationkey")
def numeric_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.collect_list(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(rc.by_number(named), ",").alias("names"))


@query("claim_outcomes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'skipped' WHEN l_linenumber % 2 = 0 AND l_quantity > 25 THEN 'xfail' WHEN l_linenumber % 2 = 0 THEN 'xpass' WHEN l_quantity > 25 THEN 'failed' ELSE 'passed' END AS outcome FROM lineitem")
def claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigris.operators import claims as cl

    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cl.outcome_of(F.col("l_quantity") > 25, line % 2 == 0, line == 7).alias("outcome"))
