"""Snapshots, checks and views on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as fn
from verdigris.operators import checks, upsert
from verdigris.plans.base import query, table


@query(
    "merge_upsert",
    """WITH o AS (SELECT c_custkey, c_name, c_mktsegment, 'day1' AS added_at, 'day1' AS updated_at FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, c_name || '!' AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
       SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, coalesce(added_at, 'day2') AS added_at, CASE WHEN n.c_custkey IS NOT NULL THEN 'day2' ELSE updated_at END AS updated_at
       FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = rows.where("c_custkey % 5 <> 0").withColumn("added_at", F.lit("day1")).withColumn("updated_at", F.lit("day1"))
    new = rows.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return upsert.upserted(old, new, ["c_custkey"], "added_at", "updated_at", F.lit("day2"))


@query(
    "merge_union_tags",
    """WITH o AS (SELECT user_id, max(CASE WHEN event_id % 3 = 0 THEN event_type END) AS title, list(DISTINCT event_type) AS tags FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
       n AS (SELECT user_id, max(event_type) AS title, list(DISTINCT event_type || '+') AS tags FROM events WHERE event_id % 7 = 0 GROUP BY user_id)
       SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.title, n.title) AS title, array_to_string(list_sort(list_concat(coalesce(o.tags, []), coalesce(n.tags, []))), ',') AS tags FROM o FULL JOIN n ON o.user_id = n.user_id""",
)
def merge_union_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    old = events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("title"), F.collect_set("event_type").alias("tags"))
    new = events.where("event_id % 7 = 0").groupBy("user_id").agg(F.max("event_type").alias("title"), F.collect_set(F.concat("event_type", F.lit("+"))).alias("tags"))
    return upsert.filled(old, new, ["user_id"], ["title"], ["tags"]).withColumn("tags", F.array_join("tags", ","))


@query("prune_scoped", "SELECT doc_id, source FROM documents WHERE NOT (source IN ('src1', 'src2') AND doc_id % 3 <> 0)")
def prune_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return upsert.pruned(docs, docs.where("doc_id % 3 = 0"), "doc_id", "source", docs.where("source in ('src1', 'src2')")).select("doc_id", "source")


@query("redundant_archives", "SELECT l_orderkey, count(*) AS n_members FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)) GROUP BY l_orderkey")
def redundant_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return checks.redundant(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", there)


@query(
    "structural_flags",
    """WITH d AS (SELECT *, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents)
       SELECT doc_id AS subject, unnest(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN n_chars <> length(text) THEN 'size-differs' END, CASE WHEN copies > 1 THEN 'copied' END, CASE WHEN lang = 'en' AND NOT contains(text, 'the') THEN 'no-stop-word' END], lambda x: x IS NOT NULL)) AS flag FROM d""",
)
def structural_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text shows is told in the scan, so hashes and flags meet their copies, texts do not."""
    told = {"short": F.length("text") < 200, "size-differs": F.col("n_chars") != F.length("text"), "no-stop-word": (F.col("lang") == "en") & ~F.contains("text", F.lit("the"))}
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *[rule.alias(name) for name, rule in told.items()])
    copied = docs.groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")
    rules = {name: F.col(f"`{name}`") for name in told} | {"copied": F.col("copies").isNotNull()}
    return checks.flags(docs.join(copied, "sha", "left"), "doc_id", rules)


@query("integrity_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query(
    "reproduction",
    """WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN o_totalprice * 1.0001 WHEN 2 THEN o_totalprice + 1000000 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 9 <> 0)
       SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.v IS NULL THEN 'not-regenerated' WHEN a.v IS NULL THEN 'unrecorded' WHEN a.v = b.v THEN 'exact' WHEN abs(a.v - b.v) <= greatest(0.001 * greatest(abs(a.v), abs(b.v)), 0.000001) THEN 'approx' ELSE 'mismatch' END AS verdict
       FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    part, v = F.col("o_orderkey") % 4, F.col("v")
    again = orders.where("o_orderkey % 9 <> 0").withColumn("v", F.when(part == 1, v * 1.0001).when(part == 2, v + 1_000_000).otherwise(v))
    return checks.regenerated(orders.where("o_orderkey % 7 <> 0"), again, "o_orderkey", "v", fn.close(F.col("a"), F.col("b")))


@query(
    "entity_registry",
    """WITH e AS (SELECT 'nation' AS kind, c_nationkey::VARCHAR AS entity, c_custkey FROM customer UNION ALL SELECT 'segment', c_mktsegment, c_custkey FROM customer UNION ALL SELECT 'priority', o_orderpriority, o_custkey FROM orders)
       SELECT kind, entity, count(DISTINCT c_custkey) AS n FROM e GROUP BY kind, entity""",
)
def entity_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("entity"))
    people = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(entry("nation", "c_nationkey"), entry("segment", "c_mktsegment"))).alias("e"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), entry("priority", "o_orderpriority").alias("e"))
    return people.unionByName(orders).groupBy("e.kind", "e.entity").agg(F.count_distinct("c_custkey").alias("n"))


@query("catalog_render", r"SELECT n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\|') || ' | ' || replace(r_name, '|', '\|') || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    return joined.select("n_nationkey", F.concat(F.lit("| "), F.concat_ws(" | ", cell("n_nationkey"), cell("n_name"), cell("r_name")), F.lit(" |")).alias("line"))


@query(
    "files_by_role",
    """WITH d AS (SELECT source AS role, lang AS type, doc_id FROM documents)
       SELECT role, type, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:4], ',') AS samples FROM d GROUP BY role, type""",
)
def files_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four samples each: the smallest ids, found with a partial limit before the shuffle."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("role"), F.col("lang").alias("type"), "doc_id")
    counts = docs.groupBy("role", "type").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("role", "type").orderBy("doc_id"))).where("r <= 4")
    samples = first.groupBy("role", "type").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(samples, ["role", "type"])
