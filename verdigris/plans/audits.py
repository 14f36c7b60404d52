"""Audits and views on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import names as nm
from verdigris.functions import text as fn
from verdigris.operators import audits
from verdigris.plans.base import query, table

_PAPERS = """p AS (SELECT c_custkey AS citekey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS authors_text, CASE WHEN c_custkey % 13 <> 0 THEN 2000 END AS year, CASE WHEN c_custkey % 4 = 0 THEN 'stub' ELSE 'full' END AS content_state,
    CASE c_custkey % 3 WHEN 0 THEN 'pdf' ELSE 'crossref' END AS source, CASE WHEN c_custkey % 5 = 0 THEN '10.1/x' END AS doi, CASE WHEN c_custkey % 6 <> 1 THEN 'papers/' || (CASE WHEN c_custkey % 8 = 3 THEN 'Elsewhere' ELSE c_mktsegment END) || '/' || c_custkey || '.pdf' END AS file_path, c_mktsegment AS folder,
    CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 10) / 10.0 END AS overlap, c_custkey % 17 <> 2 AS there FROM customer),
  f AS (SELECT citekey AS subject, unnest(list_filter([CASE WHEN title IS NULL THEN 'missing:title' END, CASE WHEN authors_text IS NULL THEN 'missing:authors_text' END, CASE WHEN year IS NULL THEN 'missing:year' END, CASE WHEN content_state = 'stub' THEN 'stub' END, CASE WHEN source = 'pdf' THEN 'unverified' END,
    CASE WHEN doi IS NULL AND source <> 'pdf' THEN 'no-identifier' END, CASE WHEN file_path IS NOT NULL AND NOT there THEN 'file-missing' END, CASE WHEN file_path IS NOT NULL AND there AND file_path NOT LIKE 'papers/' || folder || '/%' THEN 'misfiled' END,
    CASE WHEN file_path IS NULL AND content_state <> 'stub' THEN 'no-file' END, CASE WHEN overlap < 0.3 THEN 'low-content-overlap' END], lambda x: x IS NOT NULL)) AS flag FROM p)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    folder = F.when(k % 8 == 3, "Elsewhere").otherwise(F.col("c_mktsegment"))
    papers = table(spark, sf_dir, "customer").select(
        k.alias("citekey"),
        F.when(k % 7 != 0, F.col("c_name")).alias("title"),
        F.when(k % 11 != 0, F.col("c_mktsegment")).alias("authors_text"),
        F.when(k % 13 != 0, 2000).alias("year"),
        F.when(k % 4 == 0, "stub").otherwise("full").alias("content_state"),
        F.when(k % 3 == 0, "pdf").otherwise("crossref").alias("source"),
        F.when(k % 5 == 0, "10.1/x").alias("doi"),
        F.lit(None).cast("string").alias("arxiv_id"),
        F.when(k % 6 != 1, F.concat(F.lit("papers/"), folder, F.lit("/"), k.cast("string"), F.lit(".pdf"))).alias("file_path"),
        F.col("c_mktsegment").alias("folder"),
        F.when(k % 2 == 0, (k % 10) / 10.0).alias("overlap"),
    )
    return audits.paper_flags(papers, papers.where("citekey % 17 <> 2 and file_path is not null").select(F.col("file_path").alias("path")))


@query("paper_audit", f"WITH {_PAPERS} SELECT subject, flag FROM f")
def paper_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@query("flag_histogram", f"WITH {_PAPERS} SELECT string_split(flag, ':')[1] AS sort, count(*) AS n FROM f GROUP BY 1")
def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.flag_histogram(_flags(spark, sf_dir))


@query("most_common_flags", f"WITH {_PAPERS} SELECT string_split(flag, ':')[1] AS sort, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, sort LIMIT 3")
def most_common_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.most_common(audits.flag_histogram(_flags(spark, sf_dir)), "sort", 3)


@query(
    "paper_integrity",
    """WITH a AS (SELECT doc_id AS path, sha256(text) AS sha FROM documents WHERE doc_id % 8 <> 1), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 6 = 2 THEN 'edited' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 9 <> 4)
       SELECT path, finding FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'orphan' WHEN b.path IS NULL THEN 'file-missing' WHEN a.sha <> b.sha THEN 'bytes-changed' END AS finding FROM a FULL JOIN b ON a.path = b.path) WHERE finding IS NOT NULL""",
)
def paper_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    disk = rows.where("path % 9 <> 4").withColumn("sha", F.when(F.col("path") % 6 == 2, "edited").otherwise(F.col("sha")))
    return audits.integrity(rows.where("path % 8 <> 1"), disk)


#: A ledger: customers are artifacts of their nations, made from their orders; some reviews are of experiments without inputs.
_STATE = """e AS (SELECT c_nationkey AS experiment, 'c' || c_custkey AS artifact, CASE WHEN c_custkey % 500 = 3 THEN 'old' ELSE c_mktsegment END AS artifact_sha, CASE WHEN c_nationkey % 4 <> 0 THEN 'o' || o_orderkey END AS path, CASE WHEN o_orderkey % 900 = 7 THEN 'old' ELSE o_orderstatus END AS sha, '2024-0' || (1 + c_nationkey % 9) AS reviewed_at FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey <> 7),
  d AS (SELECT 'c' || c_custkey AS path, c_mktsegment AS now FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 800 <> 5),
  i AS (SELECT experiment, count(*) FILTER (now IS NOT NULL AND sha <> now) AS n_changed, count(*) FILTER (now IS NULL) AS n_missing, max(reviewed_at) AS reviewed_at FROM (SELECT DISTINCT experiment, path, sha, reviewed_at FROM e WHERE path IS NOT NULL) LEFT JOIN d USING (path) GROUP BY experiment),
  a AS (SELECT experiment, bool_or(artifact_sha <> now) AS artifact_changed FROM (SELECT DISTINCT experiment, artifact, artifact_sha FROM e) JOIN d ON d.path = artifact GROUP BY experiment),
  n AS (SELECT s_nationkey AS experiment, count(DISTINCT s_suppkey) AS n_added FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1),
  s AS (SELECT experiment, CASE WHEN n_changed IS NULL THEN 'no-provenance' WHEN n_changed + n_missing + coalesce(n_added, 0) > 0 OR coalesce(artifact_changed, false) THEN 'stale' ELSE 'up-to-date' END AS state, n_changed, n_missing, CASE WHEN n_changed IS NOT NULL THEN coalesce(n_added, 0) END AS n_added, CASE WHEN n_changed IS NOT NULL THEN coalesce(artifact_changed, false) END AS artifact_changed, reviewed_at
        FROM (SELECT experiment FROM e UNION SELECT experiment FROM n) LEFT JOIN i USING (experiment) LEFT JOIN a USING (experiment) LEFT JOIN n USING (experiment))"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    artifact = F.when(F.col("c_custkey") % 500 == 3, "old").otherwise(F.col("c_mktsegment"))
    sha = F.when(F.col("o_orderkey") % 900 == 7, "old").otherwise(F.col("o_orderstatus"))
    edges = people.where("c_nationkey <> 7").join(orders, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("experiment"), named("c", "c_custkey").alias("artifact"), artifact.alias("artifact_sha"), F.when(F.col("c_nationkey") % 4 != 0, named("o", "o_orderkey")).alias("path"), sha.alias("sha"), F.concat(F.lit("2024-0"), (F.col("c_nationkey") % 9 + 1).cast("string")).alias("reviewed_at")
    )
    disk = people.select(named("c", "c_custkey").alias("path"), F.col("c_mktsegment").alias("sha")).unionByName(orders.where("o_orderkey % 800 <> 5").select(named("o", "o_orderkey").alias("path"), F.col("o_orderstatus").alias("sha")))
    in_folder = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("experiment"), named("s", "s_suppkey").alias("path"))
    return audits.staleness(edges, disk, in_folder)


@query("staleness_full", f"WITH {_STATE} SELECT * FROM s")
def staleness_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query("audit_worklist", f"WITH {_STATE}, x AS (SELECT s_nationkey AS experiment, count(*) AS c FROM supplier GROUP BY 1) SELECT experiment, state, coalesce(c, 0) AS n_sources, CASE WHEN state = 'stale' THEN 0 ELSE 1 END AS rank FROM s LEFT JOIN x USING (experiment) WHERE state <> 'up-to-date'")
def audit_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.worklist(_states(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("experiment")))


_PARTS = " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT)::VARCHAR" for k in range(4))


@query("fingerprints", f"WITH x AS (SELECT DISTINCT source, doc_id::VARCHAR AS path, sha256(text) AS sha FROM documents), y AS (SELECT source, sha256(path || chr(10) || sha) AS h FROM x) SELECT source, count(*) AS n_files, sha256({_PARTS}) AS fingerprint FROM y GROUP BY source")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.fingerprint(table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "source", "path", "sha")


_CELLS = """a AS (SELECT o_custkey AS artifact, o_orderkey AS "row", 'price' AS col, o_totalprice::DECIMAL(15,2)::VARCHAR AS value FROM orders WHERE o_custkey % 10 <> 9 UNION ALL SELECT o_custkey, o_orderkey, 'status', o_orderstatus FROM orders WHERE o_custkey % 10 <> 9),
  b AS (SELECT o_custkey AS artifact, o_orderkey AS "row", 'price' AS col, (CASE WHEN o_custkey % 4 = 1 THEN o_totalprice + 0.01 WHEN o_custkey % 4 = 2 AND o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END)::DECIMAL(15,2)::VARCHAR AS value FROM orders WHERE o_custkey % 10 <> 8
        UNION ALL SELECT o_custkey, o_orderkey, 'status', CASE WHEN o_custkey % 25 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END FROM orders WHERE o_custkey % 10 <> 8),
  c AS (SELECT artifact, "row", col, a.value IS NOT NULL AS ia, b.value IS NOT NULL AS ib, a.value IS NOT NULL AND b.value IS NOT NULL AND a.value = b.value AS exact,
               a.value IS NOT NULL AND b.value IS NOT NULL AND (a.value = b.value OR coalesce(abs(try_cast(a.value AS DOUBLE) - try_cast(b.value AS DOUBLE)) <= greatest(0.001 * greatest(abs(try_cast(a.value AS DOUBLE)), abs(try_cast(b.value AS DOUBLE))), 0.000001), false)) AS near FROM a FULL JOIN b USING (artifact, "row", col)),
  t AS (SELECT artifact, count(*) AS n_cells, count(*) FILTER (NOT near) AS n_differ, bool_and(exact) AS exact, bool_or(ia) AS ia, bool_or(ib) AS ib, array_to_string(list('[' || col || '][' || "row" || ']' ORDER BY "row", col) FILTER (NOT near)[1:5], '; ') AS first FROM c GROUP BY artifact),
  v AS (SELECT *, CASE WHEN NOT ib THEN 'not-regenerated' WHEN NOT ia THEN 'unrecorded' WHEN exact THEN 'exact' WHEN n_differ = 0 THEN 'approx' ELSE 'mismatch' END AS verdict FROM t)"""


@query("reproduced_tables", f"WITH {_CELLS} SELECT artifact, verdict, n_cells, n_differ, CASE WHEN verdict = 'mismatch' THEN first END AS first FROM v")
def reproduced_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")

    def cells(df: DataFrame, price: F.Column, status: F.Column) -> DataFrame:
        both = F.array(F.struct(F.lit("price").alias("col"), price.cast("decimal(15,2)").cast("string").alias("value")), F.struct(F.lit("status").alias("col"), status.alias("value")))
        return df.select(F.col("o_custkey").alias("artifact"), F.col("o_orderkey").alias("row"), F.explode(both).alias("c")).select("artifact", "row", "c.col", "c.value")

    k, price = F.col("o_custkey"), F.col("o_totalprice")
    edited = F.when(k % 4 == 1, price + 0.01).when((k % 4 == 2) & (F.col("o_orderkey") % 3 == 0), price * 2).otherwise(price)
    status = F.when(k % 25 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    return audits.compared_tables(cells(orders.where("o_custkey % 10 <> 9"), price, F.col("o_orderstatus")), cells(orders.where("o_custkey % 10 <> 8"), edited, status))


@query("reproduced_figures", "SELECT p_partkey, abs(p_size - (p_size + p_partkey % 7)) <= 4 AND abs((2 * p_size + 10) - (2 * p_size + 10 - p_partkey % 6)) <= 4 AS agrees FROM part")
def reproduced_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are read from the bytes of PNG headers that are made here."""
    head = lambda w, h: F.to_binary(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w.cast("long")), 8, "0"), F.lpad(F.hex(h.cast("long")), 8, "0")), F.lit("hex"))
    size, k = F.col("p_size"), F.col("p_partkey")
    a, b = fn.png_size(head(size, size * 2 + 10)), fn.png_size(head(size + k % 7, size * 2 + 10 - k % 6))
    return table(spark, sf_dir, "part").select("p_partkey", audits.figures_agree(a, b).alias("agrees"))


_RUNS = """n AS (SELECT s_nationkey AS experiment, CASE s_suppkey % 6 WHEN 0 THEN 'Bad' || s_suppkey || '.csv' ELSE '0' || (s_suppkey % 9) || '_data_s' || s_suppkey || '.csv' END AS name, s_suppkey AS k, s_name AS sha FROM supplier)"""


@query(
    "extraction_audit",
    f"""WITH {_RUNS} SELECT experiment, 'determinism' AS "check", name AS subject FROM n WHERE k % 10 = 4 AND k % 5 <> 3 UNION ALL SELECT DISTINCT experiment, 'grounding', 'raw/' || experiment || '.xlsx' FROM n WHERE k % 5 <> 3 AND k % 8 = 2
       UNION ALL SELECT experiment, 'recipe', name FROM n WHERE k % 5 <> 3 AND k % 9 = 5 UNION ALL SELECT experiment, 'data', name FROM n WHERE k % 5 <> 3 AND k % 7 = 1 AND k % 11 <> 6 UNION ALL SELECT experiment, 'legacy', name FROM n WHERE k % 5 = 3 AND k % 11 <> 6 UNION ALL SELECT experiment, 'naming', name FROM n WHERE k % 5 <> 3 AND k % 6 = 0""",
)
def extraction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("Bad"), k.cast("string"), F.lit(".csv"))).otherwise(F.concat(F.lit("0"), (k % 9).cast("string"), F.lit("_data_s"), k.cast("string"), F.lit(".csv")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("experiment"), name.alias("name"), k.alias("k"), F.col("s_name").alias("sha"))
    made = rows.where("k % 5 <> 3")
    again = made.withColumn("sha", F.when(F.col("k") % 10 == 4, "other").otherwise(F.col("sha")))
    disk = rows.where("k % 11 <> 6").withColumn("sha", F.when(F.col("k") % 7 == 1, "edited").otherwise(F.col("sha")))
    entry = lambda path, changed: F.struct(path.alias("path"), F.lit("a").alias("then"), F.when(changed, "b").otherwise("a").alias("now"))
    recorded = made.select("experiment", "name", F.explode(F.array(entry(F.concat(F.lit("raw/"), F.col("experiment").cast("string"), F.lit(".xlsx")), F.col("k") % 8 == 2), entry(F.lit("data/extract.py"), F.col("k") % 9 == 5))).alias("i")).select("experiment", "name", "i.path", "i.then", "i.now")
    return audits.extraction_findings(made, again, disk, recorded)


_CLAIMS = """c AS (SELECT o_orderkey::VARCHAR AS claim_id, 'E' || c_nationkey AS home, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'xfail' END AS outcome, CASE o_orderkey % 3 WHEN 0 THEN 'value' ELSE 'trend' END AS kind, substr(o_orderpriority, 1, 1) AS strength, o_orderkey % 50 = 0 AS stale FROM orders JOIN customer ON o_custkey = c_custkey),
  u AS (SELECT DISTINCT l_orderkey::VARCHAR AS claim_id, 'E' || s_nationkey AS experiment FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(
    "whole_rollup",
    f"""WITH {_CLAIMS} SELECT 'by_outcome' AS what, '' AS key, outcome AS value, count(*) AS n FROM c GROUP BY outcome UNION ALL SELECT 'by_kind', '', kind, count(*) FROM c GROUP BY kind UNION ALL SELECT 'by_strength', '', strength, count(*) FROM c GROUP BY strength
       UNION ALL SELECT 'experiment_outcome', home, outcome, count(*) FROM c GROUP BY home, outcome UNION ALL SELECT 'experiment_kind', home, kind, count(*) FROM c GROUP BY home, kind UNION ALL SELECT 'n_claims', '', '', count(*) FROM c UNION ALL SELECT 'n_experiments', '', '', count(DISTINCT home) FROM c
       UNION ALL SELECT 'stale', home, claim_id, 1 FROM c WHERE stale UNION ALL SELECT 'cross', home, claim_id, count(*) FROM c JOIN u USING (claim_id) WHERE experiment <> home GROUP BY home, claim_id""",
)
def whole_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("E"), F.col("c_nationkey").cast("string")).alias("home"))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    claims = table(spark, sf_dir, "orders").join(people, "o_custkey").select(
        k.cast("string").alias("claim_id"), "home", F.when(status == "F", "passed").when(status == "O", "failed").otherwise("xfail").alias("outcome"), F.when(k % 3 == 0, "value").otherwise("trend").alias("kind"), F.substring("o_orderpriority", 1, 1).alias("strength"), (k % 50 == 0).alias("stale")
    )
    supply = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("E"), F.col("s_nationkey").cast("string")).alias("experiment"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("claim_id"), "l_suppkey").join(supply, "l_suppkey").join(claims.select("claim_id", "home"), "claim_id")
    return audits.whole_rollup(claims, used)


@query(
    "declared_captured",
    """WITH d AS (SELECT DISTINCT l_orderkey AS claim_id, l_suppkey % 25 AS experiment FROM lineitem WHERE l_linenumber <= 2), c AS (SELECT DISTINCT l_orderkey AS claim_id, l_suppkey % 25 AS experiment FROM lineitem WHERE l_linenumber >= 2)
       SELECT claim_id, experiment, CASE WHEN d.x IS NULL THEN 'undeclared' WHEN c.y IS NULL THEN 'unread' ELSE 'both' END AS verdict FROM (SELECT *, 1 AS x FROM d) d FULL JOIN (SELECT *, 1 AS y FROM c) c USING (claim_id, experiment)""",
)
def declared_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_suppkey") % 25).alias("experiment"), "l_linenumber")
    return audits.reconciled(rows.where("l_linenumber <= 2"), rows.where("l_linenumber >= 2"))


@query("entity_members", "SELECT DISTINCT entity, exp_id FROM (SELECT c_mktsegment AS entity, c_custkey AS exp_id FROM customer UNION ALL SELECT 'N' || c_nationkey, c_custkey FROM customer UNION ALL SELECT o_orderpriority, o_custkey FROM orders)")
def entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("exp_id")).agg(F.collect_set("o_orderpriority").alias("assays"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("exp_id"), F.col("c_mktsegment").alias("cro"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("model")).join(own, "exp_id", "left")
    return audits.members(people, {"cro": False, "model": False, "assays": True})


@query("role_summary", """WITH f AS (SELECT c_mktsegment AS role, 't' || (c_custkey % 3) AS type, c_name AS name FROM customer UNION ALL SELECT 'few', 't0', n_name FROM nation WHERE n_nationkey < 5),
       r AS (SELECT role, count(*) AS n, list(name ORDER BY name) AS names FROM f GROUP BY role), t AS (SELECT role, string_agg(c || '×' || type, ', ' ORDER BY c DESC, type) AS types FROM (SELECT role, type, count(*) AS c FROM f GROUP BY role, type) GROUP BY role)
       SELECT role, n, '- **' || role || '** (' || n || '): ' || CASE WHEN n <= 12 THEN array_to_string(list_transform(names, lambda x: '`' || x || '`'), ', ') ELSE types || ' — e.g. ' || array_to_string(list_transform(names[1:4], lambda x: '`' || x || '`'), ', ') || ', …' END AS line FROM r JOIN t USING (role)""")
def role_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role"), F.concat(F.lit("t"), (F.col("c_custkey") % 3).cast("string")).alias("type"), F.col("c_name").alias("name"))
    few = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.lit("few").alias("role"), F.lit("t0").alias("type"), F.col("n_name").alias("name"))
    return audits.role_summary(people.unionByName(few))


@query(
    "markdown_tables",
    r"""WITH t AS (SELECT o_custkey AS k, string_agg('| ' || o_orderkey || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'a\|b' END || ' |', chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey) SELECT k, '| order | note |' || chr(10) || '| --- | --- |' || chr(10) || body AS text FROM t""",
)
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are too short are padded, those that are too long cut."""
    k = F.col("o_orderkey")
    line = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(",a|b,more")))
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    files = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.lit("order,note\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))
    return files.select("k", audits.markdown_table(F.col("text"), F.lit("orders.csv")).alias("text"))


@query(
    "text_mentions",
    r"""WITH m AS (SELECT doc_id, 'ASO-' || (doc_id % 13) || ', aso ' || (doc_id % 7) || ' and ASO00' || (doc_id % 13) || '; V' || lpad((doc_id % 9999999)::VARCHAR, 7, '0') || '  in SOW' || doc_id AS t FROM documents)
       SELECT doc_id, CASE WHEN doc_id % 13 = doc_id % 7 THEN 'ASO-' || (doc_id % 7) WHEN doc_id % 13 < doc_id % 7 THEN 'ASO-' || (doc_id % 13) || ',ASO-' || (doc_id % 7) ELSE 'ASO-' || (doc_id % 7) || ',ASO-' || (doc_id % 13) END AS mentions, 'V' || lpad((doc_id % 9999999)::VARCHAR, 7, '0') || ',SOW' || doc_id AS studies FROM m""",
)
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(F.lit("ASO-"), k(13), F.lit(", aso "), k(7), F.lit(" and ASO00"), k(13), F.lit("; V"), F.lpad(k(9_999_999), 7, "0"), F.lit("  in SOW"), F.col("doc_id").cast("string"))
    found = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return found.select("doc_id", F.array_join(nm.numbered_mentions(F.col("t"), "ASO"), ",").alias("mentions"), F.array_join(nm.study_ids(F.col("t"), [r"\b[A-Z][0-9]{7}\b", r"\b[0-9]{4}-[0-9]{4}\b", r"\bSOW[0-9]+\b"]), ",").alias("studies"))


@query(
    "record_overlay",
    """SELECT c_custkey, 'name=' || c_name || ',nation=' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ',note=kept' ELSE '' END AS record FROM customer""",
)
def record_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of records, some of it broken, without its empty values and under the table's own columns."""
    k = F.col("c_custkey")
    json = F.when(k % 3 == 0, F.lit('{"note": "kept", "name": "stale", "blank": ""}')).when(k % 3 == 1, F.lit("not json")).otherwise(F.lit('{"blank": " "}'))
    record = audits.overlaid(nm.without_empty(nm.tolerant_map(json)), {"name": F.col("c_name"), "nation": F.col("c_nationkey"), "gone": F.lit(None).cast("string")})
    entries = F.array_sort(F.map_entries(record))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("record"))
