"""Identity and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as fn
from verdigris.operators import identity as ids
from verdigris.plans.base import query, table


@query(
    "byte_identity_groups",
    """SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS primary_id, count(*) OVER (PARTITION BY text) AS n_copies
       FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1""",
)
def byte_identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.byte_groups(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "sha256", "primary_id", "n_copies")


def _title() -> F.Column:
    """The tables have no titles: the whole normalised text stands for one, hashed, with its language; none if nothing remains of it."""
    title = F.nullif(fn.norm_title(F.col("text")), F.lit(""))
    return F.concat(F.sha2(title.cast("binary"), 256), F.lit("|"), "lang")


#: The same in SQL: accents go as they do in the compatibility decomposition, and so does what is not ASCII.
_KEYS = """k AS (SELECT doc_id, 1 AS p, sha256(text) AS v FROM documents UNION ALL
  SELECT doc_id, 2, sha256(nullif(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]+', '', 'g'), ' '), '')) || '|' || lang FROM documents)"""


@query(
    "duplicate_clusters",
    f"""WITH {_KEYS}, g AS (SELECT p, v, list_sort(list(DISTINCT doc_id)) AS members FROM k WHERE v IS NOT NULL GROUP BY p, v HAVING count(DISTINCT doc_id) > 1),
       c AS (SELECT members, min(p)::INTEGER AS p FROM g GROUP BY members)
       SELECT members[1] AS cluster, p AS "by", unnest(members) AS member, len(members)::BIGINT AS n FROM c""",
)
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.clusters(table(spark, sf_dir, "documents"), [F.sha2(F.col("text").cast("binary"), 256), _title()], "doc_id")


@query(
    "priority_match",
    f"""WITH {_KEYS},
       c AS (SELECT p, v, min(doc_id) AS m FROM k WHERE doc_id % 5 <> 0 AND v IS NOT NULL GROUP BY p, v),
       f AS (SELECT k.doc_id AS candidate, m, k.p, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.p) AS r FROM k JOIN c ON k.p = c.p AND k.v = c.v WHERE k.doc_id % 5 = 0)
       SELECT candidate, m AS match, p::INTEGER AS priority FROM f WHERE r = 1""",
)
def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keys = [F.sha2(F.col("text").cast("binary"), 256), _title()]
    return ids.first_match(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0"), keys, "doc_id")


@query(
    "citekeys",
    """WITH w AS (SELECT c_custkey, lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '', 'g')) || (1990 + c_nationkey)::VARCHAR || 'customer' AS base FROM customer),
       n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS r FROM w)
       SELECT c_custkey, base || CASE WHEN r = 1 THEN '' WHEN r <= 27 THEN chr((95 + r)::INTEGER) ELSE '-' || (r - 26)::VARCHAR END AS citekey FROM n""",
)
def citekeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fn.citekey_base(F.col("c_mktsegment"), F.col("c_nationkey") + 1990, F.concat(F.lit("The "), "c_name"), plain=True)
    return ids.citekeys(table(spark, sf_dir, "customer"), base, ["c_custkey"]).select("c_custkey", "citekey")


@query(
    "identifier_classify",
    r"""WITH i AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'doi:10.1234/ab.' || page_id WHEN 2 THEN 'https://doi.org/10.5555/' || page_id WHEN 3 THEN 'arXiv:2101.' || lpad(page_id::VARCHAR, 5, '0')
                     WHEN 4 THEN 'PMC' || page_id WHEN 5 THEN 'pmid: ' || page_id WHEN 6 THEN '10.1000/x' || page_id ELSE lpad(page_id::VARCHAR, 6, '1') END AS s FROM pages)
        SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'doi' WHEN 2 THEN 'doi' WHEN 3 THEN 'arxiv' WHEN 4 THEN 'pmcid' WHEN 5 THEN 'pmid' WHEN 6 THEN 'doi' ELSE 'pmid' END AS kind,
               CASE page_id % 8 WHEN 1 THEN substr(s, 5) WHEN 2 THEN regexp_replace(s, '^.*doi.org/', '') WHEN 3 THEN substr(s, 7) WHEN 5 THEN regexp_replace(s, '[^0-9]', '', 'g') ELSE s END AS value FROM i""",
)
def identifier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    forms = [F.col("url"), F.concat(F.lit("doi:10.1234/ab."), n), F.concat(F.lit("https://doi.org/10.5555/"), n), F.concat(F.lit("arXiv:2101."), F.lpad(n, 5, "0")), F.concat(F.lit("PMC"), n), F.concat(F.lit("pmid: "), n), F.concat(F.lit("10.1000/x"), n), F.lpad(n, 6, "1")]
    said = F.get(F.array(*forms), F.pmod("page_id", F.lit(8)).cast("int"))
    told = fn.classify_identifier(said)
    return table(spark, sf_dir, "pages").select("page_id", told.alias("t")).select("page_id", "t.kind", "t.value")


@query("strip_markup", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.strip_markup(F.col("html")).alias("text"))


#: Canonical name and a pattern of its aliases.
VOCABULARY = {"steel": "steel|stl", "copper": "copper", "brass": "brass", "large": "large|economy", "small": "small|promo", "polished": "polish(ed)?", "plated": "plated"}


@query(
    "vocab_match",
    "WITH v(canon, pattern) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in VOCABULARY.items()) + """)
    SELECT p_partkey, canon FROM part JOIN v ON regexp_matches(lower(p_type || ' ' || p_name), pattern)""",
)
def vocab_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary is short and fixed: one pass tests all its patterns, without a join."""
    hay = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    found = F.array_compact(F.array(*[F.when(hay.rlike(p), F.lit(c)) for c, p in VOCABULARY.items()]))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(found).alias("canon"))


@query(
    "alias_canonical",
    r"""SELECT s_suppkey, CASE WHEN s_name = 'Supplier#000000003' THEN 'third' WHEN regexp_matches(s_name, '#[0-9]+') THEN regexp_replace(regexp_extract(s_name, '#([0-9]+)', 1), '^0+(.)', '\1') END AS canonical,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE regexp_replace(regexp_extract(s_name, '#([0-9]+)', 1), '^0+(.)', '\1') END AS masked FROM supplier""",
)
def alias_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    masked = F.when(F.col("s_suppkey") % 4 == 0, F.lit("nobody")).otherwise(name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", fn.canonical_alias(name, "#([0-9]+)", {"Supplier#000000003": "third"}).alias("canonical"), fn.canonical_alias(masked, "#([0-9]+)").alias("masked"))


@query(
    "entity_slugs",
    r"""SELECT n_nationkey, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '', 'g')) AS slug, trim(regexp_replace(lower(n_name || ' of region ' || n_regionkey), '[^a-z0-9]+', '-', 'g'), '-') AS entity_slug,
               'EXP-' || n_nationkey || '::test_a.py::test_' || lower(n_name) AS claim_id FROM nation""",
)
def entity_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat(F.lit("/abs/K1 - x/claims/test_a.py::test_"), F.lower("n_name"))
    phrase = F.concat(F.col("n_name"), F.lit(" of region "), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", fn.ascii_slug(F.col("n_name")).alias("slug"), fn.entity_slug(phrase).alias("entity_slug"), fn.claim_id(F.concat(F.lit("EXP-"), F.col("n_nationkey").cast("string")), node).alias("claim_id"))


@query(
    "path_collisions",
    """WITH p AS (SELECT c_custkey, c_mktsegment || '/n' || c_nationkey || '.pdf' AS path FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c_custkey) AS r FROM p)
       SELECT c_custkey, CASE WHEN r = 1 THEN path WHEN r = 2 THEN replace(path, '.pdf', ' (' || c_custkey || ').pdf') ELSE replace(path, '.pdf', ' (' || (r - 1) || ').pdf') END AS planned FROM n""",
)
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%s/n%d.pdf", "c_mktsegment", "c_nationkey").alias("path"))
    return ids.planned_paths(rows, "path", "c_custkey").select("c_custkey", "planned")


@query(
    "primary_paths",
    """WITH f AS (SELECT sha256(text) AS sha256, source || '/' || doc_id AS path FROM documents)
       SELECT sha256, path, min(path) OVER (PARTITION BY sha256) AS primary_path, path = min(path) OVER (PARTITION BY sha256) AS is_primary FROM f""",
)
def primary_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return ids.primary_paths(files)
