"""Search and facets on the driver's tables. Scores are compared in millionths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import text as fn
from verdigris.operators import retrieval as rt
from verdigris.plans.base import query, table

TERMS = ["the", "tion", "una", "und"]
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_IDF = [f"ln(1 + (n_docs - df_{k} + 0.5) / (df_{k} + 0.5)) * tf_{k}::DOUBLE * 2.2 / (tf_{k}::DOUBLE + 1.2 * (0.25 + 0.75 * length / mean))" for k in range(len(TERMS))]
_BM25 = f"""w AS (SELECT doc_id, {_TOKENS} AS words FROM documents), c AS (SELECT doc_id, len(words) AS length, {', '.join(f"len(list_filter(words, lambda x: x = '{t}')) AS tf_{k}" for k, t in enumerate(TERMS))} FROM w),
  s AS (SELECT count(*) AS n_docs, avg(length) AS mean, {', '.join(f'count(*) FILTER (tf_{k} > 0) AS df_{k}' for k in range(len(TERMS)))} FROM c),
  b AS (SELECT doc_id, {' + '.join(_IDF)} AS score FROM c, s WHERE greatest({', '.join(f'tf_{k}' for k in range(len(TERMS)))}) > 0)"""


def _micro(column: str = "score") -> F.Column:
    return F.floor(F.col(column) * 1_000_000 + 0.5).cast("long")


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, floor(score * 1000000 + 0.5)::BIGINT AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 8")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rt.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return rt.top(scored, "doc_id").select("doc_id", _micro().alias("score"))


_COS = "v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS score FROM embeddings)"


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query_vector = vectors.orderBy("vec_id").select("embedding").first()[0]
    return rt.nearest(vectors, "vec_id", "embedding", query_vector)


@query("vector_topk", f"WITH {_COS} SELECT vec_id, floor(score * 1000000 + 0.5)::BIGINT AS score FROM v ORDER BY v.score DESC, vec_id LIMIT 8")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.top(_nearest(spark, sf_dir), "vec_id").select("vec_id", _micro().alias("score"))


#: A vector's document is the one of the same id: embeddings are of documents.
_RANKS = f"""{_BM25}, {_COS}, r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) FROM v),
  f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score FROM r GROUP BY id)"""


@query("rank_fusion", f"WITH {_RANKS} SELECT id, floor(score * 1000000 + 0.5)::BIGINT AS score FROM f ORDER BY f.score DESC, id LIMIT 8")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = rt.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS).withColumnRenamed("doc_id", "id")
    dense = _nearest(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return rt.fused([rt.ranked_all(lexical, "id"), rt.ranked_all(dense, "id")], "id").select("id", _micro().alias("score"))


_CHUNKS = r"""p AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p, ' ') <> '') AS ps FROM documents)),
  s AS (SELECT doc_id, i, j, substr(p, j * 2000 + 1, 2000) AS t FROM (SELECT *, unnest(range(ceil(length(p) / 2000.0)::BIGINT)) AS j FROM p)),
  c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM s),
  n AS (SELECT count(*) AS n_chunks, avg(len(words)) AS mean FROM c),"""
_CHUNKED = _CHUNKS + """
  x AS (SELECT doc_id, chunk_index, len(words) AS length, term, len(list_filter(words, lambda w: w = term)) AS tf FROM c, (VALUES ('the'), ('tion'), ('una'), ('und')) AS q(term)),
  d AS (SELECT term, count(*) AS df FROM x WHERE tf > 0 GROUP BY term),
  b AS (SELECT doc_id, chunk_index, sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf::DOUBLE * 2.2 / (tf::DOUBLE + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM x JOIN d USING (term), n WHERE tf > 0 GROUP BY doc_id, chunk_index)"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = rt.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rt.postings(chunks), rt.chunk_statistics(chunks)


@query("chunk_search", f"WITH {_CHUNKED}, h AS (SELECT doc_id, max(struct_pack(s := score, c := -chunk_index)) AS h FROM b GROUP BY doc_id) SELECT doc_id AS document, -h.c AS chunk_index, floor(h.s * 1000000 + 0.5)::BIGINT AS score FROM h")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a term, by its best chunk."""
    index, statistics = _index(spark, sf_dir)
    best = rt.best_chunks(rt.bm25_postings(index, statistics, TERMS))
    return best.select("document", F.col("chunk_index").cast("long").alias("chunk_index"), _micro().alias("score"))


@query(
    "hybrid_query",
    f"""WITH {_CHUNKED}, {_COS}, k AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')), h AS (SELECT doc_id AS id, max(score) AS score FROM b GROUP BY doc_id),
       r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM h WHERE id IN (SELECT doc_id FROM k) UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) FROM v WHERE vec_id IN (SELECT doc_id FROM k)),
       f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 8)
       SELECT id AS document, floor(score * 1000000 + 0.5)::BIGINT AS score, lang AS kind, CASE WHEN quality = 1 THEN 'passed' WHEN quality = 0 THEN 'failed' END AS outcome FROM f JOIN documents ON doc_id = id LEFT JOIN labels l ON l.doc_id = id""",
)
def hybrid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two kinds by chunk scores and vectors, with the outcomes that their labels tell."""
    index, statistics = _index(spark, sf_dir)
    lexical = rt.best_chunks(rt.bm25_postings(index, statistics, TERMS))
    dense = _nearest(spark, sf_dir).withColumnRenamed("vec_id", "document")
    outcome = F.when(F.col("quality") == 1, "passed").when(F.col("quality") == 0, "failed")
    records = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("document"), F.col("lang").alias("kind"), outcome.alias("outcome"))
    return rt.hybrid(lexical, dense, records, ["en", "de"]).withColumn("score", _micro())


@query(
    "facet_counts",
    """SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY lang UNION ALL
       SELECT 'source', source, count(*) FROM documents WHERE lang = 'en' GROUP BY source UNION ALL
       SELECT 'size', CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS v, count(*) FROM documents WHERE lang = 'en' AND source = 'src3' GROUP BY v""",
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("size", F.when(F.col("n_chars") < 1000, "short").otherwise("long"))
    return rt.facets(docs, ["lang", "source", "size"], {"lang": "en", "source": "src3"})


@query("multi_term_and", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'and')")
def multi_term_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(fn.all_terms(F.col("text"), "The tion  and")).select("doc_id")


@query(
    "metadata_search",
    """SELECT doc_id FROM documents WHERE lang = 'de' AND contains(lower(concat_ws(' ', source, lang, text)), 'ung')""",
)
def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return table(spark, sf_dir, "documents").where(fn.matches_filter(F.col("lang"), "de") & F.contains(hay, F.lit("ung"))).select("doc_id")


@query(
    "leading_text",
    """WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE turn < 2)
       SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn = k), '') AS text FROM c GROUP BY conv_id""",
)
def leading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.leading_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2)


@query("chunk_counts", r"""WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p, ' ') <> '')) AS p FROM documents)
SELECT doc_id AS document, sum(ceil(length(p) / 2000.0))::BIGINT AS n_paragraphs FROM p GROUP BY doc_id""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.chunked(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("document").agg(F.count("*").alias("n_paragraphs"))


_OVERLAP = """t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4)) AS words FROM benchmark),
  p AS (SELECT item_id, doc_id, len(list_filter(words, lambda w: contains(lower(d.text), w))) AS hit, len(words) AS n FROM t CROSS JOIN documents d WHERE n > 0)"""


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.overlaps(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark").withColumnRenamed("text", "title"), "item_id", "title")


@query("title_overlap", f"WITH {_OVERLAP} SELECT item_id, doc_id, floor(hit / n * 1000000 + 0.5)::BIGINT AS score FROM p WHERE hit / n >= 0.3")
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).where("score >= 0.3").select("item_id", "doc_id", _micro().alias("score"))


@query(
    "verify_first",
    f"""WITH {_OVERLAP} SELECT item_id, min(doc_id) FILTER (hit / n >= 0.34) AS first_verified, arg_max(doc_id, struct_pack(s := hit / n, d := -doc_id)) AS best FROM p GROUP BY item_id""",
)
def verify_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _overlaps(spark, sf_dir)
    return scored.groupBy("item_id").agg(F.min(F.when(F.col("score") >= 0.34, F.col("doc_id"))).alias("first_verified"), F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("best"))


@query(
    "list_newest",
    "SELECT user_id, event_id, r::INTEGER AS r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3",
)
def list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(newest).alias("r")).where("r <= 3")
