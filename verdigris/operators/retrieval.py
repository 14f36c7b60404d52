"""Retrieval: chunks, postings, BM25, cosine, rank fusion, facets.

Choices of ours, from published work: BM25 with k1 = 1.2, b = 0.75 and idf = ln(1 + (N - n + 0.5) / (n + 0.5))
(Robertson and Zaragoza 2009); reciprocal rank fusion with constant 60 (Cormack, Clarke and Büttcher
2009); tokens are lower-cased runs of letters and digits; chunks are paragraphs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

K1, B, FUSION = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def chunked(docs: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    """Paragraphs, cut at ``most`` characters: document, chunk_index, text."""
    paragraphs = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))))
    return docs.select(F.col(key).alias("document"), F.posexplode(pieces).alias("chunk_index", "text"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """Scores of the documents that have a term of the query: key, score. One pass counts terms and lengths, so only matching postings are shuffled."""
    words = docs.select(key, tokens(F.col(text)).alias("words")).withColumn("length", F.size("words"))

    def times(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w == term))

    counts = [times(t).alias(f"tf_{k}") for k, t in enumerate(query)]
    counted = words.select(key, "length", *counts)
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(len(query))])
    score = F.lit(0.0)
    for k in range(len(query)):
        idf = F.log(1 + (F.col("n_docs") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5))
        tf = F.col(f"tf_{k}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hit = F.greatest(*[F.col(f"tf_{k}") for k in range(len(query))], F.lit(0)) > 0
    return counted.where(hit).join(F.broadcast(stats)).select(key, score.alias("score"))  # stats: one row


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """Cosine similarity of every vector to the query: key, score."""
    return vectors.select(key, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))


def top(scored: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The k best with their rank; ties go to the smaller key."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fused(ranked: list[DataFrame], key: str, k: int = 8) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank)."""
    rows = ranked[0].select(key, "rank")
    for more in ranked[1:]:
        rows = rows.unionByName(more.select(key, "rank"))
    return top(rows.groupBy(key).agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score")), key, k)


def facets(rows: DataFrame, columns: list[str], selected: dict[str, str]) -> DataFrame:
    """Counts of each facet's values under the selections of all other facets: facet, value, n. One pass: a row counts for every facet whose other selections it meets."""
    entries = []
    for c in columns:
        met = F.lit(True)
        for other, value in selected.items():
            if other != c:
                met = met & F.coalesce(F.col(other).cast("string") == value, F.lit(False))
        entries.append(F.when(met, F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))))
    return rows.select(F.explode(F.array_compact(F.array(*entries))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def leading_text(chunks: DataFrame, key: str, index: str, text: str, n: int) -> DataFrame:
    """The first n chunks joined, up to the first gap."""
    first = chunks.where(F.col(index) < n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), F.col(text).alias("t")))).alias("c"))
    unbroken = F.filter("c", lambda x, k: x.i == k)
    return first.select(key, F.array_join(F.transform(unbroken, lambda x: x.t), "\n").alias("text"))


def overlap(title: Column, content: Column, least: int = 4) -> Column:
    """Share of the title's longer words that the content contains anywhere."""
    words = F.array_distinct(F.filter(tokens(title), lambda w: F.length(w) >= least))
    low = F.lower(content)
    return F.try_divide(F.size(F.filter(words, lambda w: F.contains(low, w))), F.size(words))


def overlaps(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, title: str, least: int = 4, remembered: int = 200_000) -> DataFrame:
    """``overlap`` of every item with every document: item, key, score; items without a longer word are left out.

    The items are a stated query set, which every worker holds. A title's word has letters and digits
    only, so a text contains it if one of the text's tokens does: the parts of each token are looked up
    among the words, and what was found is remembered by token.
    """
    told = items.select(item, F.array_distinct(F.filter(tokens(F.col(title)), lambda w: F.length(w) >= least)).alias("own")).where(F.size("own") > 0).collect()
    sent = docs.sparkSession.sparkContext.broadcast([(r[item], r.own) for r in told])
    kind = to_arrow_type(items.schema[item].dataType)

    def work(batches):
        told = sent.value
        number = {w: k for k, w in enumerate({w for _, own in told for w in own})}
        lengths = {len(w) for w in number}
        item_of = np.repeat(np.arange(len(told)), np.array([len(own) for _, own in told], np.int64))
        word_of = np.array([number[w] for _, own in told for w in own], np.int64)
        sizes, ids, seen = np.bincount(item_of, minlength=len(told)), pa.array([i for i, _ in told], kind), {}

        def within(token: str) -> set[int]:
            found = seen.get(token)
            if found is None:
                parts = {token[k : k + n] for n in lengths for k in range(len(token) - n + 1)}
                found = {number[w] for w in parts & number.keys()}
                if len(seen) < remembered:
                    seen[token] = found
            return found

        for whole in batches:
            step = max(1, 65_536 // max(1, len(told)))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                scores = np.zeros((batch.num_rows, len(told)))
                for row, spoken in zip(scores, batch.column("spoken").to_pylist(), strict=True):
                    has = np.zeros(len(number), bool)
                    has[list(set().union(*map(within, spoken.split(" "))))] = True
                    row[:] = np.bincount(item_of[has[word_of]], minlength=len(told)) / sizes
                of_doc = pa.array(np.repeat(np.arange(batch.num_rows), len(told)))
                of_item = pa.array(np.tile(np.arange(len(told)), batch.num_rows))
                yield pa.RecordBatch.from_arrays([ids.take(of_item), batch.column(key).take(of_doc), pa.array(scores.ravel())], [item, key, "score"])

    spoken = docs.select(key, F.array_join(F.array_distinct(tokens(F.col(text))), " ").alias("spoken"))
    return spoken.mapInArrow(work, T.StructType([items.schema[item], docs.schema[key], T.StructField("score", T.DoubleType())]))


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """The index of chunks (document, chunk_index, text): a row for each term of each chunk: term, document, chunk_index, tf, length. Written once, partitioned by ``bucket``, a query reads the buckets of its terms."""
    words = chunks.select("document", "chunk_index", tokens(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    terms = words.select("document", "chunk_index", "length", F.explode("words").alias("term"))
    return terms.groupBy("term", "document", "chunk_index").agg(F.count("*").alias("tf"), F.first("length").alias("length")).withColumn("bucket", bucket(F.col("term")))


def bucket(term: Column, n: int = 64) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n))


def chunk_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_chunks, mean length in terms."""
    return chunks.select(F.size(tokens(F.col(text))).alias("length")).agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean"))


def bm25_postings(index: DataFrame, statistics: DataFrame, query: list[str]) -> DataFrame:
    """Scores from postings: document, chunk_index, score. Only the query's terms are read; statistics are one row."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t,) for t in dict.fromkeys(query)], "term string")
    found = index.where(F.col("bucket").isin([r.b for r in wanted.select(bucket(F.col("term")).alias("b")).distinct().collect()]) & F.col("term").isin(list(dict.fromkeys(query))))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(df), "term").join(F.broadcast(statistics))  # a row for each term of the query, and one row
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("document", "chunk_index").agg(F.sum(score).alias("score"))


def best_chunks(scored: DataFrame) -> DataFrame:
    """The best chunk of each document: document, chunk_index, score."""
    return scored.groupBy("document").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("c"))).alias("b")).select("document", (-F.col("b.c")).alias("chunk_index"), "b.score")


def hybrid(lexical: DataFrame, dense: DataFrame, records: DataFrame, kinds: list[str] | None = None, k: int = 8) -> DataFrame:
    """The k best documents by fused ranks of two scored lists (document, score), of the given kinds only, with their records (document, kind, ...).

    The filter comes before the ranks. Every hit of either list has a rank; ranks of a list are places
    in its global order, found in ranges of the score, so no task sorts a list.
    """
    wanted = records if kinds is None else records.where(F.col("kind").isin(kinds))
    ids = wanted.select("document")
    lists = [ranked_all(scored.join(ids, "document", "left_semi").select("document", "score"), "document") for scored in (lexical, dense)]
    return fused(lists, "document", k).select("document", "score").join(wanted, "document")


def ranked_all(scored: DataFrame, key: str) -> DataFrame:
    """key, score, rank (from 1, by falling score, then key) of all rows: sorted by ranges, numbered within, lifted by the counts before."""
    from verdigris.sources.kept import kept_table

    dealt = kept_table(scored.repartitionByRange(F.desc("score"), F.col(key)).withColumn("_range", F.spark_partition_id()), "ranks")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), key))
    return dealt.withColumn("_place", place).join(F.broadcast(bases), "_range").select(key, "score", (F.col("_base") + F.col("_place")).alias("rank"))
