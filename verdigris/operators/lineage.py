"""Transitive closure and traces over provenance edges.

Edges are (child, parent): what an artifact was made from. The frontier is joined with the edges
level by level; pairs already seen are dropped, so cycles and wide diamonds end, and the frontier is
written to the shared folder each round, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.kept import kept_table


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): every node that a root reaches, at its least depth; the root itself at 0."""
    edges = kept_table(edges.select("child", "parent").distinct(), "lineage")
    front = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0))
    seen = front = kept_table(front, "lineage")
    depth = 0
    while front.take(1):  # pairs are finite and none comes twice
        depth += 1
        step = front.join(edges, front.node == edges.child).select("root", F.col("parent").alias("node")).distinct()
        front = kept_table(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
        seen = seen.unionByName(front)
    return seen


def reaching(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(node): every node from which one of the goals is reached, these included: one row a node, whatever the paths."""
    edges = kept_table(edges.select("child", "parent").distinct(), "lineage")
    seen = front = kept_table(goals.select("node").distinct(), "lineage")
    while front.take(1):
        step = front.join(edges, front.node == edges.parent).select(F.col("child").alias("node")).distinct()
        front = kept_table(step.join(seen, "node", "left_anti"), "lineage")
        seen = seen.unionByName(front)
    return seen


def closure_sql(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The same for trees of at most 100 levels, as one recursive query; a deeper one is an error.

    Spark's limit of rows is lifted for the session: the levels bound the walk, and rows grow with the roots.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    edges.createOrReplaceTempView("_lineage_edges")
    roots.createOrReplaceTempView("_lineage_roots")
    return spark.sql(
        """WITH RECURSIVE walk(root, node, depth) AS (
             SELECT node, node, 0 FROM _lineage_roots
             UNION ALL SELECT root, parent, depth + 1 FROM walk JOIN _lineage_edges ON node = child)
           SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node"""
    )


def trace(edges: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Breaks on the way from each root: root, node, kind.

    nodes: node, present, raw, drifted. A node that is not there is missing, one whose content is not
    as recorded is drifted, and one that is neither raw nor made from anything is unsourced. Only broken
    nodes are walked from, towards the roots: sound chains cost nothing.
    """
    known = edges.select(F.col("child").alias("node")).withColumn("made", F.lit(True)).union(edges.select("parent", F.lit(False))).union(roots.select("node", F.lit(False))).groupBy("node").agg(F.bool_or("made").alias("made"))
    kind = F.when(~F.coalesce("present", F.lit(False)), "missing").when(F.col("drifted"), "drifted").when(~F.col("made") & ~F.coalesce("raw", F.lit(False)), "unsourced")
    broken = kept_table(known.join(nodes, "node", "left").select("node", kind.alias("kind")).where("kind is not null"), "lineage")
    walked = closure(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), broken)
    met = walked.select(F.col("root").alias("broken"), F.col("node").alias("root")).join(roots.select(F.col("node").alias("root")).distinct(), "root")
    return met.join(broken.withColumnRenamed("node", "broken"), "broken").select("root", F.col("broken").alias("node"), "kind")


def verdicts(roots: DataFrame, breaks: DataFrame, sound: DataFrame) -> DataFrame:
    """For each root: breaks, status (any break: BROKEN), reaches_raw and the stricter status_strict. sound: nodes that reach raw."""
    n = breaks.groupBy("root").agg(F.count("*").alias("n_breaks"))
    raw = sound.select(F.col("node").alias("root")).distinct().withColumn("reaches_raw", F.lit(True))
    joined = roots.select(F.col("node").alias("root")).distinct().join(n, "root", "left").join(raw, "root", "left")
    n_breaks, reaches = F.coalesce("n_breaks", F.lit(0).cast("long")), F.coalesce("reaches_raw", F.lit(False))
    return joined.select("root", n_breaks.alias("n_breaks"), F.when(n_breaks > 0, "BROKEN").otherwise("GROUNDED").alias("status"), reaches.alias("reaches_raw"), F.when((n_breaks > 0) | ~reaches, "BROKEN").otherwise("GROUNDED").alias("status_strict"))
