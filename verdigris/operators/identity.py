"""Identity: copies by content, matches by prioritised keys, duplicate clusters, citekeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import ordinal_suffix
from verdigris.sources.kept import kept_table


def byte_groups(rows: DataFrame, content: str, key: str) -> DataFrame:
    """A row for each copy: key, the content's hash, the first key as primary_id, n_copies. A group is never held whole."""
    hashed = rows.select(F.col(key), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    groups = hashed.groupBy("sha256").agg(F.min(key).alias("primary_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return hashed.join(groups, "sha256")


def first_match(candidates: DataFrame, catalog: DataFrame, keys: list[Column], key: str) -> DataFrame:
    """For each candidate the match of its first key that has one: candidate, match, priority.

    Keys are expressions over either table; null and empty keys match nothing. Only keys are
    shuffled, and the catalog has one row for each key value before the join.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(k).alias("priority"), x.cast("string").alias("value")) for k, x in enumerate(keys, 1)])
        rows = df.select(F.col(key).alias(name), F.explode(parts).alias("k"))
        return rows.select(name, "k.priority", "k.value").where("value is not null and value <> ''")

    known = keyed(catalog, "match").groupBy("priority", "value").agg(F.min("match").alias("match"))
    found = keyed(candidates, "candidate").join(known, ["priority", "value"])
    best = found.groupBy("candidate").agg(F.min(F.struct("priority", "match")).alias("best"))
    return best.select("candidate", F.col("best.match").alias("match"), F.col("best.priority").cast("int").alias("priority"))


def clusters(rows: DataFrame, keys: list[Column], key: str) -> DataFrame:
    """Groups with more than one member by any key; of groups with equal members the first key's stays.

    A row for each member: cluster (the smallest member), by (which key), member, n. A group is known
    by its size, its extremes and sums of two hashes of its members, so none is ever held whole.
    """
    parts = F.array(*[F.struct(F.lit(k).alias("by"), x.cast("string").alias("value")) for k, x in enumerate(keys, 1)])
    keyed = rows.select(F.col(key).alias("member"), F.explode(parts).alias("k")).select("member", "k.by", "k.value").where("value is not null and value <> ''").distinct()
    sums = [F.sum(F.xxhash64("member", F.lit(salt)).cast("decimal(38,0)")).alias(f"s{salt}") for salt in (1, 2)]
    groups = keyed.groupBy("by", "value").agg(F.count("*").alias("n"), F.min("member").alias("cluster"), F.max("member").alias("last"), *sums).where("n > 1")
    chosen = groups.groupBy("n", "cluster", "last", "s1", "s2").agg(F.min(F.struct("by", "value")).alias("g")).select("cluster", "n", "g.by", "g.value")
    return keyed.join(chosen, ["by", "value"]).select("cluster", F.col("by").cast("int").alias("by"), "member", "n")


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Rows with their number (from 1) among those of the same ``by``, in the given order.

    Rows are dealt over ranges of (by, order), so that one value with a third of all rows fills many
    tasks; a range's numbers are lifted by the counts of the ranges before it.
    """
    ranged = kept_table(rows.repartitionByRange(F.col(by).asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id()), "numbered")
    inside = Window.partitionBy(by, "_range").orderBy(*order)
    before = Window.partitionBy("_by").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a value
    bases = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r"))
    return ranged.withColumn("_place", F.row_number().over(inside)).join(bases, met).withColumn(name, F.col("_base") + F.col("_place")).drop("_range", "_by", "_r", "_n", "_base", "_place")


def citekeys(rows: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """Rows with the base and a unique citekey: holders of one base are numbered in the given order."""
    held = numbered(rows.withColumn("citekey_base", base), "citekey_base", order, "holder")
    return held.withColumn("citekey", F.concat("citekey_base", ordinal_suffix(F.col("holder")))).drop("holder")


def primary_paths(files: DataFrame, sha: str = "sha256", path: str = "path", order: str | None = None) -> DataFrame:
    """A row for each path of each content: sha, path, primary_path, is_primary. The one that came first (by order, else by path) is primary."""
    named = files.groupBy(sha, path).agg(F.min(order or path).alias("_at"))
    first = named.groupBy(sha).agg(F.min(F.struct("_at", F.col(path).alias("primary_path"))).alias("f")).select(sha, "f.primary_path")
    return named.join(first, sha).select(sha, path, "primary_path", (F.col(path) == F.col("primary_path")).alias("is_primary"))


def planned_paths(rows: DataFrame, path: str, citekey: str) -> DataFrame:
    """Paths made unique: the plain one, then with the citekey, then with a number."""
    stem, dot = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    tag = F.when(F.col("at") == 1, "").when(F.col("at") == 2, F.concat(F.lit(" ("), F.col(citekey), F.lit(")"))).otherwise(F.concat(F.lit(" ("), (F.col("at") - 1).cast("string"), F.lit(")")))
    return numbered(rows, path, [citekey], "at").withColumn("planned", F.concat(stem, tag, dot)).drop("at")
