"""The provenance ledger: recorded inputs against what is there, reviews, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staleness(recorded: DataFrame, disk: DataFrame, key: str, sha: str) -> DataFrame:
    """Every recorded or present path: path, verdict (current, changed, missing or added)."""
    a = recorded.select(F.col(key).alias("path"), F.col(sha).alias("recorded"))
    b = disk.select(F.col(key).alias("path"), F.col(sha).alias("present"))
    joined = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "path", "full_outer")
    verdict = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "missing").when(F.col("recorded").eqNullSafe(F.col("present")), "current").otherwise("changed")
    return joined.select("path", verdict.alias("verdict"))


def status(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """no-provenance, up-to-date or stale, with counts, for each experiment."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v}")
    sums = verdicts.groupBy(*by).agg(n("current"), n("changed"), n("missing"), n("added"))
    told = F.when(F.col("n_current") + F.col("n_changed") + F.col("n_missing") == 0, "no-provenance").when(F.col("n_changed") + F.col("n_missing") + F.col("n_added") == 0, "up-to-date").otherwise("stale")
    return sums.withColumn("status", told)


def review_inputs(in_folder: DataFrame, declared: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """The union of both input sets: path, origin, present."""
    rows = in_folder.select(F.col(key).alias("path"), F.lit(1).alias("f"), F.lit(0).alias("d")).unionByName(declared.select(F.col(key).alias("path"), F.lit(0).alias("f"), F.lit(1).alias("d")))
    paths = rows.groupBy("path").agg(F.max("f").alias("f"), F.max("d").alias("d"))
    there = disk.select(F.col(key).alias("path")).distinct().withColumn("present", F.lit(True))
    origin = F.when((F.col("f") == 1) & (F.col("d") == 1), "both").when(F.col("f") == 1, "folder").otherwise("declared")
    return paths.join(there, "path", "left").select("path", origin.alias("origin"), F.coalesce("present", F.lit(False)).alias("present"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The ledger with the edges of new in place of old ones of the same artifact."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def read_contract(reads: DataFrame, path: str, own: Column) -> DataFrame:
    """Reads with the first rule they fall under: own-raw, own-data, off-data."""
    p = F.concat(F.lit("/"), F.col(path))
    rule = F.when(own & p.contains("/raw/"), "own-raw").when(own & p.contains("/data/"), "own-data").otherwise("off-data")
    return reads.withColumn("rule", rule)
