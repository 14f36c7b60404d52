"""What plans read: edges of derived tables, reads outside of what is tracked, claims as queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.claims import outcome_of

TRACKED = [".csv", ".tsv", ".xlsx", ".xls", ".parquet", ".json"]


def read_files(df: DataFrame) -> list[str]:
    """The files that a table's plan reads, as its sources list them, in order."""
    return sorted(re.sub("^file:/+", "/", f) for f in df.inputFiles())


def edges_of(spark: SparkSession, artifact: str, table: DataFrame, recipe: str | None = None) -> DataFrame:
    """The ledger's edges of a derived table: artifact, path, sha256, a row for each file that its plan reads and one for its recipe."""
    paths = read_files(table) + ([recipe] if recipe else [])
    if not paths:
        return spark.createDataFrame([], "artifact string, path string, sha256 string")
    return spark.read.format("binaryFile").load(paths).select(F.lit(artifact).alias("artifact"), F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"))


def derived(spark: SparkSession, artifact: str, make: Callable[..., DataFrame], *tables: DataFrame, recipe: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A derivation: the table that ``make`` makes of others, and its edges, which are read off the plan, so none is forgotten."""
    out = make(*tables)
    return out, edges_of(spark, artifact, out, recipe)


def bypasses(read: list[str], root: str, declared: list[str]) -> list[str]:
    """Tracked kinds of files under the root that were read without being declared; files elsewhere are nobody's business."""
    inside = root.rstrip("/") + "/"
    return sorted(p for p in set(read) - set(declared) if p.startswith(inside) and any(p.lower().endswith(s) for s in TRACKED))


def claim(name: str, violations: DataFrame, strength: str | None = None, expected_failure: bool = False, skipped: bool = False) -> DataFrame:
    """A claim as a query: it holds if the query of its violations is empty. One row: claim_id, outcome, strength, n_violations."""
    n = violations.agg(F.count("*").alias("n_violations"))
    outcome = outcome_of(F.col("n_violations") > 0, F.lit(expected_failure), F.lit(skipped))
    return n.select(F.lit(name).alias("claim_id"), outcome.alias("outcome"), F.lit(strength).cast("string").alias("strength"), "n_violations")
