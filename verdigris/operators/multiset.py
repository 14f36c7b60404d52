"""Multisets of cells and measurements: counts, what is lost and what is new, coverage, tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import cell_key, close


def melted(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Long form: ids, name, value (as text)."""
    return rows.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(ids, columns, "name", "value")


def counts(rows: DataFrame, key: Column, by: list[str] | None = None) -> DataFrame:
    """How often each key occurs; null keys do not count."""
    return rows.select(*(by or []), key.alias("key")).where("key is not null").groupBy(*(by or []), "key").agg(F.count("*").alias("n"))


def difference(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """max(0, left - right) for every key of left: by, key, n, found, lost; only what is lost."""
    joined = left.join(right.select("key", F.col("n").alias("found")), "key", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return joined.select(*(by or []), "key", "n", "found", F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("found")).alias("lost")).where("lost > 0")


def coverage(legacy: DataFrame, universe: DataFrame, by: str) -> DataFrame:
    """For each legacy file its cells, how many the universe lacks, and the distinct keys among these. Both: value, legacy with by."""
    have = counts(legacy, cell_key(F.col("value")), [by])
    there = counts(universe, cell_key(F.col("value"))).withColumnRenamed("n", "found")
    lost = F.greatest(F.lit(0).cast("long"), F.col("n") - F.coalesce("found", F.lit(0)))
    return have.join(there, "key", "left").groupBy(by).agg(F.sum("n").alias("n_cells"), F.sum(lost).alias("n_lost"), F.count_if(lost > 0).alias("n_keys_lost"))


def positional(rows: DataFrame, within: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Numbers rows from 0 within their table, for comparing by position."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)


def tolerance_compare(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], rtol: float = 1e-3, atol: float = 1e-6) -> DataFrame:
    """For each column: rows compared, exactly equal, equal within tolerance, different."""
    a, b = left.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns]), right.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, on)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in columns])).alias("p")
    long = both.select(pairs).select("p.name", "p.a", "p.b")
    exact, near = F.col("a") == F.col("b"), close(F.col("a"), F.col("b"), rtol, atol)
    return long.groupBy("name").agg(F.count("*").alias("n"), F.count_if(exact).alias("n_exact"), F.count_if(near & ~exact).alias("n_close"), F.count_if(~near).alias("n_different"))


def typed_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Whether a column of texts is an identifier (whole numbers with a leading zero or blanks), a number, or text."""
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "name", "value")
    value = F.coalesce("value", F.lit(""))
    blank, whole = value == "", value.rlike("^-?[0-9]+$")
    sums = long.groupBy("name").agg(F.count("*").alias("n"), F.count_if(blank).alias("n_blank"), F.count_if(whole).alias("n_whole"), F.count_if(value.rlike("^-?0[0-9]+$")).alias("n_leading_zero"))
    all_whole = (F.col("n_whole") + F.col("n_blank") == F.col("n")) & (F.col("n_whole") > 0)
    kind = F.when(~all_whole, "text").when((F.col("n_blank") > 0) | (F.col("n_leading_zero") > 0), "identifier").otherwise("integer")
    return sums.withColumn("kind", kind)
