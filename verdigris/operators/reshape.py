"""Wide and long forms of grouped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_names(rows: DataFrame, title: str, order: str) -> DataFrame:
    """Rows with sub_index, counted from 0 within a title, and name: title_index."""
    at = F.row_number().over(Window.partitionBy(title).orderBy(order)) - 1
    return rows.withColumn("sub_index", at.cast("long")).withColumn("name", F.concat_ws("_", title, F.col("sub_index").cast("string")))


def tidy(tables: DataFrame) -> DataFrame:
    """Grouped tables (title, x array, ys array of struct(title, subs array of array)) as long rows.

    Untitled groups and blank cells are skipped; an x column that is too short gives ''.
    """
    ys = tables.select("title", "x", F.posexplode("ys").alias("y_at", "y")).where("y.title is not null and y.title <> ''")
    subs = ys.select("title", "x", F.col("y.title").alias("group"), F.posexplode("y.subs").alias("replicate", "cells"))
    cells = subs.select("title", "x", "group", "replicate", F.posexplode("cells").alias("row", "value")).where("value is not null and value <> ''")
    return cells.select("title", "group", F.coalesce(F.get("x", F.col("row")), F.lit("")).alias("x"), "replicate", "row", "value")


def wide(tables: DataFrame) -> DataFrame:
    """The same tables as header and rows: an index or the x values, then every sub-column under a running number; short columns are padded with ''."""
    columns = F.flatten(F.transform("ys", lambda y: F.transform(y.subs, lambda s: F.struct(y.title.alias("title"), s.alias("cells")))))
    flat = tables.select("title", "x", columns.alias("columns"))
    height = F.greatest(F.size("x"), F.coalesce(F.array_max(F.transform("columns", lambda c: F.size(c.cells))), F.lit(0)))
    header = F.concat(F.array(F.lit("")), F.transform("columns", lambda c, k: F.concat(F.coalesce(c.title, F.lit("")), F.lit("_"), k.cast("string"))))
    body = F.transform(
        F.sequence(F.lit(0), F.col("height") - 1),
        lambda r: F.concat(F.array(F.when(F.size("x") == 0, r.cast("string")).otherwise(F.coalesce(F.get(F.col("x"), r), F.lit("")))), F.transform("columns", lambda c: F.coalesce(F.get(c.cells, r), F.lit("")))),
    )
    return flat.withColumn("height", height).select("title", header.alias("header"), F.when(F.col("height") > 0, body).otherwise(F.expr("cast(array() as array<array<string>>)")).alias("rows"))
