"""Keyed upserts over snapshots: every change gives a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str], added: str, updated: str, now: Column) -> DataFrame:
    """new in place of old rows of the same key; the time of adding stays, that of updating is now."""
    columns = [c for c in old.columns if c not in (*key, added, updated)]
    a = old.select(*key, F.struct(*[F.col(c) for c in columns], added, updated).alias("o"))
    b = new.select(*key, F.struct(*[F.col(c) for c in columns]).alias("n"))
    joined = a.join(b, key, "full_outer")
    value = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(*key, *[value(c) for c in columns], F.coalesce(f"o.{added}", now).alias(added), F.when(F.col("n").isNotNull(), now).otherwise(F.col(f"o.{updated}")).alias(updated))


def filled(old: DataFrame, new: DataFrame, key: list[str], fill: list[str], union: list[str]) -> DataFrame:
    """Duplicates merged: missing fields are filled from new, lists are united in order."""
    b = new.select(*key, *[F.col(c).alias(f"_{c}") for c in fill + union])
    joined = old.join(b, key, "full_outer")
    empty = F.expr("cast(array() as array<string>)")
    return joined.select(*key, *[F.coalesce(c, f"_{c}").alias(c) for c in fill], *[F.array_sort(F.array_union(F.coalesce(c, empty), F.coalesce(f"_{c}", empty))).alias(c) for c in union])


def pruned(rows: DataFrame, keep: DataFrame, key: str, scope: str, scopes: DataFrame) -> DataFrame:
    """Rows without those that are in one of the scopes and whose key is not kept in that scope; the key's rows elsewhere stay."""
    closed = scopes.select(scope).distinct().withColumn("_in", F.lit(True))
    alive = keep.select(scope, key).distinct().withColumn("_kept", F.lit(True))
    marked = rows.join(closed, scope, "left").join(alive, [scope, key], "left")
    return marked.where("_in is null or _kept").select(*rows.columns)


def edited_tags(tags: Column, add: Column, remove: Column) -> Column:
    return F.array_sort(F.array_except(F.array_union(tags, add), remove))
