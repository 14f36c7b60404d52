"""Checks: findings are rows of subject, check and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(rows: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a subject breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select(F.col(subject).alias("subject"), F.explode(found).alias("flag"))


def redundant(members: DataFrame, archive: str, member: str, there: DataFrame) -> DataFrame:
    """Archives all of whose members exist outside: archive, n_members."""
    have = there.select(member).distinct().withColumn("_there", F.lit(True))
    joined = members.join(have, member, "left").groupBy(archive).agg(F.count("*").alias("n_members"), F.bool_and(F.col("_there").isNotNull()).alias("all_there"))
    return joined.where("all_there").drop("all_there")


def regenerated(recorded: DataFrame, produced: DataFrame, key: str, value: str, near: Column) -> DataFrame:
    """Recorded against produced artifacts: exact, approx, mismatch, not-regenerated or unrecorded. near compares a and b."""
    joined = recorded.select(key, F.col(value).alias("a"), F.lit(1).alias("_a")).join(produced.select(key, F.col(value).alias("b"), F.lit(1).alias("_b")), key, "full_outer")
    verdict = F.when(F.col("_b").isNull(), "not-regenerated").when(F.col("_a").isNull(), "unrecorded").when(F.col("a") == F.col("b"), "exact").when(near, "approx").otherwise("mismatch")
    return joined.select(key, verdict.alias("verdict"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two runs gave the same rows, as multisets."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
