"""Proportional stratified interleaving: every shard gets each source's share of rows.

Rows are shuffled within their source by a seeded key and ranked; the fractional rank of a row is
(rank + phase of its source) / (rows of its source). All rows, sorted by fractional rank, are cut
into shards whose row counts differ by one at most (law ``rows``).

Ranks are found in two levels, so that neither a source with a third of all rows nor the whole
table is ever sorted in one task: rows are dealt over ranges of the key (then of the fractional
rank), ranked within a range, and lifted by the counts of the ranges before. Only ids, sizes and
keys are shuffled, never texts.

Defined results: a null or empty text has size 1 and crc 0; null sources form one source; null ids
and repeated rows are placed like any other row (equal rows are interchangeable); an empty table
gives an empty result; columns other than the four that are read are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import saved

#: Hex digits of a key that name its range, and the ranges of the fractional rank.
KEY_DIGITS, RANGES = 3, 4096


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot, position."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    stratum = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        stratum.alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    ).withColumn("part", F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("int"))
    rows = saved(narrow, "interleave")

    own = Window.partitionBy("stratum")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("stratum", "part").agg(F.count("*").alias("n")).select("stratum", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(own).alias("of"))
    within = Window.partitionBy("stratum", "part").orderBy("key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(parts, ["stratum", "part"])
    # the phase spreads sources of a single row over all shards
    phase = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum")).cast("binary")), 1, 6), 16, 10).cast("double") + 0.5) / 16777216
    spread = ranked.withColumn("at", (F.col("base") + F.col("rank") + phase) / F.col("of")).withColumn("range", F.floor(F.col("at") * RANGES).cast("int"))
    spread = saved(spread.select("doc_id", "source", "stratum", "size", "text_crc32", "key", "at", "range"), "interleave")

    # at most RANGES rows, so they fit one task and a broadcast
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = spread.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    order = Window.partitionBy("range").orderBy("at", "stratum", "key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = spread.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(ranges), "range").withColumn("position", F.col("base") + F.col("rank"))
    shard = F.expr(f"position * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("position") - first).cast("long")).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", "position")


def write_shards(placed: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes whole documents by shard, for ids that are unique: a shard's files, in order of their names, are in slot order.

    Rows are dealt over ranges of (shard, slot), so a shard is the work of as many tasks as it has ranges.
    """
    both = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
