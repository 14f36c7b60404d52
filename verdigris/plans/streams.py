"""Streams over the driver's tables: files are read as they come, a file a batch, until none is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.plans.base import query, table
from verdigris.sources.kept import shared_folder
from verdigris.streaming import index


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may be a file, a plain path must be a folder


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_first_seen", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each content, kept over micro-batches by idempotent snapshots."""
    snapshots = index.Snapshots(spark)
    running = index.upserting(_events(spark, sf_dir), _checkpoint(spark), snapshots.merging(index.first_of("event_id", ["event_type", "user_id"])))
    running.awaitTermination()
    return snapshots.last(running, "event_type string, user_id bigint, event_id bigint")


@query("stream_distinct", "SELECT event_type, user_id FROM events GROUP BY event_type, user_id")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents that the deduplicating operator lets through; which row stands for each is left to the stream."""
    named = _events(spark, sf_dir).withColumn("content", F.concat_ws("/", "event_type", F.col("user_id").cast("string"))).withColumn("at", F.col("ts").cast("timestamp"))
    at = f"{_checkpoint(spark)}-rows"
    kept = index.first_seen(named, "content", "at", "3650 days").select("event_type", "user_id")
    kept.writeStream.format("parquet").option("path", at).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, user_id bigint").parquet(at)


@query(
    "snapshot_changes",
    """WITH o AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 1 THEN upper(c_name) ELSE c_name END AS v FROM customer WHERE c_custkey % 6 <> 0)
       SELECT c_custkey, change, 'day2' AS at FROM (SELECT coalesce(o.k, n.k) AS c_custkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v <> n.v THEN 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k) WHERE change IS NOT NULL""",
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = rows.where("c_custkey % 6 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 4 == 1, F.upper("c_name")).otherwise(F.col("c_name")))
    return index.change_log(rows.where("c_custkey % 5 <> 0"), new, "c_custkey", "day2")
