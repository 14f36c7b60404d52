"""An incremental index over files or rows that arrive: the first of each content is primary."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.sources.kept import shared_folder


def first_seen(stream: DataFrame, content: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose content has not been seen within the delay; state is dropped behind the watermark."""
    hashed = stream.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["sha256"])


def upserting(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands every micro-batch to a merge, which must give the same snapshot for a batch that comes again."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Snapshots:
    """Snapshots of a table by batch: each is written whole from the one before and the batch, so a batch that comes again gives the same."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"

    def at(self, batch: int) -> str:
        return f"{self.folder}/{batch:09d}"

    def merging(self, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        def merge(batch: DataFrame, n: int) -> None:
            spark = batch.sparkSession
            old = spark.read.parquet(self.at(n - 1)) if n else None
            fold(old, batch).write.mode("overwrite").parquet(self.at(n))

        return merge

    def last(self, query: StreamingQuery, schema: str) -> DataFrame:
        """The snapshot that a finished query has left; an empty table if nothing came."""
        done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
        return self.spark.read.parquet(self.at(max(done))) if done else self.spark.createDataFrame([], schema)


def first_of(key: str, by: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Folds batches into the smallest key of each content: by, key."""

    def fold(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.select(*by, key) if old is None else batch.select(*by, key).unionByName(old)
        return rows.groupBy(*by).agg(F.min(key).alias(key))

    return fold


def change_log(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """What a snapshot changes, as rows to append: key, change (added, changed or removed), at. Rows are compared by all their columns."""
    told = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256).alias(name))
    joined = told(old, "a").join(told(new, "b"), key, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return joined.select(key, change.alias("change"), F.lit(at).alias("at")).where("change is not null")
