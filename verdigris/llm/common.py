"""What the operators of this package share: the shared folder, saved tables and bounded Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.kept import shared_folder as shared_dir

#: Rows and bytes of an Arrow batch for Python at most; a single row may be larger.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def write_table(df: DataFrame, label: str, codec: str = "zstd") -> str:
    """Writes a table to the shared folder; returns where."""
    at = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(at)
    return at


def saved(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label, codec))


class Scratch:
    """Saved tables of one computation, which go when its result has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        return self.hold((at := write_table(df, label), self.spark.read.schema(df.schema).parquet(at)))

    def hold(self, made: tuple[str, DataFrame]) -> DataFrame:
        """Takes over a table that was saved as (path, table)."""
        at, out = made
        self.paths[id(out)] = (at, out)  # the frame is held, so that its id stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables; nothing may read them any more."""
        for table in tables:
            at = self.paths.pop(id(table))[0]
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        self.drop(*[table for _, table in list(self.paths.values())])


def small_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches that Python gets small; lower settings of the user stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches. work: from an iterator of record batches to an iterator of record batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of these names (in any case), so that an operator's own can take their place."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def kept_rows(df: DataFrame, keep, column: str) -> DataFrame:
    """The rows, all columns unchanged, for which keep() says so. keep: makes, once for a task, a function from a value of the column to a boolean."""

    def work(batches):
        good = keep()
        for batch in batches:
            yield batch.filter(pa.array([good(x) for x in batch.column(column).to_pylist()], pa.bool_()))

    return map_batches(df, work, df.schema)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
