"""Queries over ids beyond those of the driver's small tables, held against DuckDB."""

import __spark_entry__
import duckdb
import pytest
from pyspark.sql import functions as F

from verdigris.operators import ingest


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    """Documents with ids of four to seven digits; numbers that names cut are shared by several."""
    at = str(tmp_path_factory.mktemp("papers"))
    ids = spark.range(9_900, 10_300).union(spark.range(99_000, 101_000)).union(spark.range(999_900, 1_001_000))
    ids.select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("source"), F.lit(6).cast("long").alias("n_chars")).write.parquet(f"{at}/documents.parquet")
    return at


def held(spark, at, name):
    """Rows of a query and of its SQL."""
    df = __spark_entry__.queries()[name](spark, at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(found, key=repr)


def test_a_source_has_one_row_whatever_its_routes(spark):
    sources = spark.createDataFrame([("in/a.pdf",), ("in/b.pdf",)], "source string")
    routes = spark.createDataFrame([("a.pdf", "reports"), ("a.pdf", "protocol"), ("a.pdf", "reports")], "name string, folder string")
    assert sorted((r.source, r.folder, r.routed_by) for r in ingest.routed(sources, routes).collect()) == [("in/a.pdf", "protocol", "agent"), ("in/b.pdf", "raw", "default")]


def test_routing_summary(spark, papers):
    got, told = held(spark, papers, "routing_summary")
    assert got == told


def test_intakes_are_told_apart(spark):
    sources = spark.createDataFrame([(1, "in/a.pdf"), (2, "in/a.pdf"), (3, "in/a.pdf")], "batch int, source string")
    routes, there = spark.createDataFrame([(2, "a.pdf", "reports")], "batch int, name string, folder string"), spark.createDataFrame([(1, "raw/a.pdf"), (2, "raw/a.pdf")], "batch int, path string")
    plan = ingest.routed(sources, routes, there, ["batch"])
    assert sorted((r.batch, r.dest, r.routed_by, r.taken) for r in plan.collect()) == [(1, "raw/a.pdf", "default", True), (2, "reports/a.pdf", "agent", False), (3, "raw/a.pdf", "default", False)]


def test_intake_plan(spark, papers):
    got, told = held(spark, papers, "intake_plan")
    assert got == told


def test_filename_sniff(spark, papers):
    got, told = held(spark, papers, "filename_sniff")
    assert got == told
    ids = {r[0]: r[1] for r in got}
    assert (ids[99_001], ids[100_003], ids[100_002], ids[1_000_002]) == ("doi=10.1038/nbt.9900", "", "doi=10.1038/s41598-024-10000-6", "")
