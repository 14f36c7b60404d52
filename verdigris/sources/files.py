"""Sources: folders of files, tables as text, archives, Prism containers, reports and ledgers.

Folders are read by Spark's binary source, with size and name filters before the content is touched.
Zipped Office formats are read by ``office``; other readers are given by the caller.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a walk skips, and the kinds of extensions and folders.
SKIPPED_FOLDERS = [".git", ".verdigris", "__pycache__", "node_modules", ".ipynb_checkpoints", ".venv", "venv", "site-packages"]
SKIPPED_SUFFIXES = [".dist-info", ".egg-info"]
TABULAR = [".csv", ".tsv", ".xlsx", ".xls"]
NARRATIVE = [".md", ".txt", ".pdf", ".docx", ".pptx", ".html"]
ROLES = ["raw", "data", "analysis", "reports"]
_TEXTS = T.ArrayType(T.StringType())
PRISM_TYPE = T.ArrayType(T.StructType().add("title", "string").add("x", _TEXTS).add("ys", T.ArrayType(T.StructType().add("title", "string").add("subs", T.ArrayType(_TEXTS)))))


def wanted(path: Column) -> Column:
    """Whether a walk takes a path: no caches, environments, lock or temporary files."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    cruft = name.isin(".DS_Store", "Thumbs.db") | name.startswith("~$") | name.startswith("._") | name.endswith(".tmp") | name.endswith(".crdownload")
    inside = F.exists(folders, lambda f: f.isin(SKIPPED_FOLDERS) | F.exists(F.array(*[F.lit(s) for s in SKIPPED_SUFFIXES]), lambda s: f.endswith(s)))
    return ~cruft & ~inside


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def kind_of(path: Column) -> Column:
    return F.when(extension(path).isin(NARRATIVE), "narrative").when(extension(path).isin(TABULAR), "tabular").otherwise("binary")


def role_of(relative: Column) -> Column:
    """What a file's place says: readme, the first standard folder, or other."""
    parts = F.split(F.lower(relative), "/")
    role = F.get(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(ROLES)), F.lit(0))
    return F.when(F.lower(relative) == "readme.md", "readme").otherwise(F.coalesce(role, F.lit("other")))


def walk(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Files under a folder: path, relative, size, kind, role and, if asked for, sha256 and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    base = root.split(":", 1)[-1].rstrip("/")
    found = files.where("length > 0").withColumn("relative", F.regexp_replace(plain, "^" + _quoted(base) + "/", ""))
    found = found.where(wanted(F.col("relative"))).select("path", "relative", F.col("length").alias("size"), kind_of(F.col("relative")).alias("kind"), role_of(F.col("relative")).alias("role"), "content")
    return found.withColumn("sha256", F.sha2("content", 256)) if content else found.drop("content")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in text)


def text_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table with all cells as text."""
    return spark.read.option("header", "true").option("sep", separator).option("multiLine", "true").option("escape", '"').csv(path, inferSchema=False)


def claims(spark: SparkSession, path: str) -> DataFrame:
    """The claims of grounding reports, either {"claims": [...]} or a bare list."""
    rows = spark.read.json(path, multiLine=True)
    return rows.select(F.explode("claims").alias("c")).select("c.*") if "claims" in rows.columns else rows


@F.pandas_udf(_TEXTS)
def zip_members(contents: pd.Series) -> pd.Series:
    """The real members of archives, null for what is none."""

    def names(data: bytes) -> list[str] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [n for n in z.namelist() if not n.endswith("/") and not n.startswith("__MACOSX") and not n.rsplit("/", 1)[-1].startswith(("._", ".DS_Store"))]
        except (zipfile.BadZipFile, TypeError):
            return None

    return contents.map(names)


def prism_container(content: Column) -> Column:
    """zip, binary or xml, by the first bytes."""
    first = F.hex(F.substring(content, 1, 8))
    return F.when(first.startswith("504B0304"), "zip").when(first.startswith("5043464647524134"), "binary").otherwise("xml")


def _xml_tables(data: bytes) -> Iterator[dict]:
    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    said = lambda e: "".join(e.itertext()).strip() if e is not None else ""
    for t in (e for e in ElementTree.fromstring(data).iter() if bare(e) in ("Table", "HugeTable")):
        child = lambda e, n: next((c for c in e if bare(c) == n), None)
        values = lambda column: [[said(d) for d in s if bare(d) == "d"] for s in column if bare(s) == "Subcolumn"]
        xs = [c for c in t if bare(c) in ("XColumn", "XAdvancedColumn")]
        x = next(iter(values(xs[0])), []) if xs else []
        yield {"title": said(child(t, "Title")), "x": x, "ys": [{"title": said(child(c, "Title")), "subs": values(c)} for c in t if bare(c) == "YColumn"]}


@F.pandas_udf(PRISM_TYPE)
def prism_xml(contents: pd.Series) -> pd.Series:
    """Tables of an XML container."""
    return contents.map(lambda data: list(_xml_tables(data)))


def reader(read: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """A text column from bytes by a given reader; what it can't read is null, so that one bad file stops no batch."""

    @F.pandas_udf(T.StringType())
    def texts(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                return read(data)
            except Exception:  # noqa: BLE001  any reader, any format
                return None

        return contents.map(one)

    return texts


def lookup(responses: DataFrame, requests: DataFrame, key: str, now: Column, ttl_seconds: int = 30 * 86_400) -> DataFrame:
    """Requests with fresh, successful responses (key, status, body, at) of a cache table; the rest have null."""
    fresh = responses.where((F.col("status") == 200) & (F.unix_timestamp(now) - F.unix_timestamp("at") < ttl_seconds))
    latest = fresh.groupBy(key).agg(F.max_by("body", "at").alias("body"))
    return requests.join(latest, key, "left")


def sidecar(text: str) -> dict:
    """A sidecar in JSON, which every YAML reader knows, too; unknown keys stay."""
    data = json.loads(text)
    if not isinstance(data, dict) or not data.get("exp_id"):
        raise ValueError("a sidecar is a mapping with an exp_id")
    return data


def evidence(files: DataFrame) -> DataFrame:
    """Files of a walk that lie in an experiment's folders of evidence: raw, data, reports or analysis."""
    return files.where(F.col("relative").rlike("(?i)(^|/)(raw|data|reports|analysis)/"))


def claims_folders(files: DataFrame) -> DataFrame:
    """Folders that hold claims: folder."""
    return files.select(F.regexp_extract("relative", "^(.*?/?claims)/", 1).alias("folder")).where("folder <> ''").distinct()


def tracked_table(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """A table with all cells as text but for whole-number columns without leading zeros or blanks, and what was read: path, sha256."""
    from verdigris.operators.multiset import typed_columns

    read = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    rows = text_table(spark, path, separator)
    kinds = {r.name: r.kind for r in typed_columns(rows, rows.columns).collect()}  # a row for each column
    return rows.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if kinds.get(c) == "integer" else F.col(f"`{c}`") for c in rows.columns]), read


def table_name(file: Column) -> Column:
    """The name under which a table is reached: '01_dose.csv' is dose."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"\.[^.]*$", ""), "^[0-9]+_", "")


def vocabulary(defaults: dict[str, list[str]], private: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Canonical names and their patterns; a private list stands in place of the default one of its name."""
    return {**defaults, **(private or {})}


def resolve_folder(found: DataFrame, asked: str) -> str:
    """The one folder of ``ingest.folder_of``; none, or several, is an error."""
    row = found.where(F.col("asked") == asked).first()
    if row is None or row.n != 1:
        raise ValueError(f"{asked!r} names {row.n if row else 0} folders")
    return row.folder
