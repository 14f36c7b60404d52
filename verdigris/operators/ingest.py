"""Ingest: where incoming files go, what they duplicate, and the snapshot of files that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.names import base_name

#: An experiment's folders, formats that are always raw, and the bytes up to which prose is read.
FOLDERS = ["protocol", "reports", "data", "raw", "analysis"]
RAW_SUFFIXES = [".eds", ".spk", ".pzfx", ".fcs", ".wsp", ".cram", ".bam", ".vcf", ".fastq", ".sav"]
CRUFT = [".DS_Store", "Thumbs.db"]
LARGEST_PROSE = 25 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def routed(sources: DataFrame, routes: DataFrame | None = None, there: DataFrame | None = None, within: list[str] | None = None) -> DataFrame:
    """The plan of an intake: source, folder, dest, routed_by (path, agent, ext or default), taken (dest is there).

    within: columns of all three tables that tell several intakes apart, and of the plan; a route and a
    file that is there count in their own intake only, whatever names others share with it.

    A known folder on the source's path stays, with what lies below it; else a route by name (name,
    folder) decides, else the format. Cruft is left out. A name that has several routes takes the first
    of their folders in order: every source has one row.
    """
    within = within or []
    name = base_name(F.col("source"))
    rows = sources.withColumn("name", name).where(~F.col("name").isin(CRUFT) & ~F.col("name").startswith("~$"))
    parts = F.split("source", "/")
    at = F.array_min(F.transform(F.array(*[F.lit(f) for f in FOLDERS]), lambda f: F.nullif(F.array_position(F.transform(parts, lambda p: F.lower(p)), f), F.lit(0))))
    rows = rows.withColumn("at", at.cast("int"))
    if routes is not None:
        rows = rows.join(routes.groupBy(*within, "name").agg(F.min("folder").alias("told")), [*within, "name"], "left")
    else:
        rows = rows.withColumn("told", F.lit(None).cast("string"))
    kept = F.col("at").isNotNull()
    folder = F.when(kept, F.lower(F.get(parts, F.col("at") - 1))).otherwise(F.coalesce("told", F.lit("raw")))
    below = F.when(kept & (F.col("at") < F.size(parts)), F.array_join(F.slice(parts, F.col("at") + 1, F.size(parts)), "/")).otherwise(F.col("name"))
    by = F.when(kept, "path").when(F.col("told").isNotNull(), "agent").when(suffix(F.col("source")).isin(RAW_SUFFIXES), "ext").otherwise("default")
    plan = rows.select(*within, "source", folder.alias("folder"), F.concat_ws("/", folder, below).alias("dest"), by.alias("routed_by"))
    if there is None:
        return plan.withColumn("taken", F.lit(False))
    held = there.select(*within, F.col("path").alias("dest")).distinct().withColumn("_t", F.lit(True))
    return plan.join(held, [*within, "dest"], "left").select(*within, "source", "folder", "dest", "routed_by", F.coalesce("_t", F.lit(False)).alias("taken"))


def planned(incoming: DataFrame, catalog: DataFrame, keys: dict[str, Column], key: str, order: str) -> DataFrame:
    """What becomes of incoming records: candidate, status (added or duplicate), holder, by.

    keys: expressions over either table, in order of trust; the first under which a record of the
    catalog, or an earlier incoming one, stands decides. Catalog records hold a key before all
    incoming ones. Only keys are shuffled, and each key value has one holder, however many share it.
    """

    def keyed(df: DataFrame, tier: int) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(name).alias("by"), x.cast("string").alias("value")) for k, (name, x) in enumerate(keys.items())])
        rows = df.select(F.struct(F.lit(tier).alias("tier"), F.col(order).alias("order"), F.col(key).alias("key")).alias("who"), F.explode(parts).alias("k"))
        return rows.select("who", "k.rank", "k.by", "k.value").where("value is not null and value <> ''")

    mine = keyed(incoming, 1)
    holders = keyed(catalog, 0).unionByName(mine).groupBy("rank", "value").agg(F.min("who").alias("holder"))
    met = mine.join(holders, ["rank", "value"]).where(F.col("holder") < F.col("who"))
    best = met.groupBy(F.col("who.key").alias("candidate")).agg(F.min(F.struct("rank", "by", "holder")).alias("b"))
    rows = incoming.select(F.col(key).alias("candidate")).join(best, "candidate", "left")
    return rows.select("candidate", F.when(F.col("b").isNull(), "added").otherwise("duplicate").alias("status"), F.col("b.holder.key").alias("holder"), F.col("b.by").alias("by"))


def counters(plan: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row of counts."""
    return plan.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()])


def merged(catalog: DataFrame, incoming: DataFrame, plan: DataFrame, key: str, fill: list[str], origin: str) -> DataFrame:
    """The catalog after an import: key, the filled fields, tags (united, sorted) and origins (sorted).

    Duplicates give their holder what it lacks, first come first, and all their tags and paths; a
    duplicate of a duplicate gives it to the one that was added.
    """
    from verdigris.operators.lineage import closure

    links = plan.where("status = 'duplicate'").select(F.col("candidate").alias("child"), F.col("holder").alias("parent"))
    tops = closure(links, links.select(F.col("child").alias("node"))).join(links.select(F.col("child").alias("node")), "node", "left_anti")
    target = tops.groupBy("root").agg(F.min("node").alias("target"))
    rows = catalog.select(key, *fill, "tags", origin, F.lit(0).alias("_tier")).unionByName(incoming.select(key, *fill, "tags", origin, F.lit(1).alias("_tier")))
    owned = rows.join(target.withColumnRenamed("root", key), key, "left").withColumn("_owner", F.coalesce("target", key))
    first = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("_tier", key))).alias(c) for c in fill]
    tags = owned.select("_owner", F.explode("tags").alias("tag")).distinct().groupBy("_owner").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    held = owned.groupBy("_owner").agg(*first, F.array_sort(F.collect_set(origin)).alias("origins"))
    return held.join(tags, "_owner", "left").select(F.col("_owner").alias(key), *fill, F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"), "origins")


def file_snapshot(old: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """The files after a scan: path, sha, primary_path, added_at, updated_at, status.

    old: path, sha, primary_path, added_at, updated_at; scanned: path, sha. A path with other bytes is
    replaced, one with bytes that another path has is a duplicate of the path that had them first
    (the old primary if it still has them, else the smallest path), one that is gone goes.
    """
    before = old.select("path", F.col("sha").alias("o_sha"), F.col("primary_path").alias("o_primary"), "added_at", F.col("updated_at").alias("o_updated"))
    rows = scanned.join(before, "path", "left")
    stayed = F.when((F.col("o_primary") == F.col("path")) & (F.col("o_sha") == F.col("sha")), F.lit(0)).otherwise(1)
    primary = rows.groupBy("sha").agg(F.min(F.struct(stayed.alias("t"), F.col("path").alias("p"))).alias("f")).select("sha", F.col("f.p").alias("primary_path"))
    joined = rows.join(primary, "sha")
    same = F.col("o_sha") == F.col("sha")
    status = F.when(F.col("o_sha").isNull(), F.when(F.col("path") == F.col("primary_path"), "added").otherwise("duplicate")).when(~same, "replaced").otherwise("unchanged")
    return joined.select("path", "sha", "primary_path", F.coalesce("added_at", now).alias("added_at"), F.when(same, F.col("o_updated")).otherwise(now).alias("updated_at"), status.alias("status"))


def found_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look-ups by path: path, primary_path, sha; a primary path wins over a further one."""
    best = wanted.join(files, "path").groupBy("path").agg(F.min(F.struct((F.col("path") != F.col("primary_path")).alias("t"), "primary_path", "sha")).alias("f"))
    return best.select("path", "f.primary_path", "f.sha")


def indexed_as(kind: Column, size: Column, readable: Column) -> Column:
    """struct(as, note): prose up to the cap that can be read is content, tables are schema, the rest a descriptor."""
    large, broken = (kind == "narrative") & (size > LARGEST_PROSE), (kind == "narrative") & ~readable
    as_ = F.when((kind == "narrative") & ~large & ~broken, "content").when(kind == "tabular", "schema").otherwise("descriptor")
    return F.struct(as_.alias("as"), F.when(large, "too large to embed; catalogued only").when(broken, "content not embedded; catalogued only").alias("note"))


def table_preview(text: Column, delimiter: str = ",", rows: int = 5) -> Column:
    """struct(columns, n_rows, preview) of a delimited text whose cells hold no line breaks; null for a text without a line."""
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x != "")
    columns = F.split(F.get(lines, F.lit(0)), "\\Q" + delimiter + "\\E")
    return F.when(F.size(lines) > 0, F.struct(columns.alias("columns"), (F.size(lines) - 1).cast("long").alias("n_rows"), F.array_join(F.slice(lines, 1, rows + 1), "\n").alias("preview")))


def first_location(files: DataFrame, by: str, path: str, places: list[str]) -> DataFrame:
    """For each ``by`` the path in the first of the places (suffixes of paths) that has one."""
    rank = F.lit(None).cast("int")
    for k, place in reversed(list(enumerate(places))):
        rank = F.when(F.col(path).endswith(place), k).otherwise(rank)
    best = files.withColumn("_rank", rank).where("_rank is not null").groupBy(by).agg(F.min(F.struct("_rank", F.col(path).alias("p"))).alias("f"))
    return best.select(by, F.col("f.p").alias(path))


def folder_of(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (asked) against folders (folder, exp_id): asked, folder (first in order of an exact name, else of an id), n."""
    by_name = wanted.join(folders.select(F.col("folder").alias("asked"), "folder"), "asked").withColumn("t", F.lit(0))
    by_id = wanted.join(folders.select(F.col("exp_id").alias("asked"), "folder"), "asked").withColumn("t", F.lit(1))
    found = by_name.unionByName(by_id).groupBy("asked").agg(F.min(F.struct("t", "folder")).alias("f"), F.count_distinct("folder").alias("n"))
    return wanted.join(found, "asked", "left").select("asked", F.col("f.folder").alias("folder"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ingestible(files: DataFrame, path: str, suffixes: list[str], exclude: list[str], limit: int | None = None) -> DataFrame:
    """Files with one of the suffixes whose path holds none of the excluded texts, in order; limit: the first so many."""
    held = F.lit(False)
    for text in exclude:
        held = held | F.contains(F.col(path), F.lit(text))
    rows = files.where(suffix(F.col(path)).isin(suffixes) & ~held)
    return rows.orderBy(path).limit(limit) if limit else rows


def running_order(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
