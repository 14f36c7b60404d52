"""Records of a catalog: enrichment with recorded responses, edits, drift, reviews, sorts and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import names as nm
from verdigris.functions.text import collapse, strip_markup
from verdigris.sources.kept import kept_table

#: Sources that only a file vouches for, and what a re-enriched record keeps.
UNVERIFIED = ["pdf", "file"]
KEPT = ["original_path", "legacy_id", "added_at", "content_state"]
#: Rows up to which a table that has been counted is broadcast.
SMALL = 262_144
#: Rows of either side of a block of pairs.
SIDE = 2_048
#: Tasks over which blocks are dealt at most.
MOST_TASKS = 8_192
_PERSON = "struct<family:string,given:string>"
#: What is read of a registry's answer; the rest is ignored.
WORK = f"title array<string>, author array<{_PERSON}>, issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, DOI string, URL string, type string, abstract string, volume string, issue string, page string, publisher string"
PAPER = "title string, authors array<struct<name:string>>, year int, venue string, externalIds map<string,string>, paperId string, url string, abstract string, openAccessPdf struct<url:string>"


def split_name(name: Column) -> Column:
    """struct(family, given): the last word is the family name."""
    said = F.trim(F.coalesce(name, F.lit("")))
    alone = ~said.contains(" ")
    return F.struct(F.when(alone, said).otherwise(F.substring_index(said, " ", -1)).alias("family"), F.when(alone, "").otherwise(F.regexp_replace(said, " [^ ]*$", "")).alias("given"))


def _empty_is_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def from_registry(body: Column) -> Column:
    """A record from a registry's answer about a work; null if it is no JSON."""
    w = F.from_json(body, WORK)
    first = lambda c: F.get(c, F.lit(0))
    doi = _empty_is_null(w["DOI"])
    return F.when(
        F.coalesce(w["title"].isNotNull() | doi.isNotNull(), F.lit(False)),
        F.struct(
            _empty_is_null(strip_markup(first(w["title"]))).alias("title"),
            nm.authors_text(F.coalesce(w["author"], F.expr(f"cast(array() as array<{_PERSON}>)"))).alias("authors_text"),
            first(first(w["issued"]["date-parts"])).alias("year"),
            _empty_is_null(first(w["container-title"])).alias("venue"),
            doi.alias("doi"),
            F.lit(None).cast("string").alias("arxiv_id"),
            F.coalesce(_empty_is_null(w["URL"]), F.concat(F.lit("https://doi.org/"), doi)).alias("source_url"),
            nm.work_kind(F.coalesce(w["type"], F.lit(""))).alias("bibtex_type"),
            _empty_is_null(strip_markup(w["abstract"])).alias("abstract"),
            F.lit("crossref").alias("source"),
        ),
    )


def from_graph(body: Column) -> Column:
    """A record from a citation graph's answer about a paper; null if it is no JSON."""
    p = F.from_json(body, PAPER)
    return F.when(
        F.coalesce(p["title"].isNotNull(), F.lit(False)),
        F.struct(
            _empty_is_null(p["title"]).alias("title"),
            nm.authors_text(F.transform(F.coalesce(p["authors"], F.expr("cast(array() as array<struct<name:string>>)")), lambda a: split_name(a["name"]))).alias("authors_text"),
            p["year"].alias("year"),
            _empty_is_null(p["venue"]).alias("venue"),
            _empty_is_null(F.lower(p["externalIds"]["DOI"])).alias("doi"),
            _empty_is_null(p["externalIds"]["ArXiv"]).alias("arxiv_id"),
            _empty_is_null(p["url"]).alias("source_url"),
            F.lit("article").alias("bibtex_type"),
            _empty_is_null(p["abstract"]).alias("abstract"),
            F.lit("semantic_scholar").alias("source"),
        ),
    )


def from_feed(body: Column, arxiv_id: Column) -> Column:
    """A record from an Atom feed's first entry; null if there is none."""
    entry = F.regexp_extract(body, r"(?s)<entry>(.*?)</entry>", 1)
    tag = lambda name: _empty_is_null(collapse(F.regexp_extract(entry, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)))
    names = F.transform(F.regexp_extract_all(entry, F.lit(r"(?s)<author>.*?<name>(.*?)</name>.*?</author>"), F.lit(1)), lambda n: split_name(n))
    return F.when(
        tag("title").isNotNull(),
        F.struct(
            tag("title").alias("title"),
            nm.authors_text(names).alias("authors_text"),
            F.substring(tag("published"), 1, 4).try_cast("int").alias("year"),
            F.lit("arXiv preprint").alias("venue"),
            tag("arxiv:doi").alias("doi"),
            arxiv_id.alias("arxiv_id"),
            F.concat(F.lit("https://arxiv.org/abs/"), arxiv_id).alias("source_url"),
            F.lit("misc").alias("bibtex_type"),
            tag("summary").alias("abstract"),
            F.lit("arxiv").alias("source"),
        ),
    )


def to_enrich(source: Column, year: Column) -> Column:
    return F.coalesce(source.isin(UNVERIFIED), F.lit(False)) | year.isNull()


def enrichment(targets: DataFrame, candidates: DataFrame, least: float = 0.34) -> DataFrame:
    """For each target its first verified candidate: citekey, chosen (doi), best (doi), score, verdict (apply or review).

    candidates: citekey, rank, doi, year, overlap (of the candidate's title and the target's text),
    file_year (null if the file's name tells none). A candidate is verified if the overlap reaches least
    and its year is within one of the file's. The best one, of the largest overlap, is for the review.
    """
    ok = (F.col("overlap") >= least) & F.coalesce(F.abs(F.col("year") - F.col("file_year")) <= 1, F.lit(True)) & F.col("doi").isNotNull()
    sums = candidates.groupBy("citekey").agg(F.min(F.when(ok, F.struct("rank", "doi"))).alias("first"), F.max_by("doi", F.struct("overlap", -F.col("rank"))).alias("best"), F.max("overlap").alias("score"))
    return targets.select("citekey").join(sums, "citekey", "left").select("citekey", F.col("first.doi").alias("chosen"), "best", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("first").isNotNull(), "apply").otherwise("review").alias("verdict"))


def resolved_files(files: DataFrame, answers: DataFrame, least: float = 0.34) -> DataFrame:
    """Files (path, text) with the id that tells what they are: path, kind, value, tier; null for none.

    Ids of the name and of the text before the references are trusted and count if they have an answer
    (kind, value, title); ids behind the references may be of cited works and count only if the words
    of the answer's title stand in the text before. The first in that order decides.
    """
    parts = nm.before_references(F.col("text"))
    front = F.when(parts["before"] != "", parts["before"]).otherwise(F.col("text"))
    trusted = F.transform(nm.merged_ids(nm.ids_in_filename(F.col("path")), nm.ids_in_text(parts["before"])), lambda x, k: F.struct(F.lit("trusted").alias("tier"), k.alias("k"), x["kind"].alias("kind"), x["value"].alias("value")))
    suspect = F.transform(nm.ids_in_text(parts["after"]), lambda x, k: F.struct(F.lit("suspect").alias("tier"), (k + 1000).alias("k"), x["kind"].alias("kind"), x["value"].alias("value")))
    ids = files.select("path", F.lower(front).alias("front"), F.explode(F.concat(trusted, suspect)).alias("i")).select("path", "front", "i.*")
    met = ids.join(answers, ["kind", "value"])
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]+", ""), " +"), lambda w: F.length(w) > 3))
    share = F.try_divide(F.size(F.filter(words, lambda w: F.contains(F.col("front"), w))), F.size(words))
    best = met.where((F.col("tier") == "trusted") | (share >= least)).groupBy("path").agg(F.min(F.struct("k", "kind", "value", "tier")).alias("b"))
    return files.select("path").join(best, "path", "left").select("path", "b.kind", "b.value", "b.tier")


def reenriched(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """Old records with new metadata: what the new record says, the old tags and provenance, updated now. Records without a new one stay."""
    fields = [c for c in new.columns if c != key]
    b = new.select(key, F.struct(*fields).alias("_new"))
    joined = old.join(b, key, "left")
    fresh = F.col("_new").isNotNull()
    value = lambda c: F.when(fresh, F.col(f"_new.{c}")).otherwise(F.col(c)) if c in fields and c not in (*KEPT, "tags") else F.col(c)
    out = [value(c).alias(c) for c in old.columns if c not in (key, "updated_at", "enriched_from")]
    return joined.select(key, *out, F.when(fresh, "unverified").otherwise(F.col("enriched_from") if "enriched_from" in old.columns else F.lit(None).cast("string")).alias("enriched_from"), F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"))


def edited(metadata: Column, changes: Column) -> Column:
    """A map of texts after a change: the changed keys win, those that become null go."""
    kept = F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(changes), k))
    return F.map_concat(kept, F.map_filter(changes, lambda _, v: v.isNotNull()))


def unknown_keys(record: Column, allowed: list[str]) -> Column:
    return F.array_sort(F.array_except(F.map_keys(record), F.array(*[F.lit(k) for k in allowed])))


def attached(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Stubs that got a file: the same record and key, with the file's path and hash and full content."""
    joined = records.join(files.select(key, F.col("path").alias("_path"), F.col("sha").alias("_sha")), key, "left")
    got = F.col("_path").isNotNull() & (F.col("content_state") == "stub")
    own = [c for c in records.columns if c not in ("content_state", "file_path", "sha")]
    return joined.select(*own, F.when(got, "full").otherwise(F.col("content_state")).alias("content_state"), F.when(got, F.col("_path")).otherwise(F.col("file_path")).alias("file_path"), F.when(got, F.col("_sha")).otherwise(F.col("sha")).alias("sha"))


def _states(points: DataFrame, history: DataFrame) -> DataFrame:
    """What paths held as of their marks, and last: path, mark, then, now; paths without a history are left out.

    points: path, mark, each once; history: path, at, sha. Both are dealt over ranges of (path, at), so that
    one path with a third of all rows fills many tasks; a range goes on from the last state of the ranges
    before it, and those without a mark are only asked for that. States of the same time go by their sha.
    """
    told = history.where("path is not null and at is not null").select("path", "at", F.lit(0).alias("kind"), F.struct("at", "sha").alias("state"))
    rows = told.unionByName(points.where("path is not null").select("path", F.col("mark").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(told.schema["state"].dataType).alias("state")))
    order = ["at", "kind", "state"]
    dealt = kept_table(rows.repartitionByRange("path", *order).withColumn("_range", F.spark_partition_id()), "states")
    of_path = Window.partitionBy("path")
    ranges = dealt.groupBy("path", "_range").agg(F.max("state").alias("_last"), F.max("kind").alias("_marked"))  # a row for each range of a path
    ranges = ranges.withColumn("_before", F.last("_last", True).over(of_path.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_now", F.max("_last").over(of_path))
    asked = dealt.join(ranges.where("_marked = 1 and _now is not null").select("path", "_range", "_before", "_now"), ["path", "_range"])
    inside = Window.partitionBy("path", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = asked.withColumn("_held", F.coalesce(F.last("state", True).over(inside), "_before"))
    return held.where("kind = 1").select("path", F.col("at").alias("mark"), F.col("_held.sha").alias("then"), F.col("_now.sha").alias("now"))


def marker_drift(claims: DataFrame, marks: DataFrame, history: DataFrame) -> DataFrame:
    """Inputs that moved since a claim was last judged: claim_id, checked, stale, commit, changed (sorted paths).

    claims: claim_id, path; marks: claim_id, commit, at (when its strength was last set); history: path,
    at, sha (what a path held from then on). Of every path the state as of the mark is held against the
    last one; a claim without a mark is not checked. States are found once for each path and mark,
    however many claims share them.
    """
    last = marks.where("commit is not null").groupBy("claim_id").agg(F.max(F.substring("commit", 1, 10)).alias("commit"), F.max("at").alias("mark"))
    points = claims.join(last.select("claim_id", "mark"), "claim_id").select("path", "mark").distinct()
    moved = kept_table(_states(points, history).where("not (then <=> now)").select(F.col("path").alias("_path"), F.col("mark").alias("_mark")), "moved")
    if moved.count() <= SMALL:
        moved = F.broadcast(moved)
    rows = claims.join(last, "claim_id", "left")
    rows = rows.join(moved, (F.col("path") == F.col("_path")) & F.col("mark").eqNullSafe(F.col("_mark")) & F.col("commit").isNotNull(), "left")
    told = rows.groupBy("claim_id").agg(F.max("commit").alias("commit"), F.array_sort(F.collect_set("_path")).alias("changed"))
    return told.select("claim_id", F.col("commit").isNotNull().alias("checked"), (F.size("changed") > 0).alias("stale"), "commit", "changed")


def _met_in_folders(stamps: DataFrame, files: DataFrame) -> DataFrame:
    """All pairs of stamps and files with the same folder: the columns of both, without it.

    Both sides of a folder are dealt by hashes into parts of about SIDE rows, and each block of two parts is met
    by itself, so a folder fills as many tasks as its pairs need; a row is repeated once for each part across.
    Blocks are counted first: they are small and their pairs many, so partitions go by them, not by bytes.
    """
    across = stamps.groupBy("folder").agg(F.count("*").alias("_s")).join(files.groupBy("folder").agg(F.count("*").alias("_f")), "folder")
    parts = across.select("folder", F.ceil(F.col("_s") / SIDE).alias("_rows"), F.ceil(F.col("_f") / SIDE).alias("_columns"))
    blocks = parts.agg(F.sum(F.col("_rows") * F.col("_columns"))).first()[0] or 1
    dealt = lambda df: df.repartition(min(blocks, MOST_TASKS), "folder", "_row", "_column")
    repeated = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = stamps.join(parts, "folder").select(*stamps.columns, F.pmod(F.xxhash64("artifact", "at"), "_rows").alias("_row"), repeated("_columns").alias("_column"))
    right = files.join(parts, "folder").select(*files.columns, F.pmod(F.xxhash64("path", "sha"), "_columns").alias("_column"), repeated("_rows").alias("_row"))
    return dealt(left).hint("shuffle_hash").join(dealt(right), ["folder", "_row", "_column"])


def reviewed(edges: DataFrame, now_there: DataFrame, stamps: DataFrame) -> DataFrame:
    """Edges (artifact, path, sha, reviewed_at) after reviews: stamps (artifact, folder, at).

    A reviewed artifact's inputs are the files of its folder as they are now, and its inputs from outside
    with their present hashes; those that are gone go. Others stay as they were. now_there: path, sha, folder.
    A stamp without an artifact reviews nothing.

    Each row occurs once. The result has a row for each reviewed artifact and file of its folder, so it is never
    shuffled: both sides are made distinct before they meet, and a pair that has several folders in common
    meets in the first of them.
    """
    stay = edges.join(stamps.select("artifact"), "artifact", "left_anti").select("artifact", "path", "sha", "reviewed_at").distinct()
    each = stamps.where("artifact is not null and folder is not null").groupBy("artifact", "at").agg(F.array_sort(F.collect_set("folder")).alias("_a"))
    within = now_there.join(stamps.where("artifact is not null").select("folder").distinct(), "folder", "left_semi").groupBy("path", "sha").agg(F.array_sort(F.collect_set("folder")).alias("_b"))
    several = lambda c: F.when(F.size(c) > 1, F.col(c)).alias(c)
    met = _met_in_folders(each.select("artifact", "at", several("_a"), F.explode("_a").alias("folder")), within.select("path", "sha", several("_b"), F.explode("_b").alias("folder")))
    first = F.col("_a").isNull() | F.col("_b").isNull() | (F.array_min(F.array_intersect("_a", "_b")) == F.col("folder"))
    own = met.where(first).select("artifact", "path", "sha", F.col("at").alias("reviewed_at"))
    again = edges.select("artifact", "path").join(each, "artifact").join(now_there.where("folder is not null").select("path", "sha", "folder"), "path")
    inside = again.groupBy("artifact", "path", "sha", "at").agg(F.max(F.array_contains("_a", F.col("folder"))).alias("_in"))
    outside = inside.where("not _in").select("artifact", "path", "sha", F.col("at").alias("reviewed_at"))
    return stay.unionByName(own).unionByName(outside)


def claims_indexed(old: DataFrame, report: DataFrame, experiment: str) -> DataFrame:
    """The claims of a catalog (exp_id, claim_id, outcome, strength) after an experiment's report (claim_id, outcome, strength): its claims are the report's, those of others stay."""
    return old.where(F.col("exp_id") != experiment).unionByName(report.select(F.lit(experiment).alias("exp_id"), "claim_id", "outcome", "strength"))


#: The viewer's orders: newest, oldest, by author, by title.
def viewer_order(name: str) -> list[Column]:
    year, title, author = F.coalesce("year", F.lit(0)), F.coalesce("title", F.lit("")), F.coalesce("authors_text", F.lit(""))
    return {"year-desc": [year.desc(), title.asc()], "year-asc": [year.asc(), title.asc()], "author": [author.asc(), year.desc()], "title": [title.asc()]}[name]


def placed(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Rows with their place in one of the viewer's orders; ties go by key."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*viewer_order(name), key)))


def by_number(names: Column) -> Column:
    """Names such as A-3 and A-12 in the order of their numbers."""
    number = lambda x: F.coalesce(F.regexp_extract(x, r"([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(number(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def selected_claims(claims: DataFrame, wanted: str) -> DataFrame:
    """Claims of that id, or whose last part it is."""
    return claims.where((F.col("claim_id") == wanted) | (F.substring_index("claim_id", "::", -1) == wanted))


def prefixed(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.where(F.col("artifact").startswith(prefix))
