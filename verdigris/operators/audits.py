"""Audits and views of a catalog: flags, staleness, reproduction, extraction, work lists, cards and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.names import well_named
from verdigris.operators import checks

VERIFIED_BY_FILE = ["pdf", "file"]


def paper_flags(papers: DataFrame, disk: DataFrame, least: float = 0.30) -> DataFrame:
    """Flags of papers: subject (citekey), flag.

    papers: citekey, title, authors_text, year, content_state, source, doi, arxiv_id, file_path, folder
    (what the author's folder should be), overlap (of title and text, null if not measured).
    """
    joined = papers.join(disk.select(F.col("path").alias("file_path"), F.lit(True).alias("there")), "file_path", "left")
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    filed, by_file = ~empty("file_path"), F.col("source").isin(VERIFIED_BY_FILE)
    parent = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    rules = {f"missing:{c}": empty(c) for c in ("title", "authors_text", "year")} | {
        "stub": F.col("content_state") == "stub",
        "unverified": by_file,
        "no-identifier": empty("doi") & empty("arxiv_id") & ~F.coalesce(by_file, F.lit(False)),
        "file-missing": filed & F.col("there").isNull(),
        "misfiled": filed & F.col("there").isNotNull() & (parent != F.concat(F.lit("papers/"), "folder")),
        "no-file": ~filed & (F.coalesce("content_state", F.lit("")) != "stub"),
        "low-content-overlap": F.col("overlap") < least,
    }
    return checks.flags(joined, "citekey", rules)


def flag_histogram(flags: DataFrame) -> DataFrame:
    """How many flags there are of each sort (what stands before a colon)."""
    return flags.groupBy(F.substring_index("flag", ":", 1).alias("sort")).agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; ties go to the smaller key."""
    return counts.orderBy(F.desc("n"), key).limit(n)


def integrity(records: DataFrame, disk: DataFrame) -> DataFrame:
    """Records (path, sha) against files: path, finding (file-missing, bytes-changed or orphan)."""
    a = records.select("path", F.col("sha").alias("recorded"), F.lit(True).alias("known"))
    b = disk.select("path", F.col("sha").alias("present"), F.lit(True).alias("there"))
    joined = a.join(b, "path", "full_outer")
    finding = F.when(F.col("known").isNull(), "orphan").when(F.col("there").isNull(), "file-missing").when(F.col("recorded") != F.col("present"), "bytes-changed")
    return joined.select("path", finding.alias("finding")).where("finding is not null")


def staleness(edges: DataFrame, disk: DataFrame, in_folder: DataFrame) -> DataFrame:
    """The state of each experiment: experiment, state, n_changed, n_missing, n_added, artifact_changed, reviewed_at.

    edges: experiment, artifact, artifact_sha, reviewed_at, path, sha (an input; null for none);
    in_folder: experiment, path. A path that an experiment recorded twice counts once, with its last
    sha; without recorded inputs the state is no-provenance. Added are files in the folder that are
    neither inputs nor artifacts.
    """
    now = disk.select("path", F.col("sha").alias("now"), F.lit(True).alias("there"))
    inputs = edges.where("path is not null").groupBy("experiment", "path").agg(F.max_by("sha", F.struct("reviewed_at", "artifact")).alias("sha"), F.max("reviewed_at").alias("reviewed_at")).join(now, "path", "left")
    gone = F.col("there").isNull()
    by_input = inputs.groupBy("experiment").agg(F.count_if(~gone & ~F.col("sha").eqNullSafe(F.col("now"))).alias("n_changed"), F.count_if(gone).alias("n_missing"), F.max("reviewed_at").alias("reviewed_at"))
    made = edges.select("experiment", F.col("artifact").alias("path"), "artifact_sha").distinct().join(now, "path", "left")
    by_artifact = made.groupBy("experiment").agg(F.bool_or(~F.col("artifact_sha").eqNullSafe(F.col("now"))).alias("artifact_changed"))
    known = edges.select("experiment", "path").union(edges.select("experiment", "artifact"))
    added = in_folder.select("experiment", "path").distinct().join(known, ["experiment", "path"], "left_anti").groupBy("experiment").agg(F.count("*").alias("n_added"))
    every = edges.select("experiment").union(in_folder.select("experiment")).distinct()
    joined = every.join(by_input, "experiment", "left").join(by_artifact, "experiment", "left").join(added, "experiment", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    recorded, edited = F.col("n_changed").isNotNull(), F.coalesce("artifact_changed", F.lit(False))
    loose = (zero("n_changed") + zero("n_missing") + zero("n_added") > 0) | edited
    state = F.when(~recorded, "no-provenance").when(loose, "stale").otherwise("up-to-date")
    told = lambda c, name: F.when(recorded, c).alias(name)
    return joined.select("experiment", state.alias("state"), *[told(zero(c), c) for c in ("n_changed", "n_missing", "n_added")], told(edited, "artifact_changed"), F.col("reviewed_at"))


def fingerprint(files: DataFrame, by: str, path: str, sha: str) -> DataFrame:
    """One value for the files of each group that no order of rows changes: by, n_files, fingerprint.

    Hashes of (path, sha) are summed, so a group of any size is folded before it is shuffled.
    """
    rows = files.select(by, path, sha).distinct()
    sums = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\n", path, sha).cast("binary"), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return rows.groupBy(by).agg(F.count("*").alias("n_files"), F.sha2(F.concat_ws(":", *[s.cast("string") for s in sums]).cast("binary"), 256).alias("fingerprint"))


def worklist(states: DataFrame, sources: DataFrame) -> DataFrame:
    """What is to be reviewed: experiment, state, n_sources; stale before unreviewed ones, these in order."""
    n = sources.groupBy("experiment").agg(F.count("*").alias("n_sources"))
    rank = F.when(F.col("state") == "stale", 0).otherwise(1)
    return states.where("state <> 'up-to-date'").join(n, "experiment", "left").select("experiment", "state", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), rank.alias("rank"))


def compared_tables(recorded: DataFrame, again: DataFrame, rtol: float = 1e-3, atol: float = 1e-6, shown: int = 5) -> DataFrame:
    """Cells (artifact, row, col, value) of recorded and regenerated tables: artifact, verdict, n_cells, n_differ, first.

    exact: the same cells as text; approx: all numbers are within tolerance and all texts equal;
    mismatch: a cell differs or is missing; not-regenerated or unrecorded: a whole table is missing.
    first: the first differing cells, ``shown`` at most.
    """
    from verdigris.functions.text import close, try_number

    a = recorded.select("artifact", "row", "col", F.col("value").alias("a"), F.lit(True).alias("in_a"))
    b = again.select("artifact", "row", "col", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, ["artifact", "row", "col"], "full_outer")
    x, y = try_number(F.col("a")), try_number(F.col("b"))
    paired = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    exact = paired & F.col("a").eqNullSafe(F.col("b"))
    near = exact | (paired & F.coalesce(close(x, y, rtol, atol), F.lit(False)))
    rows = both.select("artifact", "row", "col", exact.alias("exact"), near.alias("near"), F.col("in_a").isNotNull().alias("in_a"), F.col("in_b").isNotNull().alias("in_b"))
    sums = rows.groupBy("artifact").agg(F.count("*").alias("n_cells"), F.count_if(~F.col("near")).alias("n_differ"), F.bool_and("exact").alias("exact"), F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    from pyspark.sql import Window

    first = rows.where("not near").withColumn("k", F.row_number().over(Window.partitionBy("artifact").orderBy("row", "col"))).where(F.col("k") <= shown)
    listed = first.groupBy("artifact").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col"))), lambda c: F.concat(F.lit("["), c["col"], F.lit("]["), c["row"].cast("string"), F.lit("]"))), "; ").alias("first"))
    verdict = F.when(~F.col("in_b"), "not-regenerated").when(~F.col("in_a"), "unrecorded").when(F.col("exact"), "exact").when(F.col("n_differ") == 0, "approx").otherwise("mismatch")
    return sums.join(listed, "artifact", "left").select("artifact", verdict.alias("verdict"), "n_cells", "n_differ", F.when(verdict == "mismatch", F.col("first")).alias("first"))


def figures_agree(a: Column, b: Column, pixels: int = 4) -> Column:
    """Whether two struct(width, height) are of figures of one size, give or take some pixels."""
    return (F.abs(a["width"] - b["width"]) <= pixels) & (F.abs(a["height"] - b["height"]) <= pixels)


def extraction_findings(produced: DataFrame, again: DataFrame, disk: DataFrame, recorded: DataFrame, recipe: str = "extract.py") -> DataFrame:
    """Findings of an extraction: experiment, check, subject.

    produced, again: experiment, name, sha (of two runs); disk: experiment, name, sha; recorded:
    experiment, name, path, then, now (hashes of inputs when recorded and today). Checks: determinism,
    grounding (an input has changed), recipe (it has), data (an output differs from the file), legacy (a
    file that no run made) and naming.
    """
    key = ["experiment", "name"]
    row = lambda df, check, subject: df.select("experiment", F.lit(check).alias("check"), F.col(subject).alias("subject"))
    one, two = produced.select(*key, F.col("sha").alias("a")), again.select(*key, F.col("sha").alias("b"))
    unlike = one.join(two, key, "full_outer").where("not (a <=> b)")
    moved = recorded.where("then <> now")
    is_recipe = F.col("path").endswith(recipe)
    files = disk.where(F.col("name") != recipe).select(*key, F.col("sha").alias("d"))
    both = one.join(files, key)
    return (
        row(unlike, "determinism", "name")
        .unionByName(row(moved.where(~is_recipe).select("experiment", "path").distinct(), "grounding", "path"))
        .unionByName(row(moved.where(is_recipe).select("experiment", "name").distinct(), "recipe", "name"))
        .unionByName(row(both.where("a <> d"), "data", "name"))
        .unionByName(row(files.join(one, key, "left_anti"), "legacy", "name"))
        .unionByName(row(one.where(~well_named(F.col("name"))), "naming", "name"))
    )


def whole_rollup(claims: DataFrame, inputs: DataFrame) -> DataFrame:
    """Everything of a program's claims in one long table: what, key, value, n.

    claims: claim_id, home, outcome, kind, strength, stale; inputs: claim_id, home, experiment.
    """
    facets = F.array(*[F.struct(F.lit(f"by_{c}").alias("what"), F.lit("").alias("key"), F.col(c).alias("value")) for c in ("outcome", "kind", "strength")], *[F.struct(F.lit(f"experiment_{c}").alias("what"), F.col("home").alias("key"), F.col(c).alias("value")) for c in ("outcome", "kind")])
    counted = claims.select(F.explode(facets).alias("f")).groupBy("f.what", "f.key", "f.value").agg(F.count("*").alias("n"))
    totals = claims.agg(F.count("*").alias("n_claims"), F.count_distinct("home").alias("n_experiments")).select(F.explode(F.array(F.struct(F.lit("n_claims").alias("what"), F.col("n_claims").alias("n")), F.struct(F.lit("n_experiments").alias("what"), F.col("n_experiments").alias("n")))).alias("t")).select("t.what", F.lit("").alias("key"), F.lit("").alias("value"), "t.n")
    stale = claims.where("stale").select(F.lit("stale").alias("what"), F.col("home").alias("key"), F.col("claim_id").alias("value"), F.lit(1).cast("long").alias("n"))
    cross = inputs.where("experiment <> home").select("claim_id", "home", "experiment").distinct().groupBy("claim_id", "home").agg(F.count("*").alias("n")).select(F.lit("cross").alias("what"), F.col("home").alias("key"), F.col("claim_id").alias("value"), "n")
    return counted.unionByName(totals).unionByName(stale).unionByName(cross)


def reconciled(declared: DataFrame, captured: DataFrame) -> DataFrame:
    """Experiments that claims declare and that their reads touched: claim_id, experiment, verdict (both, undeclared or unread)."""
    a = declared.select("claim_id", "experiment").distinct().withColumn("d", F.lit(True))
    b = captured.select("claim_id", "experiment").distinct().withColumn("c", F.lit(True))
    return a.join(b, ["claim_id", "experiment"], "full_outer").select("claim_id", "experiment", F.when(F.col("d").isNull(), "undeclared").when(F.col("c").isNull(), "unread").otherwise("both").alias("verdict"))


def members(experiments: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """Entities of experiments: entity, exp_id. fields: column names, and whether they hold arrays."""
    entries = [F.col(c) if many else F.array(F.col(c)) for c, many in fields.items()]
    return experiments.select("exp_id", F.explode(F.concat(*[F.coalesce(e, F.expr("cast(array() as array<string>)")) for e in entries])).alias("entity")).where("entity is not null and entity <> ''").distinct().select("entity", "exp_id")


def markdown_row(cells: list[Column]) -> Column:
    """A line of a table; pipes are escaped, line breaks are spaces."""
    cell = lambda c: F.trim(F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]+", " "), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cells]), F.lit(" |"))


def markdown_table(text: Column, name: Column) -> Column:
    """A CSV text without quotes as a markdown table; rows are padded or cut to the header."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: x != "")
    header = F.split(F.get(lines, F.lit(0)), ",")
    cell = lambda c: F.trim(F.replace(c, F.lit("|"), F.lit("\\|")))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    padded = lambda line: F.slice(F.concat(F.split(line, ","), F.array_repeat(F.lit(""), F.size(header))), F.lit(1), F.size(header))
    body = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: row(padded(line)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(header)), " | "), F.lit(" |"))
    return F.when(F.size(lines) == 0, F.concat(F.lit("_(empty table: "), name, F.lit(")_"))).otherwise(F.array_join(F.concat(F.array(row(header), rule), body), "\n"))


def role_summary(files: DataFrame, threshold: int = 12, samples: int = 4) -> DataFrame:
    """A line for each role: few files by name, many by type counts and the first names. files: role, type, name."""
    from pyspark.sql import Window

    sizes = files.groupBy("role").agg(F.count("*").alias("n"))
    first = files.withColumn("k", F.row_number().over(Window.partitionBy("role").orderBy("name"))).where(F.col("k") <= threshold)
    names = first.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: F.concat(F.lit("`"), x["name"], F.lit("`"))).alias("names"))
    types = files.groupBy("role", "type").agg(F.count("*").alias("t")).groupBy("role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("t"), F.coalesce("type", F.lit("?")).alias("type")))), lambda x: F.concat((-x["t"]).cast("string"), F.lit("×"), x["type"])), ", ").alias("types"))
    listing = F.when(F.col("n") <= threshold, F.array_join("names", ", ")).otherwise(F.concat("types", F.lit(" — e.g. "), F.array_join(F.slice("names", 1, samples), ", "), F.lit(", …")))
    return sizes.join(names, "role").join(types, "role").select("role", "n", F.concat(F.lit("- **"), "role", F.lit("** ("), F.col("n").cast("string"), F.lit("): "), listing).alias("line"))


def overlaid(metadata: Column, columns: dict[str, Column]) -> Column:
    """A map of texts in which authoritative columns stand over what the map says."""
    told = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[v.cast("string") for v in columns.values()]))
    sure = F.map_filter(told, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(sure), k)), sure)


def cleaned(rows: DataFrame, drop: list[str]) -> DataFrame:
    """A catalog without inner columns: those that begin with an underscore, and the named ones."""
    return rows.select(*[f"`{c}`" for c in rows.columns if not c.startswith("_") and c not in drop])
