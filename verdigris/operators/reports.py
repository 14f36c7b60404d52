"""Reports over claims: audit of citations and embeds, traces of what they cite, assembly, sections.

Tables: reports (report, text), claims (claim_id, outcome, strength, statement), recorded and disk
(path, sha). Everything is keyed rows, so a report with many citations is many rows, never one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators import claims as cl
from verdigris.operators import lineage as ln

REMOTE = "^[a-z]+://"


def grounded_index(claims: DataFrame) -> DataFrame:
    """Claims with ``grounded``; an id that several reports of experiments hold counts once, grounded only if all are."""
    good = cl.is_grounded(F.col("outcome"), F.col("strength"))
    return claims.groupBy("claim_id").agg(F.bool_and(good).alias("grounded"), F.min("outcome").alias("outcome"), F.min("strength").alias("strength"), F.min("statement").alias("statement"))


def cited(reports: DataFrame) -> DataFrame:
    """Citations outside fences: report, line, at, id."""
    return cl.references(reports, "report", "text", cl.CITATION)


def embedded(reports: DataFrame) -> DataFrame:
    """Embeds outside fences: report, line, at, target (relative to the root unless remote)."""
    return cl.references(reports, "report", "text", cl.EMBED).withColumnRenamed("id", "target")


def _candidates(ids: DataFrame, index: DataFrame) -> DataFrame:
    """For each id: n candidates and, where there is one, its claim. A full id wins; else claims that end in it."""
    full = index.select(F.col("claim_id").alias("id"), F.struct("claim_id", "grounded", "outcome", "strength", "statement").alias("whole"))
    tails = index.groupBy(F.substring_index("claim_id", "::", -1).alias("tail")).agg(F.count("*").alias("n_tail"), F.min(F.struct("claim_id", "grounded", "outcome", "strength", "statement")).alias("ends"))
    joined = ids.join(full, "id", "left").withColumn("tail", F.substring_index("id", "::", -1)).join(tails, "tail", "left")
    plain = ~F.col("id").contains("::") | F.col("ends.claim_id").endswith(F.concat(F.lit("::"), F.col("id")))
    n = F.when(F.col("whole").isNotNull(), 1).when(plain, F.coalesce("n_tail", F.lit(0))).otherwise(0).cast("long")
    return joined.select(*ids.columns, n.alias("n"), F.when(F.col("whole").isNotNull(), F.col("whole")).when(plain & (F.col("n_tail") == 1), F.col("ends")).alias("claim"))


def audited(reports: DataFrame, claims: DataFrame, recorded: DataFrame, disk: DataFrame) -> DataFrame:
    """Every citation and embed of every report: report, line, at, what (citation or embed), ref, verdict.

    Citations are backed, weak-backing, missing or ambiguous; embeds current, drifted, missing,
    untracked or dangling. Whatever is neither backed nor current is a finding.
    """
    found = cited(reports)
    told = _candidates(found.select("id").distinct(), grounded_index(claims))
    verdict = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(F.col("claim.grounded"), "backed").otherwise("weak-backing")
    citations = found.join(told.select("id", verdict.alias("verdict")), "id").select("report", "line", "at", F.lit("citation").alias("what"), F.col("id").alias("ref"), "verdict")
    shown = embedded(reports)
    remote = F.col("target").rlike(REMOTE)
    kept = cl.embeds(shown.select("target").distinct(), recorded, disk).select("target", F.when(remote, "untracked").otherwise(F.col("verdict")).alias("verdict"))
    embeds = shown.join(kept, "target").select("report", "line", "at", F.lit("embed").alias("what"), F.col("target").alias("ref"), "verdict")
    return citations.unionByName(embeds)


def is_finding(verdict: Column) -> Column:
    return ~verdict.isin("backed", "current")


def audit_status(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """report, n_citations, n_embeds, n_findings and status: GROUNDED without a finding, else BROKEN."""
    sums = verdicts.groupBy("report").agg(F.count_if(F.col("what") == "citation").alias("c"), F.count_if(F.col("what") == "embed").alias("e"), F.count_if(is_finding(F.col("verdict"))).alias("f"))
    joined = reports.select("report").join(sums, "report", "left")
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return joined.select("report", zero("c", "n_citations"), zero("e", "n_embeds"), zero("f", "n_findings"), F.when(F.coalesce("f", F.lit(0)) > 0, "BROKEN").otherwise("GROUNDED").alias("status"))


def finding_lines(verdicts: DataFrame) -> DataFrame:
    """The audit as text, a line for each finding: report, line, text."""
    found = verdicts.where(is_finding(F.col("verdict")))
    kind = F.concat(F.col("verdict"), F.when((F.col("what") == "citation") & (F.col("verdict") != "weak-backing"), "-claim").when(F.col("what") == "embed", "-embed").otherwise(""))
    return found.select("report", "line", F.concat(F.lit("  line "), F.col("line").cast("string"), F.lit(": "), kind, F.lit(" "), "ref").alias("text"))


def edge_breaks(edges: DataFrame, disk: DataFrame, recorded: DataFrame) -> DataFrame:
    """Breaks of the ledger itself: path, kind.

    edges: child, parent (paths). A data artifact without a raw input, or an analysis without a data
    input, is unsourced; a recorded input that is not there is missing, one with other bytes drifted.
    """
    kind = F.when(F.col("child").rlike("(^|/)data/"), "data").when(F.col("child").rlike("(^|/)analysis/"), "analysis")
    fed = F.when(F.col("kind") == "data", F.col("parent").rlike("(^|/)raw/")).when(F.col("kind") == "analysis", F.col("parent").rlike("(^|/)data/"))
    unsourced = edges.withColumn("kind", kind).where("kind is not null").groupBy("child").agg(F.bool_or(fed).alias("fed")).where("not fed").select(F.col("child").alias("path"), F.lit("unsourced").alias("kind"))
    inputs = edges.select(F.col("parent").alias("path")).distinct().join(recorded, "path", "left").join(disk.select("path", F.col("sha").alias("now"), F.lit(True).alias("there")), "path", "left")
    gone = F.when(F.col("there").isNull(), "missing").when(F.col("sha").isNotNull() & (F.col("sha") != F.col("now")), "drifted")
    return unsourced.unionByName(inputs.select("path", gone.alias("kind")).where("kind is not null"))


def claim_trace(claims: DataFrame, edges: DataFrame, disk: DataFrame, recorded: DataFrame) -> DataFrame:
    """Breaks of every claim: claim_id, path, kind. claims: claim_id, path (an input; null for none).

    A claim without an input under data/ or analysis/ is ungrounded. Inputs that no edge made and that
    are not there are dangling; from the others the ledger is followed to raw files, and every break of
    the ledger on the way counts. Only broken paths are followed, from the break towards the claims.
    """
    computed = F.col("path").rlike("(^|/)(data|analysis)/")
    bare = claims.groupBy("claim_id").agg(F.coalesce(F.bool_or(computed), F.lit(False)).alias("ok")).where("not ok").select("claim_id", F.col("claim_id").alias("path"), F.lit("ungrounded").alias("kind"))
    inputs = claims.where(computed).distinct()
    made = edges.select(F.col("child").alias("path"), F.lit(True).alias("made")).distinct()
    loose = inputs.join(made, "path", "left_anti").join(disk.select("path"), "path", "left_anti").select("claim_id", "path", F.lit("dangling").alias("kind"))
    broken = edge_breaks(edges, disk, recorded)
    back = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    walked = ln.closure(back, broken.select(F.col("path").alias("node"))).select(F.col("root").alias("path"), F.col("node").alias("from"))
    on_the_way = inputs.select("claim_id", F.col("path").alias("from")).join(walked, "from").join(broken, "path").select("claim_id", "path", "kind")
    return bare.unionByName(loose).unionByName(on_the_way).distinct()


def terminals(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """What an experiment is traced from: its claims; without any its README and analyses; without these all artifacts.

    edges: experiment, child; claims: experiment, claim_id. Result: experiment, terminal, kind.
    """
    kind = F.when(F.col("child").rlike("(^|/)README"), "readme").when(F.col("child").rlike("(^|/)analysis/"), "analysis").when(F.col("child").rlike("(^|/)data/"), "data").otherwise("other")
    artifacts = edges.select("experiment", F.col("child").alias("terminal"), kind.alias("kind"), F.when(kind.isin("readme", "analysis"), 2).otherwise(3).alias("tier")).distinct()
    rows = claims.select("experiment", F.col("claim_id").alias("terminal"), F.lit("claim").alias("kind"), F.lit(1).alias("tier")).distinct().unionByName(artifacts)
    best = rows.groupBy("experiment").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["experiment", "tier"]).select("experiment", "terminal", "kind")


def report_trace(reports: DataFrame, claims: DataFrame, breaks: DataFrame) -> DataFrame:
    """Breaks of every report: report, cite, path, kind. A citation without a claim is dangling, one with several ambiguous; else its claim's breaks are the report's."""
    ids = cited(reports).select("report", "id").distinct()
    told = _candidates(ids.select("id").distinct(), grounded_index(claims))
    joined = ids.join(told.select("id", "n", F.col("claim.claim_id").alias("claim_id")), "id")
    own = joined.where("n <> 1").select("report", F.col("id").alias("cite"), F.col("id").alias("path"), F.when(F.col("n") == 0, "dangling").otherwise("ambiguous").alias("kind"))
    return own.unionByName(joined.where("n = 1").join(breaks, "claim_id").select("report", F.col("id").alias("cite"), "path", "kind"))


def assembled(reports: DataFrame, claims: DataFrame) -> DataFrame:
    """Reports as lines with footnotes for citations: report, section (0 the text, 1 the notes), line, text."""
    found = cited(reports)
    notes = cl.footnotes(found)
    lines = reports.select("report", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("p", "raw")).select("report", (F.col("p") + 1).alias("line"), "raw")
    labels = found.join(notes, ["report", "id"]).groupBy("report", "line").agg(F.collect_set(F.struct("id", "number")).alias("marks"))

    def marked(raw: Column, mark: Column) -> Column:
        return F.regexp_replace(raw, F.concat(F.lit(r"\[claim:\s*\Q"), mark["id"], F.lit(r"\E\s*\]")), F.concat(F.lit("[^claim-"), mark["number"].cast("string"), F.lit("]")))

    body = lines.join(labels, ["report", "line"], "left")
    text = F.when(F.col("marks").isNull(), F.col("raw")).otherwise(F.aggregate("marks", F.col("raw"), marked))
    told = _candidates(notes.select("id").distinct(), grounded_index(claims))
    statement = F.trim(F.regexp_replace(F.coalesce("claim.statement", F.lit("")), "\n", " "))
    note = F.when(F.col("n") == 1, F.concat(F.lit("**"), F.col("claim.claim_id"), F.lit("** — "), statement, F.lit(" _["), F.col("claim.outcome"), F.lit(" · "), F.col("claim.strength"), F.lit("]_")))
    note = note.otherwise(F.concat(F.lit("claim `"), F.col("id"), F.when(F.col("n") == 0, "` (unresolved)").otherwise("` (ambiguous)")))
    ends = notes.join(told, "id").select("report", F.lit(1).alias("section"), F.col("number").cast("int").alias("line"), F.concat(F.lit("[^claim-"), F.col("number").cast("string"), F.lit("]: "), note).alias("text"))
    return body.select("report", F.lit(0).alias("section"), F.col("line").cast("int").alias("line"), text.alias("text")).unionByName(ends)


def sections(reports: DataFrame) -> DataFrame:
    """Sections of reports: report, number (0 before the first), heading, summary (the first paragraph, without citations and embeds).

    A heading of level two or three starts a section. Lines are numbered by a running count of headings
    and of blank lines, so a paragraph is a group of rows.
    """
    lines = reports.select("report", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("line", "raw"))
    heading = F.nullif(F.trim(F.regexp_extract("raw", r"^#{2,3}\s+(.*?)\s*$", 1)), F.lit(""))
    title = F.col("raw").rlike(r"^#\s+")
    said = F.trim(F.regexp_replace(F.regexp_replace("raw", cl.CITATION, ""), cl.EMBED, ""))
    upto = Window.partitionBy("report").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("report", "line", heading.alias("heading"), F.when(heading.isNotNull() | title, "").otherwise(said).alias("said"))
    rows = rows.withColumn("number", F.count("heading").over(upto)).withColumn("paragraph", F.count_if(F.col("said") == "").over(upto))
    first = rows.where("said <> ''").groupBy("report", "number").agg(F.min("paragraph").alias("paragraph"))
    words = rows.where("said <> ''").join(first, ["report", "number", "paragraph"]).groupBy("report", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x.said), " ").alias("summary"))
    heads = rows.groupBy("report", "number").agg(F.min("heading").alias("heading"))
    return heads.join(words, ["report", "number"], "left").select("report", F.col("number").cast("int").alias("number"), "heading", F.coalesce("summary", F.lit("")).alias("summary"))


def composed(uses: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims that claims use: file, used, n, verdict. uses: file, used (a name); claims: file, name.

    A claim of the same file is preferred; otherwise there must be exactly one: missing or ambiguous.
    """
    near = claims.select("file", F.col("name").alias("used")).distinct().withColumn("here", F.lit(True))
    anywhere = claims.groupBy(F.col("name").alias("used")).agg(F.count("*").alias("all"))
    joined = uses.join(near, ["file", "used"], "left").join(anywhere, "used", "left")
    n = F.when(F.col("here"), 1).otherwise(F.coalesce("all", F.lit(0))).cast("long")
    return joined.select("file", "used", n.alias("n"), F.when(F.col("here"), "same-file").when(n == 1, "unique").when(n == 0, "missing").otherwise("ambiguous").alias("verdict"))
