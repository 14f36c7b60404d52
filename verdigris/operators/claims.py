"""Claims: what grounds them, how they roll up, which cross experiments, which have drifted, and how reports cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
GROUNDED_OUTCOMES, GROUNDED_STRENGTHS = ["passed", "xpass"], ["strong", "moderate"]
CITATION = r"\[claim:\s*([^\[\]]+(?:\[[^\]]*\])?)\s*\]"
EMBED = r"!\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'][^\"']*[\"'])?\s*\)"


def is_grounded(outcome: Column, strength: Column) -> Column:
    return outcome.isin(GROUNDED_OUTCOMES) & strength.isin(GROUNDED_STRENGTHS)


def outcome_of(failed: Column, expected_failure: Column, skipped: Column) -> Column:
    return F.when(skipped, "skipped").when(expected_failure & failed, "xfail").when(expected_failure, "xpass").when(failed, "failed").otherwise("passed")


def rollup(claims: DataFrame, facets: list[str]) -> DataFrame:
    """Counts by each facet alone, in one pass of grouping sets: facet, value, n."""
    named = claims.select(*[F.coalesce(F.col(f).cast("string"), F.lit("unspecified")).alias(f) for f in facets])
    sets = named.groupingSets([[F.col(f)] for f in facets], *[F.col(f) for f in facets]).agg(F.count("*").alias("n"), *[F.grouping(f).alias(f"g_{f}") for f in facets])
    facet, value = F.lit(None), F.lit(None)
    for f in facets:
        facet, value = F.when(F.col(f"g_{f}") == 0, F.lit(f)).otherwise(facet), F.when(F.col(f"g_{f}") == 0, F.col(f)).otherwise(value)
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def per_experiment(claims: DataFrame, experiment: str, facet: str) -> DataFrame:
    """Nested counts of a facet for each experiment, as a map."""
    n = claims.groupBy(experiment, F.coalesce(F.col(facet).cast("string"), F.lit("unspecified")).alias("value")).agg(F.count("*").alias("n"))
    return n.groupBy(experiment).agg(F.sum("n").alias("n_claims"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def cross_experiment(inputs: DataFrame, claim: str, home: str, experiment: str) -> DataFrame:
    """Claims with inputs of other experiments than their own, and which."""
    others = inputs.where(F.col(experiment) != F.col(home)).groupBy(claim, home).agg(F.array_sort(F.collect_set(experiment)).alias("others"))
    return others


def drift(history: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key."""
    w = Window.partitionBy(key).orderBy(at)
    return history.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def unfenced(text: Column) -> Column:
    """array of struct(line, text) of the lines outside fenced code, numbered from 1; a fence closes with the mark that opened it.

    One pass over the lines keeps the open mark and notes a run of lines whenever a fence opens; the
    runs are cut out at the end.
    """
    lines = F.split(text, "\r\n|\r|\n", -1)
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("line"), F.lit(1).alias("begin"), F.expr("cast(array() as array<struct<begin:int,size:int>>)").alias("runs"))
    noted = lambda acc, end: F.concat(acc["runs"], F.array(F.struct(acc["begin"].alias("begin"), (end - acc["begin"]).alias("size"))))

    def step(acc: Column, raw: Column) -> Column:
        mark = F.regexp_extract(raw, r"^\s*(```|~~~)", 1)
        n = acc["line"] + 1
        opens, closes = (acc["fence"] == "") & (mark != ""), (acc["fence"] != "") & (mark == acc["fence"])
        fence = F.when(opens, mark).when(closes, F.lit("")).otherwise(acc["fence"])
        return F.struct(fence.alias("fence"), n.alias("line"), F.when(closes, n + 1).otherwise(acc["begin"]).alias("begin"), F.when(opens & (n > acc["begin"]), noted(acc, n)).otherwise(acc["runs"]).alias("runs"))

    runs = F.aggregate(lines, start, step, lambda acc: F.when((acc["fence"] == "") & (acc["line"] >= acc["begin"]), noted(acc, acc["line"] + 1)).otherwise(acc["runs"]))
    return F.flatten(F.transform(runs, lambda run: F.transform(F.slice(lines, run["begin"], run["size"]), lambda raw, k: F.struct((run["begin"] + k).alias("line"), raw.alias("text")))))


def references(reports: DataFrame, report: str, text: str, pattern: str) -> DataFrame:
    """What a pattern finds outside fences: report, line, at (its place in the line), id."""
    lines = reports.select(F.col(report).alias("report"), F.explode(unfenced(F.col(text))).alias("l"))
    found = F.posexplode(F.regexp_extract_all(F.col("l.text"), F.lit(pattern), 1))
    return lines.select("report", F.col("l.line").alias("line"), found.alias("at", "id")).withColumn("id", F.trim("id"))


def footnotes(found: DataFrame) -> DataFrame:
    """Numbers for ids in the order in which a report first has them: report, id, number."""
    first = found.groupBy("report", "id").agg(F.min(F.struct("line", "at")).alias("first"))
    return first.select("report", "id", F.row_number().over(Window.partitionBy("report").orderBy("first", "id")).alias("number"))


def resolved(citations: DataFrame, claims: DataFrame) -> DataFrame:
    """Citations (id) against claims (claim_id, grounded): a full id wins over an equal tail; verdict backed, weak-backing, missing or ambiguous."""
    tail = lambda c: F.element_at(F.split(c, "::"), -1)
    full = claims.select(F.col("claim_id").alias("id"), F.lit(1).cast("long").alias("n_full"), F.col("grounded").alias("full_grounded"))
    tails = claims.groupBy(tail(F.col("claim_id")).alias("tail")).agg(F.count("*").alias("n_tail"), F.bool_or("grounded").alias("tail_grounded"))
    joined = citations.join(full, "id", "left").withColumn("tail", tail(F.col("id"))).join(tails, "tail", "left")
    grounded = F.when(F.col("n_full").isNotNull(), F.col("full_grounded")).otherwise(F.col("tail_grounded"))
    verdict = F.when(F.col("n_full").isNull() & F.col("n_tail").isNull(), "missing").when(F.col("n_full").isNull() & (F.col("n_tail") > 1), "ambiguous").when(grounded, "backed").otherwise("weak-backing")
    return joined.withColumn("verdict", verdict).drop("tail", "n_full", "full_grounded", "n_tail", "tail_grounded")


def embeds(targets: DataFrame, recorded: DataFrame, disk: DataFrame) -> DataFrame:
    """Embeds (target) against recorded and present hashes (path, sha): current, drifted, missing, untracked or dangling."""
    a, b = recorded.select(F.col("path").alias("target"), F.col("sha").alias("recorded")), disk.select(F.col("path").alias("target"), F.col("sha").alias("present"))
    joined = targets.join(a, "target", "left").join(b, "target", "left")
    r, p = F.col("recorded"), F.col("present")
    return joined.withColumn("verdict", F.when(r.isNull() & p.isNull(), "dangling").when(r.isNull(), "untracked").when(p.isNull(), "missing").when(r == p, "current").otherwise("drifted"))
