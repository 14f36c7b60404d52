"""Operators whose rows grow with their input and result, not with products of the two sides; held against brute force."""

import random

from pyspark.sql import functions as F

from verdigris.operators import records as rc


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def most_rows(df, metric="numOutputRows"):
    """The most rows that a step of a query makes, or writes to a shuffle."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        made = node.metrics().get(metric)
        most = max(most, made.get().value() if made.isDefined() else 0)
        todo.extend(node.children().apply(k) for k in range(node.children().size()))
    return most


CLAIMS, MARKS, HISTORY = "claim_id int, path string", "claim_id int, commit string, at int", "path string, at int, sha string"


def test_drift_against_brute_force(spark):
    r = random.Random(5)
    claims = sorted({(k, f"p{r.randrange(9)}") for k in range(60) for _ in range(3)}) + [(0, "p0"), (0, "p0"), (61, None)]
    marks = [(k, f"commit-{k:08d}", r.choice([None, *range(-3, 40)])) for k in range(62) if k % 4] + [(0, None, 7), (1, "commit-00000001", 99)]
    history = [(f"p{p}", at, r.choice(["a", "b", None])) for p in range(7) for at in r.sample(range(40), 12)] + [("p7", None, "a"), (None, 3, "a")]
    told = []
    for claim in sorted({c for c, _ in claims}):
        own = [(commit, at) for c, commit, at in marks if c == claim and commit]
        ats, changed = [at for _, at in own if at is not None], set()
        for path in {p for c, p in claims if c == claim and own}:
            states = sorted((at, sha) for p, at, sha in history if p == path and p and at is not None)
            then = [sha for at, sha in states if ats and at <= max(ats)]
            if states and (then or [None])[-1] != states[-1][1]:
                changed.add(path)
        told.append((claim, bool(own), bool(changed), own[0][0][:10] if own else None, sorted(changed)))
    got = rc.marker_drift(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(marks, MARKS), spark.createDataFrame(history, HISTORY))
    assert values(got) == sorted(told, key=repr)


def test_drift_asks_a_path_once_for_a_mark(spark):
    claims, history = spark.range(3_000).select(F.col("id").cast("int").alias("claim_id"), F.lit("p").alias("path")), spark.range(2_000).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("at"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("sha"))
    marks = claims.select("claim_id", F.lit("c").alias("commit"), (F.col("claim_id") % 1_000).alias("at"))
    told = rc.marker_drift(claims, marks, history)
    assert most_rows(told) <= 12_000 and most_rows(rc._states(marks.select(F.lit("p").alias("path"), F.col("at").alias("mark")).distinct(), history)) <= 12_000
    assert told.where("stale").count() == sum(k % 1_000 % 5 != 1_999 % 5 for k in range(3_000))


EDGES, FILES, STAMPS = "artifact string, path string, sha string, reviewed_at string", "path string, sha string, folder string", "artifact string, folder string, at string"


def test_reviews_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rc, "SIDE", 7)
    r = random.Random(6)
    some = lambda letter, n, *others: r.choice([*(f"{letter}{k}" for k in range(n)), *others])
    edges = [(some("a", 40), some("p", 60), some("s", 2, None), "t0") for _ in range(300)] + [(None, "p1", "s0", "t0")] * 2
    files = [(some("p", 60, None), some("s", 2, None), some("f", 3, "g", "g", None)) for _ in range(150)]
    stamps = [(some("a", 30), some("f", 4, None), some("t", 2)) for _ in range(60)]
    told = {e for e in edges if e[0] not in {a for a, _, _ in stamps}}
    told |= {(a, p, sha, at) for a, folder, at in stamps for p, sha, other in files if folder and folder == other}
    told |= {(a, p, sha, at) for a, folder, at in stamps for b, q, _, _ in edges if a == b for p, sha, other in files if p == q and folder and other and folder != other}
    got = values(rc.reviewed(spark.createDataFrame(edges, EDGES), spark.createDataFrame(files, FILES), spark.createDataFrame(stamps, STAMPS)))
    assert got == sorted(told, key=repr)


def test_reviewed_folders_are_not_shuffled_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(rc, "SIDE", 50, raising=False)
    named = lambda n, letter, *more: spark.range(n).select(F.concat(F.lit(letter), F.col("id").cast("string")), *map(F.lit, more))
    stamps, files = named(300, "a", "f", "t").toDF("artifact", "folder", "at"), named(400, "p", "s", "f").toDF("path", "sha", "folder")
    told = rc.reviewed(spark.createDataFrame([("x", "p1", "s", "t0"), ("a1", "p1", "s", "t0")], EDGES), files, stamps)
    assert most_rows(told, "shuffleRecordsWritten") <= 6_000
    counts = [r["count"] for r in told.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 300 * 400 + 1 and max(counts) < 30_000
