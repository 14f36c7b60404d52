"""Names, reports, imports and audits on small cases."""

import time

import pytest
from pyspark.sql import functions as F

from verdigris.functions import names as nm
from verdigris.functions import text as fn
from verdigris.operators import audits, capture, claims, identity, ingest, reports, upsert
from verdigris.sources import files, kept, sinks
from verdigris.streaming import index


def column(spark, expression, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(expression.alias("x")).first().x


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_identifiers(spark):
    told = {"https://doi.org/10.1/doi.org/x": ("doi", "10.1/doi.org/x"), "HTTPS://DX.DOI.ORG/10.1/y": ("doi", "10.1/y"), "doi: 10.5/z": ("doi", "10.5/z"), "arXiv:2101.00001v2": ("arxiv", "2101.00001v2"),
            "https://arxiv.org/pdf/2101.00001.pdf": ("arxiv", "2101.00001"), "PMCID: PMC12": ("pmcid", "PMC12"), "pmc9": ("pmcid", "PMC9"), "PMID: 1 2": ("pmid", "12"), "CorpusId:7": ("s2", "7"), "12345": ("pmid", "12345"), "word": ("unknown", "word")}
    rows = spark.createDataFrame([(k,) for k in told], "s string").select("s", fn.classify_identifier(F.col("s")).alias("i")).collect()
    assert {r.s: tuple(r.i) for r in rows} == told
    ids = lambda f, s: [tuple(x) for x in column(spark, f(F.col("s")), s=s)]
    assert ids(nm.ids_in_filename, "s41598_024_55666_6.pdf") == [("doi", "10.1038/s41598-024-55666-6")]
    assert ids(nm.ids_in_filename, "nbt_3779.pdf") == [("doi", "10.1038/nbt.3779")] and ids(nm.ids_in_filename, "xyz_3779.pdf") == []
    assert ids(nm.ids_in_filename, "317_pmc9283931.pdf") == [("pmcid", "PMC9283931")]
    assert ids(nm.ids_in_text, "see arXiv 2101.00001v1, doi 10.1234/ab.c). PMC7") == [("arxiv", "2101.00001"), ("doi", "10.1234/ab.c"), ("pmcid", "PMC7")]
    assert ids(nm.ids_in_text, "version 2101.00001") == []


def test_names(spark):
    one = lambda f, s: column(spark, f(F.col("s")), s=s)
    assert one(nm.filename_query, "012_smith_2019_a-study_v2.pdf") == "smith 2019 a study" and one(nm.filename_year, "012 smith 2019.pdf") == 2019
    assert one(nm.topic_tag, "02_target_biology/x.pdf") == "topic:target-biology" and one(nm.topic_tag, "x.pdf") is None
    assert one(nm.short_authors, "Doe, A; Roe, B; Poe, C") == "Doe et al." and one(nm.short_authors, None) == "?"
    assert one(nm.sanitize, ' a<b>: "c"... ') == "a b c" and one(nm.sanitize, "") == "untitled"
    assert one(lambda c: nm.sanitize(c, 9), "alpha beta gamma") == "alpha"
    assert one(lambda c: nm.report_id(F.lit("program"), F.lit(None).cast("string"), c), "tox") == "program::tox"
    assert tuple(one(lambda c: nm.report_scope(c, "EXP-"), "EXP-4 - Dose/reports/summary.md")) == ("experiment", "EXP-4", "summary")
    assert one(lambda c: nm.relative(c, "/home/me"), "/home/me/a/b.csv") == "a/b.csv" and one(lambda c: nm.relative(c, "/home/me"), "/else/b.csv") == "b.csv"
    assert tuple(one(nm.before_references, "text\nReferences\n1.")) == ("text\n", "References\n1.") and tuple(one(nm.before_references, "text")) == ("text", "")
    assert one(lambda c: nm.quoted(c, F.lit("two  words")), "some two\nwords here")
    assert one(nm.well_named, "01_dose_table.csv") and not one(nm.well_named, "Dose.csv")
    assert one(nm.tolerant_map, '{"a": 1}') == {"a": "1"} and one(nm.tolerant_map, "no") == {}
    assert one(lambda c: nm.cell_text(c.cast("double")), "3.0") == "3" and one(lambda c: nm.cell_text(c.cast("double")), "0.25") == "0.25"
    assert one(lambda c: nm.moment_text(c.cast("timestamp")), "2024-05-01 00:00:00") == "2024-05-01"
    assert one(lambda c: fn.cell_key(c), "10000000000000") == one(lambda c: fn.cell_key(c), "1e13") != one(lambda c: fn.cell_key(c), "1.0000000000001e13")
    assert one(lambda c: fn.citekey_base(F.lit(""), F.lit(2020), F.lit("On Dose"), authors=c), "Núñez, A; B") == "nunez2020dose"
    assert one(lambda c: fn.human_bytes(c.cast("long")), "1536") == "1.5 KB"


def test_fences_are_folded_in_linear_time(spark):
    text = "\n".join(f"line {k} [claim:c{k}]" for k in range(60_000)) + "\n```\n[claim:hidden]\n```\n[claim:last]"
    began = time.time()
    found = claims.references(spark.createDataFrame([("r", text)], "report string, text string"), "report", "text", claims.CITATION)
    assert found.count() == 60_001 and time.time() - began < 60
    lines = spark.createDataFrame([("a\n```\nb\n~~~\n```\nc\n~~~\nd",)], "t string").select(claims.unfenced(F.col("t")).alias("x")).first().x
    assert [tuple(x) for x in lines] == [(1, "a"), (6, "c")]


def test_report_audit_of_each_mutation(spark):
    text = "# T\n[claim:a] [claim:E::f::b] [claim:c] [claim:none]\n![x](analysis/ok.csv) ![y](analysis/gone.csv) ![z](analysis/edited.csv)\n![u](analysis/loose.csv) ![d](analysis/nowhere.csv) ![r](https://e.org/x.png)"
    told = spark.createDataFrame([("r", text), ("empty", "")], "report string, text string")
    known = spark.createDataFrame([("E::f::a", "passed", "strong", "s"), ("E::f::b", "failed", "strong", "s"), ("E::f::c", "passed", "strong", "s"), ("G::f::c", "passed", "strong", "s")], "claim_id string, outcome string, strength string, statement string")
    recorded = spark.createDataFrame([(f"analysis/{n}.csv", "1") for n in ("ok", "gone", "edited")], "path string, sha string")
    disk = spark.createDataFrame([("analysis/ok.csv", "1"), ("analysis/edited.csv", "2"), ("analysis/loose.csv", "3")], "path string, sha string")
    found = reports.audited(told, known, recorded, disk)
    assert {r.ref.rsplit("/", 1)[-1]: r.verdict for r in found.collect()} == {"a": "backed", "E::f::b": "weak-backing", "c": "ambiguous", "none": "missing", "ok.csv": "current", "gone.csv": "missing", "edited.csv": "drifted", "loose.csv": "untracked", "nowhere.csv": "dangling", "x.png": "untracked"}
    assert values(reports.audit_status(told, found)) == [("empty", 0, 0, 0, "GROUNDED"), ("r", 4, 6, 8, "BROKEN")]
    notes = [r.text for r in reports.assembled(told, known).where("section = 1").orderBy("line").collect()]
    assert notes[0] == "[^claim-1]: **E::f::a** — s _[passed · strong]_" and notes[2].endswith("(ambiguous)") and notes[3].endswith("(unresolved)")


def test_sections(spark):
    text = "# Title\n\nFirst para\nmore [claim:x].\n\nSecond\n\n## Method ##\n\n### Detail\nline one\nline two\n\nother"
    rows = reports.sections(spark.createDataFrame([("r", text)], "report string, text string"))
    assert [tuple(r)[1:] for r in rows.orderBy("number").collect()] == [(0, None, "First para more ."), (1, "Method ##", ""), (2, "Detail", "line one line two")]


def test_prune_in_one_scope_only(spark):
    rows = spark.createDataFrame([("k", "A"), ("k", "B"), ("j", "A")], "key string, scope string")
    left = upsert.pruned(rows, rows.where("key = 'j'"), "key", "scope", spark.createDataFrame([("A",)], "scope string"))
    assert values(left) == [("j", "A"), ("k", "B")]


def test_numbers_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'anon' else concat('k', id % 7) end as base")
    got = identity.numbered(rows, "base", ["id"], "n").collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.id):
        seen[r.base] = seen.get(r.base, 0) + 1
        assert r.n == seen[r.base]
    assert len(got) == 5000


def test_imports(spark):
    shape = "id int, doi string, sha string"
    catalog = spark.createDataFrame([(1, "d1", "s1")], shape)
    new = spark.createDataFrame([(5, "d1", "s5"), (6, None, "s5"), (7, None, None), (8, "", "s8"), (9, "d9", "s8")], shape)
    plan = ingest.planned(new, catalog, {"doi": F.col("doi"), "sha": F.col("sha")}, "id", "id")
    assert values(plan) == [(5, "duplicate", 1, "doi"), (6, "duplicate", 5, "sha"), (7, "added", None, None), (8, "added", None, None), (9, "duplicate", 8, "sha")]
    shaped = lambda df: df.select("id", "doi", F.array(F.col("id").cast("string")).alias("tags"), F.col("id").cast("string").alias("path"))
    merged = {r.id: (r.doi, r.tags, r.origins) for r in ingest.merged(shaped(catalog), shaped(new), plan, "id", ["doi"], "path").collect()}
    assert merged == {1: ("d1", ["1", "5", "6"], ["1", "5", "6"]), 7: (None, ["7"], ["7"]), 8: ("d9", ["8", "9"], ["8", "9"])}


def test_intake(spark):
    sources = spark.createDataFrame([("in/RAW/a/x.eds",), ("in/y.fcs",), ("in/z.pdf",), ("in/.DS_Store",), ("in/~$z.pdf",)], "source string")
    plan = ingest.routed(sources, spark.createDataFrame([("z.pdf", "reports")], "name string, folder string"), spark.createDataFrame([("raw/y.fcs",)], "path string"))
    assert values(plan) == [("in/RAW/a/x.eds", "raw", "raw/a/x.eds", "path", False), ("in/y.fcs", "raw", "raw/y.fcs", "ext", True), ("in/z.pdf", "reports", "reports/z.pdf", "agent", False)]


def test_files_change_hands(spark):
    old = spark.createDataFrame([("a", "1", "a", "t0", "t0"), ("b", "2", "b", "t0", "t0"), ("z", "9", "z", "t0", "t0")], "path string, sha string, primary_path string, added_at string, updated_at string")
    scanned = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "1"), ("0", "2")], "path string, sha string")
    assert values(ingest.file_snapshot(old, scanned, F.lit("t1"))) == [("0", "2", "b", "t1", "t1", "duplicate"), ("a", "2", "b", "t0", "t1", "replaced"), ("b", "2", "b", "t0", "t0", "unchanged"), ("c", "1", "c", "t1", "t1", "added")]


def test_staleness_of_odd_ledgers(spark):
    shape = "experiment string, artifact string, artifact_sha string, reviewed_at string, path string, sha string"
    edges = spark.createDataFrame([("e", "d", "1", "t", "r", "1"), ("f", "g", "1", "t", None, None)], shape)
    disk = spark.createDataFrame([("d", "1"), ("r", "1"), ("new", "5")], "path string, sha string")
    folder = lambda *paths: spark.createDataFrame([("e", p) for p in paths] or [("z", "q")], "experiment string, path string")
    states = lambda e, d, f: {r.experiment: r.state for r in audits.staleness(e, d, f).collect()}
    assert states(edges, disk, folder("r", "d")) == {"e": "up-to-date", "f": "no-provenance"}
    assert states(edges, disk, folder("r", "new"))["e"] == "stale"
    assert states(edges, disk.where("path <> 'd'"), folder("r"))["e"] == "stale" and states(edges, disk.where("path <> 'r'"), folder("r"))["e"] == "stale"


def test_change_log_and_tables(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert values(index.change_log(old, new, "k", "t")) == [(1, "removed", "t"), (2, "changed", "t"), (3, "added", "t")]
    assert column(spark, audits.markdown_table(F.col("t"), F.lit("n")), t="a,b\n1\n2,3,4\n") == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert column(spark, audits.markdown_table(F.col("t"), F.lit("n")), t="") == "_(empty table: n)_"
    entry = column(spark, sinks.bibtex(F.lit("article"), F.lit("k"), {"title": F.col("t"), "year": F.lit(None).cast("int")}), t="T")
    assert entry == "@article{k,\n  title = {T}\n}"


def test_a_cluster_must_name_its_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        kept.shared_folder(Session)


def test_cards_and_pages(spark, tmp_path):
    row = spark.createDataFrame([("E1", "Dose", ["b", "a"], "passed", {"z": "1", "a": None})], "exp_id string, title string, assays array<string>, outcome string, evidence map<string,string>")
    shown = row.select(sinks.experiment_card({c: F.col(c) for c in ("exp_id", "title", "assays")}).alias("e"), sinks.claim_card(F.lit("c"), F.col("outcome"), F.lit(None).cast("string"), F.lit("It holds."), F.col("evidence")).alias("c"), sinks.file_card(F.lit("a.csv"), F.lit("data"), F.lit(2048), F.array(F.lit("x"), F.lit("y")), F.lit("x,y\n1,2")).alias("f"), sinks.report_card(F.lit("r"), F.lit("T"), F.lit("Abstract."), F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("r"), sinks.sidecar_json({"title": F.col("title"), "exp_id": F.col("exp_id")}).alias("s")).first()
    assert shown.e == "# E1: Dose\n- Internal ID: E1\n- Assays: a, b"
    assert shown.c == "# [PASSED] c\nstrength: unspecified\nIt holds.\n- a: \n- z: 1"
    assert shown.f == "# a.csv\n- Role: data\n- Size: 2.0 KB\n- Columns: x, y\n\n```\nx,y\n1,2\n```" and "- Cites: a, b\n" in shown.r
    assert shown.s == '{"exp_id":"E1","title":"Dose"}'
    lines = sinks.viewer_page(spark.createDataFrame([(1, "</script>")], "k int, t string"), "k", "P").orderBy("part").collect()
    assert [r.part for r in lines] == [0, 1, 2] and "</script>" not in lines[1].text
    at = sinks.write_outputs({"01_dose_table.csv": spark.createDataFrame([(2, 'a "b"'), (1, None)], "k int, v string")}, str(tmp_path))
    assert at.endswith(".preview") and [r.value for r in spark.read.text(f"{at}/01_dose_table.csv").collect()] == ["1,", '2,"a ""b"""']


def test_tracked_tables_and_folders(spark, tmp_path):
    (tmp_path / "01_dose.csv").write_text("id,n\n007,1\n012,2\n")
    rows, read = files.tracked_table(spark, str(tmp_path / "01_dose.csv"))
    assert values(rows) == [("007", 1), ("012", 2)] and len(read.first().sha256) == 64
    walked = spark.createDataFrame([("E1/analysis/claims/t.py",), ("E1/notes.md",), ("E1/Raw/x.csv",)], "relative string")
    assert values(files.evidence(walked)) == [("E1/Raw/x.csv",), ("E1/analysis/claims/t.py",)] and values(files.claims_folders(walked)) == [("E1/analysis/claims",)]
    assert column(spark, files.table_name(F.col("f")), f="a/01_dose.csv") == "dose"
    found = ingest.folder_of(spark.createDataFrame([("E1 - A", "E1"), ("E1 - B", "E1")], "folder string, exp_id string"), spark.createDataFrame([("E1",), ("E1 - A",)], "asked string"))
    assert files.resolve_folder(found, "E1 - A") == "E1 - A"
    with pytest.raises(ValueError):
        files.resolve_folder(found, "E1")


def test_plans_tell_what_they_read(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("a\n1\n")
    (tmp_path / "other.csv").write_text("a\n1\n2\n")
    one, two = (files.text_table(spark, str(tmp_path / n)) for n in ("raw.csv", "other.csv"))
    out, edges = capture.derived(spark, "data/x.csv", lambda a, b: a.join(b, "a"), one, two, recipe=str(tmp_path / "raw.csv"))
    assert values(out) == [("1",)] and {r.path.rsplit("/", 1)[-1] for r in edges.collect()} == {"raw.csv", "other.csv"}
    assert capture.bypasses(capture.read_files(out), str(tmp_path), [str(tmp_path / "raw.csv")]) == [str(tmp_path / "other.csv")]
    assert capture.bypasses(["/elsewhere/x.csv", str(tmp_path / "x.py")], str(tmp_path), []) == []
    assert capture.edges_of(spark, "a", spark.range(1)).count() == 0
    assert [tuple(capture.claim("c", one.where(w), expected_failure=e).first())[1] for w, e in (("a > 5", False), ("a > 0", False), ("a > 0", True), ("a > 5", True))] == ["passed", "failed", "xfail", "xpass"]
