import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as fn
from verdigris.operators import checks, claims, identity, ledger, lineage, multiset, reshape, retrieval, upsert
from verdigris.sources import files, sinks
from verdigris.streaming import index


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def column(spark, expr, **given):
    names = list(given)
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_titles_slugs_and_citekeys(spark):
    assert column(spark, fn.norm_title(F.col("t")), t="A, B: C's Study!") == "a b cs study"
    assert column(spark, fn.ascii_slug(F.col("t")), t="Ünï-cødé ﬁx") == "unicdefix"
    assert column(spark, fn.entity_slug(F.col("t")), t=" Crème brûlée, twice ") == "creme-brulee-twice"
    key = fn.citekey_base(F.col("f"), F.lit(2017), F.col("t"))
    assert column(spark, key, f="Vaswani", t="Attention Is All You Need") == "vaswani2017attention"
    assert column(spark, fn.citekey_base(F.lit(None).cast("string"), F.lit(2020), F.col("t")), t="The great one") == "anon2020great"
    assert column(spark, fn.citekey_base(F.col("f"), F.lit(None), F.col("t")), f="Doe", t="Of Widgets") == "doendwidgets"
    rows = spark.createDataFrame([(k, "x") for k in range(30)], "id int, base string")
    assert [r.citekey for r in identity.citekeys(rows, F.col("base"), ["id"]).orderBy("id").collect()][:3] == ["x", "xa", "xb"]
    assert identity.citekeys(rows, F.col("base"), ["id"]).where("id = 29").first().citekey == "x-4"


@pytest.mark.parametrize(
    ("said", "kind", "value"),
    [("doi: 10.1/a", "doi", "10.1/a"), ("https://doi.org/10.1000/xyz", "doi", "10.1000/xyz"), ("arXiv:1706.03762", "arxiv", "1706.03762"), ("https://arxiv.org/pdf/1706.03762.pdf", "arxiv", "1706.03762"), ("PMC12345", "pmcid", "PMC12345"), ("pmid: 123456", "pmid", "123456"), ("s2:abc", "s2", "abc"), ("123456", "pmid", "123456"), ("hep-th/9901001", "arxiv", "hep-th/9901001"), ("what", "unknown", "what")],
)
def test_identifiers(spark, said, kind, value):
    assert tuple(column(spark, fn.classify_identifier(F.col("s")), s=said)) == (kind, value)


def test_folders_claims_and_status(spark):
    assert tuple(column(spark, fn.experiment_of(F.col("d")), d="EXP-04 - Rat IT Dose-Response (V1234567)")) == ("EXP-04", "Rat IT Dose-Response (V1234567)", "V1234567")
    assert column(spark, fn.experiment_of(F.col("d"), "Q"), d="Q7: Assay")[:2] == ("Q7", "Assay")
    assert column(spark, fn.experiment_of(F.col("d")), d="notes") is None
    for prefix in ("/abs/EXP-04 - Dose/analysis/claims/", "/other/"):
        assert column(spark, fn.claim_id(F.lit("EXP-04"), F.col("n")), n=prefix + "test_kd.py::test_pos_ctrl_strong") == "EXP-04::test_kd.py::test_pos_ctrl_strong"
    assert column(spark, fn.status_of(F.col("s")), s=" Completed") == "complete" and column(spark, fn.status_of(F.col("s")), s="odd") is None


def test_cells_and_tolerance(spark):
    for said, key in (("1,234", "n:1234000"), (" N/A ", None), ("Abc", "t:abc"), ("1d", "t:1d"), ("1_000", "t:1_000"), ("2e1", "n:20000000"), ("inf", "t:inf")):
        assert column(spark, fn.cell_key(F.col("s")), s=said) == key
    close = lambda a, b: column(spark, fn.close(F.lit(a), F.lit(b)))
    assert close(100.0, 100.05) and not close(100.0, 100.5) and close(float("nan"), float("nan")) and not close(1.0, float("nan"))


def test_staleness_has_one_verdict_for_each_mutation(spark):
    recorded = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha string")
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha string")
    told = ledger.staleness(recorded, disk, "path", "sha")
    assert values(told) == [("a", "current"), ("b", "changed"), ("c", "missing"), ("d", "added")]
    assert ledger.status(told.withColumn("e", F.lit(1)), ["e"]).first().status == "stale"
    assert ledger.status(ledger.staleness(recorded, recorded, "path", "sha").withColumn("e", F.lit(1)), ["e"]).first().status == "up-to-date"
    assert ledger.status(ledger.staleness(recorded.limit(0), disk, "path", "sha").withColumn("e", F.lit(1)), ["e"]).first().status == "no-provenance"
    new = spark.createDataFrame([("b", "9")], "path string, sha string")
    assert values(ledger.merged(recorded, new, "path")) == [("a", "1"), ("b", "9"), ("c", "1")]
    assert values(ledger.review_inputs(recorded, disk, disk, "path")) == [("a", "both", True), ("b", "both", True), ("c", "folder", False), ("d", "declared", True)]


def test_closure_ends_on_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "child string, parent string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert values(lineage.closure(edges, roots)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3)]
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(6)], "child string, parent string")
    start = spark.createDataFrame([("0",)], "node string")
    assert values(lineage.closure(chain, start)) == values(lineage.closure_sql(spark, chain, start))


def test_trace_of_a_clean_chain_and_its_mutations(spark):
    edges = spark.createDataFrame([("kd", "table"), ("table", "raw")], "child string, parent string")
    roots = spark.createDataFrame([("kd",)], "node string")

    def breaks(present=("kd", "table", "raw"), raw=("raw",), drifted=(), e=edges):
        nodes = spark.createDataFrame([(n, n in present, n in raw, n in drifted) for n in ("kd", "table", "raw")], "node string, present boolean, raw boolean, drifted boolean")
        found = lineage.trace(e, roots, nodes)
        sound = lineage.reaching(e, nodes.where("raw"))
        return values(found), tuple(lineage.verdicts(roots, found, sound).first())

    assert breaks() == ([], ("kd", 0, "GROUNDED", True, "GROUNDED"))
    assert breaks(drifted=("raw",))[0] == [("kd", "raw", "drifted")]
    assert breaks(present=("kd", "table"))[0] == [("kd", "raw", "missing")]
    assert breaks(e=edges.where("child = 'kd'")) == ([("kd", "table", "unsourced")], ("kd", 1, "BROKEN", False, "BROKEN"))


def test_claims(spark):
    rows = spark.createDataFrame([(1, "passed", "strong", "x"), (2, "xfail", "strong", "x"), (3, "passed", "weak", "y")], "id int, outcome string, strength string, e string")
    assert values(rows.where(claims.is_grounded(F.col("outcome"), F.col("strength"))).select("id")) == [(1,)]
    assert ("outcome", "passed", 2) in values(claims.rollup(rows, ["outcome", "strength"]))
    assert {r.e: r.counts for r in claims.per_experiment(rows, "e", "outcome").collect()} == {"x": {"passed": 1, "xfail": 1}, "y": {"passed": 1}}
    known = spark.createDataFrame([("E1::f.py::test_a", True), ("E1::f.py::test_b", False), ("E2::g.py::test_c", True), ("E3::g.py::test_c", True)], "claim_id string, grounded boolean")
    cited = spark.createDataFrame([("test_a",), ("test_b",), ("test_c",), ("E2::g.py::test_c",), ("no",)], "id string")
    assert dict(values(claims.resolved(cited, known).select("id", "verdict"))) == {"test_a": "backed", "test_b": "weak-backing", "test_c": "ambiguous", "E2::g.py::test_c": "backed", "no": "missing"}


def test_report_references_outside_fences(spark):
    text = "# T\nsee [claim:test_b] and [claim: test_pos_ctrl[100]]\n```\n[claim:hidden]\n~~~\n```\n![a](p.png \"t\") [claim:test_b]\n~~~\n[claim:open]"
    reports = spark.createDataFrame([("r", text)], "name string, text string")
    found = claims.references(reports, "name", "text", claims.CITATION)
    assert values(found) == [("r", 2, 0, "test_b"), ("r", 2, 1, "test_pos_ctrl[100]"), ("r", 7, 0, "test_b")]
    assert values(claims.footnotes(found)) == [("r", "test_b", 1), ("r", "test_pos_ctrl[100]", 2)]
    assert values(claims.references(reports, "name", "text", claims.EMBED)) == [("r", 7, 0, "p.png")]


def test_multisets_and_typing(spark):
    a, b = (multiset.counts(spark.createDataFrame([(x,) for x in xs], "v string"), fn.cell_key(F.col("v"))) for xs in (["1", "1.0", "x", "NA"], ["1", "X"]))
    assert values(multiset.difference(a, b)) == [("n:1000000", 2, 1, 1)]
    cells = spark.createDataFrame([("007", "7", "a"), ("012", "8", "")], "i string, n string, t string")
    assert {r.name: r.kind for r in multiset.typed_columns(cells, cells.columns).collect()} == {"i": "identifier", "n": "integer", "t": "text"}


def test_upserts_and_checks(spark):
    old = spark.createDataFrame([(1, "a", "t0", "t0"), (2, "b", "t0", "t0")], "id int, v string, added string, updated string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    once = upsert.upserted(old, new, ["id"], "added", "updated", F.lit("t1"))
    assert values(once) == [(1, "a", "t0", "t0"), (2, "B", "t0", "t1"), (3, "C", "t1", "t1")]
    assert values(upsert.upserted(once, new, ["id"], "added", "updated", F.lit("t1"))) == values(once)
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, s string")
    assert values(upsert.pruned(rows, rows.where("id = 1"), "id", "s", rows.where("s = 'x'"))) == [(1, "x"), (3, "y")]
    assert column(spark, upsert.edited_tags(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c")), F.array(F.lit("a")))) == ["b", "c"]
    members = spark.createDataFrame([("z1", "f"), ("z1", "g"), ("z2", "h")], "z string, m string")
    assert values(checks.redundant(members, "z", "m", members.where("m <> 'h'").select("m"))) == [("z1", 2)]
    assert checks.same_rows(rows, rows.orderBy(F.desc("id"))) and not checks.same_rows(rows, rows.limit(1))


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, "stone")], "id int, text string")
    best = retrieval.top(retrieval.bm25(docs, "id", "text", ["red", "apple"]), "id")
    assert [r.id for r in best.orderBy("rank").collect()] == [1, 2]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0])], "id int, v array<double>")
    assert [r.score for r in retrieval.nearest(vectors, "id", "v", [0.0, 1.0]).orderBy("id").collect()] == [0.0, 1.0, None]
    parts = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 3, "c"), ("e", 1, "x")], "d string, i int, t string")
    assert values(retrieval.leading_text(parts, "d", "i", "t", 4)) == [("d", "a\nb"), ("e", "")]


XML = b"""<GraphPadPrismFile xmlns="http://x"><Table><Title>Column Assay</Title><XColumn><Subcolumn/></XColumn>
<YColumn><Title>A</Title><Subcolumn><d>1.5</d><d>3</d></Subcolumn></YColumn><YColumn><Title>B</Title><Subcolumn><d>2</d><d>4.25</d><d>5</d></Subcolumn></YColumn></Table></GraphPadPrismFile>"""


def test_prism_tables(spark):
    raw = spark.createDataFrame([(bytearray(XML),)], "content binary").select(F.explode(files.prism_xml(F.col("content"))).alias("t")).select("t.*")
    flat = reshape.wide(raw).first()
    assert (flat.title, flat.header) == ("Column Assay", ["", "A_0", "B_1"])
    assert flat.rows == [["0", "1.5", "2"], ["1", "3", "4.25"], ["2", "", "5"]]
    assert values(reshape.tidy(raw).select("group", "row", "value")) == [("A", 0, "1.5"), ("A", 1, "3"), ("B", 0, "2"), ("B", 1, "4.25"), ("B", 2, "5")]
    kinds = spark.createDataFrame([(bytearray(b"PK\x03\x04xxxx"),), (bytearray(b"PCFFGRA4zz"),), (bytearray(XML),)], "c binary").select(files.prism_container(F.col("c")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["zip", "binary", "xml"]


def test_walk_and_members(spark, tmp_path):
    for name, data in {"README.md": b"hi", "data/w.csv": b"a,b\n1,2\n", "raw/~$r.docx": b"x", "raw/.DS_Store": b"x", ".venv/m.py": b"x", "raw/empty.bin": b"", "raw/_x.bin2": b"z"}.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    found = {r.relative: (r.kind, r.role, r.size) for r in files.walk(spark, str(tmp_path)).collect()}
    assert found["README.md"] == ("narrative", "readme", 2) and found["data/w.csv"] == ("tabular", "data", 8)
    assert not {"raw/~$r.docx", "raw/.DS_Store", ".venv/m.py", "raw/empty.bin"} & found.keys()
    assert values(files.text_table(spark, str(tmp_path / "data/w.csv"))) == [("1", "2")]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/b.txt", "x")
        z.writestr("__MACOSX/b.txt", "x")
    packed = spark.createDataFrame([(bytearray(buffer.getvalue()),), (bytearray(b"no"),)], "c binary")
    assert [r.m for r in packed.select(files.zip_members(F.col("c")).alias("m")).collect()] == [["a/b.txt"], None]
    assert files.sidecar(json.dumps({"exp_id": "K1", "id_columns": ["g"]}))["id_columns"] == ["g"]


def test_sinks(spark):
    rows = spark.createDataFrame([(2, 'say "x"'), (1, None)], "id int, t string")
    assert [r.text for r in sinks.csv_lines(rows, ["id"]).collect()] == ["1,", '2,"say ""x"""']
    assert column(spark, sinks.card(F.lit("T"), {"a": F.lit("1"), "b": F.lit(None)}, F.lit("body"))) == "# T\n- a: 1\nbody"
    page = spark.createDataFrame([(1, "</script>")], "id int, t string")
    assert sinks.page_json(page, "id").first().json == '{"id":1,"t":"<\\/script>"}'


def test_stream_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, content string").withColumn("ts", F.timestamp_seconds(F.col("id")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = index.first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "content", "ts")
    run = index.upserting(stream, str(tmp_path / "checkpoint"), lambda batch, _: seen.extend(r.content for r in batch.collect()))
    run.awaitTermination(60)
    assert sorted(seen) == ["a", "b"]
