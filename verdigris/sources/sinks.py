"""Sinks: deterministic text of records and tables. Cards are columns; only what is small is joined into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import human_bytes


def csv_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """A line of CSV for each row, in order: line, text; quotes only where they are needed."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return rows.orderBy(*order).select(F.concat_ws(",", *[quoted(cell(c)) for c in rows.columns]).alias("text"))


def card(title: Column, facts: dict[str, Column], body: Column | None = None) -> Column:
    """A markdown card: heading, the facts that there are, and a body."""
    lines = [F.concat(F.lit("# "), title)] + [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"- {k}: "), v.cast("string"))) for k, v in facts.items()]
    return F.array_join(F.array_compact(F.array(*lines, *([body] if body is not None else []))), "\n")


def bibtex(kind: Column, citekey: Column, fields: dict[str, Column]) -> Column:
    """An entry of the fields that there are."""
    lines = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"  {k} = {{"), v.cast("string"), F.lit("}"))) for k, v in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), citekey, F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n}"))


def page_json(rows: DataFrame, key: str) -> DataFrame:
    """JSON of each record in order, safe inside a script element."""
    return rows.orderBy(key).select(F.replace(F.to_json(F.struct(*rows.columns)), F.lit("</"), F.lit("<\\/")).alias("json"))


#: The fields of an experiment's sidecar in the order in which they are written.
SIDECAR = ["exp_id", "name", "title", "status", "synopsis", "key_findings", "cro", "cro_study_ids", "species", "model", "assays", "asos", "dates", "related"]


def sidecar_json(columns: dict[str, Column], provenance: Column | None = None) -> Column:
    """A sidecar as JSON, which YAML readers know, with its fields in one order: the same record, the same bytes."""
    fields = [columns[f].alias(f) for f in SIDECAR if f in columns]
    return F.to_json(F.struct(*fields, *([F.array_sort(provenance).alias("provenance")] if provenance is not None else [])))


def experiment_card(record: dict[str, Column]) -> Column:
    """The card of an experiment: its facts, synopsis, findings and related experiments, lists sorted."""
    text = lambda f: F.nullif(F.trim(record[f].cast("string")), F.lit("")) if f in record else F.lit(None).cast("string")
    listed = lambda f: F.array_join(F.array_sort(record[f]), ", ") if f in record else F.lit(None).cast("string")
    facts = {"Internal ID": text("exp_id"), "Study IDs": listed("cro_study_ids"), "CRO": text("cro"), "Status": text("status"), "Model": F.coalesce(text("model"), text("species")), "Assays": listed("assays"), "Dates": text("dates")}
    section = lambda heading, body: F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"\n## {heading}\n\n"), body))
    related = F.array_join(F.transform(F.array_sort(record["related"]), lambda r: F.concat(F.lit("- "), r)), "\n") if "related" in record else F.lit(None).cast("string")
    title = F.concat(record["exp_id"], F.lit(": "), F.coalesce(text("title"), text("name"), text("exp_id")))
    parts = [card(title, facts), section("Synopsis", text("synopsis")), section("Key findings", text("key_findings")), section("Related experiments", related)]
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def claim_card(claim_id: Column, outcome: Column, strength: Column, statement: Column, evidence: Column) -> Column:
    """The card of a claim: its outcome first, then the statement and the evidence, sorted by name. evidence: a map of texts."""
    lines = F.transform(F.array_sort(F.map_entries(evidence)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# ["), F.upper(outcome), F.lit("] "), claim_id), F.concat(F.lit("strength: "), F.coalesce(strength, F.lit("unspecified"))), statement), lines), "\n")


def file_card(path: Column, role: Column, size: Column, columns: Column | None = None, preview: Column | None = None) -> Column:
    """The card of a file: where it is, its columns and first rows, or its size alone."""
    facts = {"Role": role, "Size": human_bytes(size), "Columns": F.array_join(columns, ", ") if columns is not None else F.lit(None).cast("string")}
    shown = F.when(preview.isNotNull(), F.concat(F.lit("\n```\n"), preview, F.lit("\n```"))) if preview is not None else None
    return card(path, facts, shown)


def report_card(report_id: Column, title: Column, abstract: Column, cited: Column) -> Column:
    """The card of a report with the ids it cites, sorted, each once."""
    return card(title, {"Report": report_id, "Cites": F.array_join(F.array_sort(F.array_distinct(cited)), ", ")}, F.concat(F.lit("\n"), F.coalesce(abstract, F.lit(""))))


def viewer_page(rows: DataFrame, key: str, title: str) -> DataFrame:
    """A page that shows records: head, a line for each record's JSON, tail; line, text. Records are lines of a script element, so no task holds them all."""
    head = f'<!doctype html><meta charset="utf-8"><title>{title}</title><ul id="list"></ul><script type="application/x-ndjson" id="records">'
    tail = '</script><script>for (const line of document.getElementById("records").textContent.trim().split("\\n")) { const item = document.createElement("li"); item.textContent = line; document.getElementById("list").append(item); }</script>'
    body = rows.select(F.lit(1).alias("part"), F.col(key).cast("string").alias("key"), F.replace(F.to_json(F.struct(*rows.columns)), F.lit("</"), F.lit("<\\/")).alias("text"))
    frame = rows.sparkSession.createDataFrame([(0, "", head), (2, "", tail)], "part int, key string, text string")
    return frame.unionByName(body)


def write_outputs(tables: dict[str, DataFrame], folder: str, commit: bool = False) -> str:
    """Writes an extraction's tables as deterministic CSV lines: a preview beside the data unless committed. Returns where."""
    at = f"{folder.rstrip('/')}/{'data' if commit else '.preview'}"
    for name, table in tables.items():
        csv_lines(table, list(table.columns)).write.mode("overwrite").text(f"{at}/{name}")
    return at
