"""Names: of files, authors, reports and experiments, and the identifiers that stand in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import ARXIV, DOI, collapse, nfc

#: Journals whose old file names hold a DOI, headings of the references, the naming rule of data files.
LEGACY_JOURNALS = ["nbt", "nmeth", "ng", "nm", "ni", "nn", "nchem", "nphys"]
REFERENCES = r"(?i)\b(references|bibliography|works cited|literature cited)\b"
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
WORK_KINDS = {"journal-article": "article", "proceedings-article": "inproceedings", "book-chapter": "incollection", "book": "book", "posted-content": "misc", "report": "techreport"}
DATA_FILE = r"^[0-9]{2}_[a-z0-9]+_[a-z0-9_]+(__[a-z0-9_]+)?\.csv$"


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern finds first, null for nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _id(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("value")))


def stem(name: Column) -> Column:
    """A file's name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def ids_in_text(text: Column) -> Column:
    """array of struct(kind, value): the first arXiv id of a text that speaks of arXiv, the first DOI, the first PMC id."""
    doi = F.regexp_replace(_first(text, DOI), r"[.,;)]+$", "")
    arxiv = F.when(F.lower(text).contains("arxiv"), _first(text, r"\b([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?\b", 1))
    return F.array_compact(F.array(_id("arxiv", arxiv), _id("doi", doi), _id("pmcid", F.concat(F.lit("PMC"), _first(text, "(?i)pmc([0-9]+)", 1)))))


def ids_in_filename(name: Column) -> Column:
    """array of struct(kind, value): what a file's name may hold, as guesses to be verified."""
    s = stem(name)
    slashed = F.regexp_replace(s, "^([^_]*)_", "$1/")
    doi = F.regexp_replace(F.coalesce(_first(slashed, DOI), _first(s, DOI)), r"[.,;)]+$", "")
    springer = r"^(?i)(s[0-9]{4,6})_([0-9]{2,4})_([0-9]{3,6})_([0-9]{1,2})$"
    journal = r"^(?i)([a-z]{2,6})_([0-9]{3,5})$"
    old = F.when(F.lower(F.regexp_extract(s, journal, 1)).isin(LEGACY_JOURNALS), F.concat(F.lit("10.1038/"), F.lower(F.regexp_extract(s, journal, 1)), F.lit("."), F.regexp_extract(s, journal, 2)))
    dashed = F.when(s.rlike(springer), F.concat(F.lit("10.1038/"), F.concat_ws("-", *[F.regexp_extract(s, springer, k) for k in (1, 2, 3, 4)])))
    return F.array_compact(F.array(_id("doi", doi), _id("pmcid", F.concat(F.lit("PMC"), _first(s, "(?i)pmc([0-9]+)", 1))), _id("doi", dashed), _id("doi", old)))


def merged_ids(*lists: Column) -> Column:
    """Candidate ids of several sources in their order, each once."""
    return F.array_distinct(F.concat(*lists))


def is_arxiv(value: Column) -> Column:
    return value.rlike(f"^{ARXIV}$")


def filename_query(name: Column) -> Column:
    """What a file's name says of author, year and title: marks of stubs and versions and bare numbers but years go."""
    s = F.regexp_replace(stem(name), r"^\(n\.d\.\)\s*-\s*", "")
    words = F.split(F.regexp_replace(F.regexp_replace(s, r"[_-]+", " "), r"(?i)\bv[0-9]+\b", ""), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & (~w.rlike("^[0-9]+$") | w.rlike("^(19|20)[0-9]{2}$"))), " ")


def filename_year(name: Column) -> Column:
    return _first(stem(name), r"\b((?:19|20)[0-9]{2})\b", 1).cast("int")


def topic_tag(path: Column) -> Column:
    """topic:<slug> of the first folder of a path, null for a file without one."""
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1))
    slug = F.lower(F.btrim(F.replace(F.regexp_replace(top, "^[0-9]+[_-]*", ""), F.lit("_"), F.lit("-")), F.lit("-")))
    return F.when(slug != "", F.concat(F.lit("topic:"), slug))


def legacy_id(name: Column) -> Column:
    """Three digits that a name begins with, before a separator."""
    return _first(base_name(name), "^([0-9]{3})[_-]", 1)


def work_kind(kind: Column) -> Column:
    """The entry type of a registry's work type; article for others."""
    told = F.lit("article")
    for said, entry in WORK_KINDS.items():
        told = F.when(kind == said, entry).otherwise(told)
    return told


def authors_text(authors: Column) -> Column:
    """'Family, Given; Family, Given' of array of struct(family, given)."""

    def said(a: Column) -> Column:
        family, given = F.coalesce(a["family"], F.lit("")), F.coalesce(a["given"], F.lit(""))
        return F.when(family == "", given).when(given == "", family).otherwise(F.concat(family, F.lit(", "), given))

    return F.array_join(F.filter(F.transform(authors, said), lambda x: x != ""), "; ")


def short_authors(text: Column) -> Column:
    """One name, two with an ampersand, or the first et al.; ? for none."""
    names = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p) != ""), lambda p: F.trim(F.substring_index(p, ",", 1)))
    n = F.size(names)
    return F.when(n == 0, "?").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.array_join(names, " & ")).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))


def sanitize(text: Column, most: int = 120, plain: bool = False) -> Column:
    """A text as one part of a path: composed, without what file systems refuse, cut at a space; untitled for nothing."""
    whole = F.coalesce(text, F.lit(""))
    tidy = F.btrim(F.trim(collapse(F.regexp_replace(whole if plain else nfc(whole), ILLEGAL, " "))), F.lit(". "))
    cut = F.substring(tidy, 1, most)
    short = F.btrim(F.when(cut.contains(" "), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut), F.lit(". "))
    return F.coalesce(F.nullif(F.when(F.length(tidy) > most, short).otherwise(tidy), F.lit("")), F.lit("untitled"))


def author_folder(authors: Column, text: Column, plain: bool = False) -> Column:
    """The folder of the first author: 'Family, Given', else the first of the authors' text, else Unknown."""
    first = F.get(authors, F.lit(0))
    family = F.nullif(first["family"], F.lit(""))
    named = F.when(family.isNotNull(), F.regexp_replace(F.trim(F.concat(family, F.lit(", "), F.coalesce(first["given"], F.lit("")))), ",+$", ""))
    listed = F.when(F.coalesce(text, F.lit("")) != "", F.trim(F.substring_index(text, ";", 1)))
    return sanitize(F.coalesce(named, listed, F.lit("Unknown")), 80, plain)


def paper_filename(authors: Column, year: Column, title: Column, suffix: Column, plain: bool = False) -> Column:
    """'Authors (Year) - Title.ext'."""
    said = F.concat(short_authors(authors), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(") - "), sanitize(title, plain=plain))
    return F.concat(sanitize(said, 180, plain), F.when(suffix.startswith("."), suffix).otherwise(F.concat(F.lit("."), suffix)))


def report_id(scope: Column, experiment: Column, slug: Column) -> Column:
    said = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.coalesce(said(experiment), said(scope), F.lit("report")), F.lit("::"), slug)


def relative(path: Column, root: str) -> Column:
    """A path relative to a root: a relative one stays, one outside of the root is its name."""
    at = root.rstrip("/") + "/"
    return F.when(~path.startswith("/"), path).when(path.startswith(at), F.substring(path, F.lit(len(at) + 1), F.length(path))).otherwise(base_name(path))


def under(path: Column, folder: str) -> Column:
    return F.concat(F.lit("/"), path).contains(f"/{folder}/")


def artifact_kind(artifact: Column) -> Column:
    return F.when(artifact.startswith("data/"), "data").when(artifact.startswith("analysis/"), "analysis").when(artifact.startswith("README"), "readme").otherwise("other")


def short_claim(claim: Column) -> Column:
    """The last part of a claim's id."""
    return F.substring_index(claim, "::", -1)


def report_scope(path: Column, prefix: str) -> Column:
    """struct(scope, exp_id, slug) of a report's path: an experiment's if a folder on the way is one's, else the program's."""
    exp_id = _first(F.concat(F.lit("/"), path), rf"/({prefix}[A-Za-z0-9]+)[^/]*/", 1)
    return F.struct(F.when(exp_id.isNull(), "program").otherwise("experiment").alias("scope"), exp_id.alias("exp_id"), stem(path).alias("slug"))


def numbered_mentions(text: Column, word: str) -> Column:
    """Mentions such as 'ASO 7', 'ASO-07' as 'ASO-7', each once, by their number."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b{word}[\s-]?([0-9]{{1,4}})\b"), F.lit(1)), lambda n: n.cast("int"))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda n: F.concat(F.lit(f"{word}-"), n.cast("string")))


def study_ids(text: Column, patterns: list[str]) -> Column:
    """What the patterns find, in their order, white space collapsed, each once."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({p})"), F.lit(1)), lambda x: collapse(x)) for p in patterns]
    return F.array_distinct(F.concat(*found))


def related(text: Column, prefix: str, but: Column) -> Column:
    """Ids of other experiments that a text names, in order."""
    return F.filter(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({prefix}[0-9]+)\b"), F.lit(1)))), lambda x: x != but)


def before_references(text: Column) -> Column:
    """struct(before, after) around the first heading of the references; without one, all is before."""
    at = F.regexp_instr(text, F.lit(REFERENCES))
    cut = F.when(at > 0, at).otherwise(F.length(text) + 1)
    return F.struct(F.substring(text, F.lit(1), cut - 1).alias("before"), F.substring(text, cut, F.length(text)).alias("after"))


def quoted(text: Column, quote: Column) -> Column:
    """Whether a quote stands in a text, whatever the white space."""
    return F.contains(collapse(text), collapse(quote))


def cell_text(number: Column) -> Column:
    """A number as a cell shows it: whole ones without a fraction."""
    return F.when(number.isNull(), "").when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def moment_text(moment: Column) -> Column:
    """A date for midnight, else date and time."""
    return F.when(moment.isNull(), "").when(F.date_format(moment, "HH:mm:ss.SSSSSS") == "00:00:00.000000", F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))


def well_named(name: Column) -> Column:
    """Whether a data file keeps the naming rule: two digits, then lower-case words."""
    return name.rlike(DATA_FILE)


def tolerant_map(json: Column) -> Column:
    """The object of a JSON text as a map of texts; an empty map for anything else."""
    return F.coalesce(F.from_json(F.when(F.trim(json).startswith("{"), json), "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def without_empty(record: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(record, lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def utc_stamp(moment: Column) -> Column:
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
