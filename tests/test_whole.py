"""Queries that once left a part of their input out, held against brute force over all of it."""

import re
import unicodedata
from collections import defaultdict

import __spark_entry__
import pytest

SF = "/root/testdata/sf0.001"


def rows(spark, name, sf_dir=SF):
    return [tuple(r) for r in __spark_entry__.queries()[name](spark, sf_dir).collect()]


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def shares(spark):
    """(item, document): the share of the item's longer words that the document contains, of all pairs."""
    words = {b.item_id: {w for w in re.split(r"[\W_]+", b.text.lower()) if len(w) >= 4} for b in read(spark, "benchmark")}
    docs = [(d.doc_id, d.text.lower()) for d in read(spark, "documents")]
    return {(i, d): sum(w in text for w in own) / len(own) for i, own in words.items() if own for d, text in docs}


def test_title_overlap(spark, shares):
    assert sorted(rows(spark, "title_overlap")) == sorted((i, d, int(s * 1_000_000 + 0.5)) for (i, d), s in shares.items() if s >= 0.3)


def test_verify_first(spark, shares):
    want = []
    for item in {i for i, _ in shares}:
        of = {d: s for (i, d), s in shares.items() if i == item}
        want.append((item, min((d for d, s in of.items() if s >= 0.34), default=None), max(of, key=lambda d: (of[d], -d))))
    assert sorted(rows(spark, "verify_first")) == sorted(want)


def test_chunk_counts(spark):
    want = []
    for d in read(spark, "documents"):
        n = sum(-(-len(p) // 2000) for p in re.split(r"\n\s*\n", d.text, flags=re.ASCII) if p.strip(" "))
        want += [(d.doc_id, n)] if n else []
    assert sorted(rows(spark, "chunk_counts")) == sorted(want)


def test_recursive_closure(spark):
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "1000")  # fewer than the closure's rows
    try:
        got = rows(spark, "lineage_closure_recursive")
    finally:
        spark.conf.unset(key)
    customers = {c.c_custkey: c.c_nationkey for c in read(spark, "customer")}
    nations = {n.n_nationkey: n.n_regionkey for n in read(spark, "nation")}
    want = []
    for o in read(spark, "orders"):
        nation = customers[o.o_custkey]
        chain = [f"o{o.o_orderkey}", f"c{o.o_custkey}", f"n{nation}", f"r{nations[nation]}"]
        want += [(chain[0], node, depth) for depth, node in enumerate(chain)]
    assert sorted(got) == sorted(want)


def test_metadata_search(spark):
    want = [(d.doc_id,) for d in read(spark, "documents") if d.lang == "de" and "ung" in f"{d.source} {d.lang} {d.text}".lower()]
    assert sorted(rows(spark, "metadata_search")) == sorted(want)


def keys(doc):
    folded = unicodedata.normalize("NFKD", doc.text).encode("ascii", "ignore").decode().lower()
    return doc.text, (re.sub("[^a-z0-9 ]+", "", folded).strip(" "), doc.lang)


def test_duplicate_clusters(spark):
    groups = defaultdict(list)
    for d in read(spark, "documents"):
        for by, key in enumerate(keys(d), 1):
            groups[by, key].append(d.doc_id)
    want = {}
    for (by, _), ids in sorted(groups.items(), key=lambda g: g[0][0]):
        if len(ids) > 1:
            want.setdefault(tuple(sorted(ids)), by)
    assert sorted(rows(spark, "duplicate_clusters")) == sorted((m[0], by, d, len(m)) for m, by in want.items() for d in m)


def test_priority_match(spark):
    docs, first = read(spark, "documents"), {}
    for d in docs:
        if d.doc_id % 5:
            for by, key in enumerate(keys(d), 1):
                first[by, key] = min(d.doc_id, first.get((by, key), d.doc_id))
    found = [(d.doc_id, [(first[k], k[0]) for k in enumerate(keys(d), 1) if k in first]) for d in docs if d.doc_id % 5 == 0]
    assert sorted(rows(spark, "priority_match")) == sorted((c, *m[0]) for c, m in found if m)
