import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdigris.llm import decontam, langid

from test_neardup import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(900_001, None, "en", "x", 0), (900_002, "12 345", "en", "x", 6), (900_003, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("label", F.lit("clash")).withColumn("n_words", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, docs, SF)
    assert kept.columns == docs.columns
    rows, before = kept.collect(), {r.doc_id: r for r in docs.collect()}
    assert {r.doc_id for r in rows} <= before.keys() - {900_001, 900_002, 900_003} and all(r == before[r.doc_id] for r in rows)
    assert len(rows) >= 0.97 * sum(langid.has_letter(r.text) for r in before.values())

    single = stages["MinHash near-dedup"](spark, kept, SF)
    assert single.columns == docs.columns
    heads = {c for _, _, c in brute_force([(r.doc_id, r.text) for r in rows])}
    assert sorted(r.doc_id for r in single.collect()) == sorted(heads)

    items = [" ".join(w.decode() for w in decontam.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {" ".join(w[k : k + 10]) for w in map(str.split, items) if w for k in range(max(1, len(w) - 9))}
    clean = stages["benchmark decontamination"](spark, single, SF)
    expected = [r.doc_id for r in single.collect() if not any(f" {g} " in f" {' '.join(w.decode() for w in decontam.words_of(r.text))} " for g in windows)]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(expected) and clean.columns == docs.columns

    private = stages["PII"](spark, clean, SF)
    assert private.columns == docs.columns
    texts = {r.doc_id: r.text for r in private.collect()}
    assert texts.keys() == set(expected)
    for doc, text in texts.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", text)
        if not re.search("[0-9@]", before[doc].text):
            assert text == before[doc].text

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, private, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "packing"]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and got.count() > 0


def test_stages_on_no_rows_and_on_repeated_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
    stages = dict(corpus_pipeline.STAGES)
    long = "the long text of many words that goes on and on " * 40_000
    twice = docs.limit(20).unionByName(docs.limit(20)).unionByName(spark.createDataFrame([(-1, long, None, None, 0), (-1, None, "en", None, 0), (-2, "", None, "x", 0)], docs.schema))
    rows = twice.count()
    assert stages["PII"](spark, twice, SF).count() == rows
    kept = [r.doc_id for r in stages["MinHash near-dedup"](spark, twice.where("text is not null and text <> ''"), SF).collect()]
    assert len(kept) == len(set(kept)) and -1 in kept
    assert {r.doc_id for r in stages["language ID"](spark, twice, SF).where("doc_id < 0").collect()} <= {-1}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, twice, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in twice.collect())
