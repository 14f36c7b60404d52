import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import langid, registry

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    got = registry.QUERIES["op5_ftrl_language_id"](spark, SF).join(registry.documents(spark, SF), "doc_id")
    told = got.where("held_out and length(text) >= 40").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right"), "score").collect()
    right = np.array([r.right for r in told])
    assert right.mean() > 0.97
    assert abs(right.mean() - np.mean([r.score for r in told])) < 0.08
    assert got.count() == registry.documents(spark, SF).count()


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 5, "en"), (2, "der hund und die katze " * 5, "de"), (3, None, "en"), (4, "", None), (5, "12 345 !?", "en"), (6, "the dog", None), (None, "die katze", "de"), (7, "x" * 300_000, "en"), (7, "x" * 300_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("id", F.lit("clash")).withColumn("label", F.lit(1))
    got = langid.predict(docs, langid.fit(docs)).collect()
    by = {r.text: (r.lang_pred, r.score) for r in got}
    assert by[None] == by[""] == by["12 345 !?"] == ("und", 0.0)
    assert by["the dog"][0] == "en" and by["die katze"][0] == "de"
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert langid.predict(docs, langid.fit(docs)).first().lang_pred == "und"


def test_ftrl_is_sparse_and_learns():
    rng, model = np.random.default_rng(1), langid.Ftrl(50, 2, l1=0.3)
    for _ in range(400):
        label = int(rng.integers(2))
        rows = np.array([label * 3, 10 + int(rng.integers(40))])
        model.learn(rows, np.array([1.0, 0.3]), label)
    w = model.weights()
    assert w[0, 0] > w[0, 1] and w[3, 1] > w[3, 0]
    assert (w == 0).mean() > 0.3


def test_temperature_recovers_a_scale():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(x)])
    assert abs(langid.temperature_of(x * 5, labels) - 5) < 0.6


def test_temperature_is_that_of_the_shipped_weights(spark):
    docs = registry.documents(spark, SF).where("lang is not null")
    model = langid.fit(docs, sample_rows=1 << 20)  # so every row is drawn
    held = docs.where(F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(5)) == 0).select("text", "lang").collect()
    logits = np.array([model.logits(langid.counts_of(r.text).astype(np.float32)) for r in held])
    labels = np.array([model.classes.index(r.lang) for r in held])
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert len(held) > 20 and min(counts.values()) >= langid.HELD_LEAST and abs(np.log(langid.temperature_of(logits, labels) / model.temperature)) < 0.02


def test_ties_repeats_and_too_many_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aaa bbb", "x"), (2, "aaa bbb", "y")] * 20, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert model.classes == ["x", "y"] and langid.Model(["x", "y"], model.idf, model.weights * 0, model.bias * 0, 1.0).predict("aaa")[0] == "x"
    assert langid.predict(docs.limit(0), model).count() == 0
    monkeypatch.setattr(langid, "MAX_CLASSES", 1)
    with pytest.raises(ValueError):
        langid.fit(docs)
