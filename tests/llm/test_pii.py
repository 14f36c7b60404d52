import hashlib
import itertools
import re
import time

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.llm import pii

SF = "/root/testdata/sf0.01/documents.parquet"


def plain_spans(text):
    """The rules word for word, by an ordinary regex engine."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@x.y", ".", "..", "-", "+", "+1", " ", "(", ")", "7", "42", "255", "300", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "é", "00001", "\n", "x@y.z@w.v"]), max_size=14).map("".join))
def test_rules_against_plain_regexes(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_rules_on_documents():
    for text in pq.read_table(SF)["text"].to_pylist():
        assert pii.base_spans(text) == plain_spans(text)


def model():
    return pii.fitted([("u", repr(u.pattern), u.label, 0, 1) for text in pq.read_table(SF)["text"].to_pylist() for u in pii.units_of(text, pii.base_spans(text))])


def test_repeats_take_the_label_of_what_they_repeat():
    m = model()
    text = "call +1 (974) 555-3436 today. " + "words here " * 30 + "or 974 555 3436 tomorrow, not 974 555 9999."
    base, spans = pii.find(text, m)
    assert [text[a:b] for _, a, b in base] == ["+1 (974) 555-3436"]
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in spans] == [("phone", "+1 (974) 555-3436"), ("phone", "974 555 3436")]
    assert pii.find("or 974 555 3436 tomorrow", m)[1] == []


def test_clean_text_stays_clean():
    m = model()
    for text in ("Version 2.0 of 1999-2004, pages 120-134.", "sum 12345678 of 3.14159", "order 1234567890123 @ 5", "", "a@b", "1.2.3"):
        assert pii.find(text, m)[1] == pii.base_spans(text)
    assert pii.find(None, m) == ([], [])


def test_messages_are_exact_on_a_tree():


    rng, m = np.random.default_rng(0), pii.Field()
    m.near, m.skip = rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    units = [pii.Unit(k, k + 1, 0, ("p", k)) for k in range(4)]
    m.patterns = {u.pattern: rng.normal(size=5) for u in units}
    edges = [(0, 1, False), (1, 2, False), (0, 3, True)]
    p = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        score = sum(m.unary(u)[x] for u, x in zip(units, labels, strict=True)) + sum((m.skip if s else m.near)[labels[a], labels[b]] for a, b, s in edges)
        for k, x in enumerate(labels):
            p[k, x] += np.exp(score)
    assert np.abs(pii.beliefs(units, edges, m, 200) - p / p.sum(1, keepdims=True)).max() < 1e-3


def test_documents_and_odd_rows(spark):
    rows = [(1, "mail ab.12@mail7.example.com now", "x"), (2, None, "x"), (3, "", None), (1, "mail ab.12@mail7.example.com now", "x"), (None, "card 4111 1111 1111 1111 " * 500, "y"), (4, "1" * 200_000 + "@" + "a" * 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans_of string").withColumn("kind", F.lit(1))
    m = pii.train(docs)
    got = pii.detect(docs, m).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain_spans(r.text or "") if len(r.text or "") < 100_000 else []
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.spans_text(base).encode()).hexdigest()
        assert set(pii.spans_text(base).split(",")) <= set(r.spans.split(",")) | {""}
    clean = {r.doc_id: r.text for r in pii.redact(docs, m).collect()}
    assert clean[1] == "mail <EMAIL> now" and clean[2] is None and clean[3] == "" and "4111" not in clean[None]
    assert pii.detect(docs.limit(0), m).count() == 0


def test_long_runs_are_read_once():
    m = model()
    for text in ("1 " * 1_000_000 + "1a", "1.1." * 500_000, "+1(" * 600_000, "a@" * 1_000_000, "4-" * 1_000_000):
        began = time.process_time()
        pii.units_of(text, pii.base_spans(text))
        assert time.process_time() - began < 20
    assert pii.find("so 974 555 3436x and 12-34-56-78 9", m)[0] == []
    assert [text_of(u, "x 974 555 3436a 974 555 3437 b") for u in pii.units_of("x 974 555 3436a 974 555 3437 b", [])] == ["974 555 3437"]


def text_of(unit, text):
    return text[unit.start : unit.end]


def test_messages_on_a_cycle_end_and_agree_with_the_marginals():
    """Skip edges close cycles: beliefs are near the exact marginals and pick the same labels."""
    rng, m = np.random.default_rng(4), pii.Field()
    m.near, m.skip = rng.normal(size=(5, 5)) * 0.3, np.eye(5) * 0.8
    units = [pii.Unit(k, k + 1, 0, ("p", k)) for k in range(4)]
    m.patterns = {u.pattern: rng.normal(size=5) * 2 for u in units}
    edges = [(0, 1, False), (1, 2, False), (2, 3, False), (0, 2, True), (1, 3, True)]
    p = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        score = sum(m.unary(u)[x] for u, x in zip(units, labels, strict=True)) + sum((m.skip if s else m.near)[labels[a], labels[b]] for a, b, s in edges)
        for k, x in enumerate(labels):
            p[k, x] += np.exp(score)
    p /= p.sum(1, keepdims=True)
    got = pii.beliefs(units, edges, m, 300)
    assert np.abs(got - p).max() < 0.1 and (got.argmax(1) == p.argmax(1)).all()
