import math
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from verdigris.llm import lm, registry

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = [f"<0x{b:02X}>" for b in range(256)]


def small():
    pieces = [*BYTES, lm._MARK, "a", "b", "ab", lm._MARK + "a", "ba", "bab", "c"]
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces))))
    return lm.Lattice(pieces, logs)


def all_segmentations(lattice, word):
    """Every segmentation with its pieces and probability, by enumeration."""
    said = lm._MARK + word
    for bits in range(1 << (len(said) - 1)):
        cuts = [0, *(k + 1 for k in range(len(said) - 1) if bits >> k & 1), len(said)]
        ids = []
        for a, b in pairwise(cuts):
            if said[a:b] in lattice.number:
                ids.append(lattice.number[said[a:b]])
            elif b == a + 1:
                ids += lattice._spelled(said[a])
            else:
                break
        else:
            yield ids, math.exp(sum(lattice.logs[k] for k in ids))


@pytest.mark.parametrize("word", ["a", "abab", "babé", "cxc", "bababab", ""])
def test_marginals_and_expectations_by_enumeration(word):
    lattice = small()
    every = list(all_segmentations(lattice, word))
    z = sum(p for _, p in every)
    assert lattice.marginals([word.encode()])[0] == pytest.approx(math.log(z))
    assert lattice._long(lm._MARK + word) == pytest.approx(math.log(z))
    expected = np.zeros(len(lattice.pieces))
    for ids, p in every:
        np.add.at(expected, ids, p / z)
    assert np.allclose(lattice.expected([word.encode(), b"a"], np.array([1.0, 0.0])), expected)


def test_every_document_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in registry.documents(spark, "/root/testdata/sf0.001").collect()]
    docs += [(900_001, None), (900_002, ""), (900_003, "x" * 3000), (900_003, "x" * 3000), (None, "The  the\tTHE\x0bnew")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    held = registry.crc_of_id() % 7 == 2
    c, n_docs = Counter(), 0
    for k, text in docs:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            c.update(lm.words_of(text))
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + 1
    model = lm.fit(lm.count_words(df.where(~held)), n_docs, lm.vocabulary_of(PIECES))
    got = lm.score(df, ~held, PIECES, heavy=300).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        words = lm.words_of(texts[r.doc_id])
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_docs + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(c[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(model.score(texts[r.doc_id]))
    assert math.exp(model.log_end) + np.exp(model.logs).sum() == pytest.approx(1)


def test_training_raises_the_likelihood(spark):
    df = registry.documents(spark, "/root/testdata/sf0.001").select("text")
    counts, pieces = lm.count_words(df), lm.vocabulary_of(PIECES)
    held = " ".join(r.text for r in df.limit(20).collect())
    scores = [lm.fit(counts, df.count(), pieces, rounds).score(held) for rounds in (1, 2, 4)]
    assert scores[0] < scores[1] < scores[2]


def test_nothing_to_learn_or_score(spark):
    some = spark.createDataFrame([(1, "new words")], "doc_id bigint, text string")
    assert lm.score(some.limit(0), F.lit(True), PIECES).count() == 0
    for flag in (F.lit(False), F.lit(None).cast("boolean")):
        r = lm.score(some, flag, PIECES).first()
        assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0 and r.score < 0


def test_clashing_columns_long_texts_and_repeats(spark):
    long = " ".join(f"w{k % 50_000}" for k in range(300_000)) + " " + "y" * 200_000
    rows = [(1, long, "c", 1, True), (1, long, "c", 1, True), (2, "w1 unseen w1", "d", 2, False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, w string, row bigint, learn boolean")
    got = {(r.doc_id, r.n_tokens, r.n_known, r.score) for r in lm.score(df, F.col("learn"), PIECES).collect()}
    assert {x[:3] for x in got} == {(1, 300_002, 300_002), (2, 4, 3)} and len(got) == 2
