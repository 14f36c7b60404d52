import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from verdigris.llm import packing
from verdigris.llm.tokens import Encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b\n\n c\t\td  ", "it's 'RE we'LL\n x,", "naïve İstanbul ẞ ﬁ 漢字 ５ \x1c a\x85b", "<|endoftext|> x", "a <|ENDOFTEXT|>b<|startoftext|>", "a <| b", "é é, ok.", "a  \n", "²x½ ª.", "\0 zero", "one\ntwo three. Four"]


def test_remembered_words_give_the_library_s_ids():
    for path in (WORDS, BYTES):
        library = Tokenizer.from_file(path)
        want = [library.encode(text, add_special_tokens=False).ids for text in ODD]
        for width in ("<u2", "<u4"):
            made = Encoder(path, width, remembered=8)
            for _ in range(2):
                assert [np.frombuffer(x, width).tolist() for x in made.encode_all(ODD)] == want
                assert [np.frombuffer(made.encode(x), width).tolist() for x in ODD] == want
                assert len(made.table) <= 8
        assert made.encode_all([None, ""]) == [b"", b""]


def test_every_id_is_in_one_piece_and_windows_hold_the_mixture(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", f"word{k} alpha beta " * (k % 40)) for k in range(400)]
    rows += [(None, None, None), (5, "hot", "again"), (5, "hot", "again"), (6, None, "x"), (7, "rare", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    size = 256
    got = packing.pack(docs, WORDS, end_id=2, size=size).collect()
    library = Tokenizer.from_file(WORDS)
    whole = defaultdict(list)
    for doc, _, text in rows:
        whole[doc].append(library.encode(text or "", add_special_tokens=False).ids + [2])
    total = sum(len(x) for xs in whole.values() for x in xs)
    assert sum(r.length for r in got) == total
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(-(-total // size)))
    for w, runs in by.items():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at == (size if w < max(by) else total - size * max(by))
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc, texts in whole.items():
        expected = len(texts)
        assert sum(1 for p in parts[doc] if p[0] == 0) == expected
        if expected == 1:
            at = 0
            for start, length, crc, n in sorted(parts[doc]):
                assert start == at and n == len(texts[0])
                assert crc == zlib.crc32(np.array(texts[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(texts[0])
    hot = {d for d, s, _ in rows if s == "hot"}
    share = sum(len(x) for d in hot for x in whole[d]) / total
    for w in range(max(by)):
        inside = sum(r.length for r in got if r.sequence_id == w and r.doc_id in hot)
        assert abs(inside - share * size) < 3 + sum(len(x) for x in whole[5])


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, source string, text string"), WORDS, 2).count() == 0


def test_closed_forms_are_the_ring_run_window_by_window():
    """Deficit round-robin step by step: credit each queue, serve whole tokens, pass what is left of one to the next queue."""
    size, sizes = 16, [90, 500, 61, 400]
    total = sum(sizes)
    deficit, place, want = [Fraction(0)] * len(sizes), [0] * len(sizes), []
    for w in range(total // size):
        carry, at = Fraction(0), 0
        for q, n in enumerate(sizes):
            have = carry + deficit[q] + Fraction(size * n, total)
            k = have.numerator // have.denominator
            want += [(w, at + j, q, place[q] + j) for j in range(k)]
            place[q], at = place[q] + k, at + k
            deficit[q], carry = have - k - carry, have - k
        assert at == size and carry == 0 and all(abs(d) < 1 for d in deficit)
    got, low = [], 0
    for q, n in enumerate(sizes):
        a = 0
        while a < n:
            some = min(1 + a % 37, n - a)
            got += [(w, offset + j, q, a + start + j) for start, length, w, offset in packing.pieces_of(a, some, low, low + n, size, total) for j in range(length)]
            a += some
        low += n
    got.sort()
    assert [w * size + o for w, o, _, _ in got] == list(range(total))
    assert got[: len(want)] == want


def test_small_sources_advance_side_by_side(spark):
    rows = [(k, "big", "one two three four " * 40) for k in range(60)]
    rows += [(1000 + 100 * s + k, f"s{s}", "five " * (1 + (k * s) % 7)) for s in range(20) for k in range(1 + s)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3), WORDS, end_id=2, size=64).collect()
    assert sum(r.length for r in got) == sum(len(t.split()) + 1 for _, _, t in rows)
    source = {d: s for d, s, _ in rows}
    sizes = defaultdict(int)
    for d, s, t in rows:
        sizes[s] += len(t.split()) + 1
    assert all(n * 64 < sum(sizes.values()) for s, n in sizes.items() if s != "big")
    done, ranks = defaultdict(int), []
    for r in sorted((r for r in got if r.start == 0 and source[r.doc_id] != "big"), key=lambda r: (r.sequence_id, r.offset)):
        s = source[r.doc_id]
        ranks.append((done[s] + r.doc_tokens / 2) / sizes[s])
        done[s] += r.doc_tokens
    assert ranks == sorted(ranks) and len(ranks) == len(rows) - 60


def test_clashing_columns_and_very_long_texts(spark):
    long = "one two three " * 150_000
    rows = [(1, None, long, 5, "x"), (2, "b", "", 6, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, part bigint, ids string")
    got = packing.pack(docs, WORDS, end_id=2).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 450_001 and [r.length for r in got if r.doc_id == 2] == [1]
