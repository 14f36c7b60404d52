from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from verdigris.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LETTERS = "aZ sé×÷ÀɏĿªñ"
SIGNS = [*map(chr, range(33, 127)), "\t", "\r", "\n", " ", "  ", "¡", "²", "½", "€", "…", "‐", "İ", "'s", "'LL", "¿", "\xad"]


@pytest.mark.parametrize("file", FILES)
def test_new_words_cost_the_library_s_model_and_nothing_else(file):
    path = public_tokenizers.path(file)
    texts = ["New words, never met: zquolth ärgolun, don't!\nA second line (of 12 words)...", "zquolth again's"]
    want = [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in texts]
    made = Encoder(path, "<u2")
    made.library = SimpleNamespace(model=made.library.model)  # has no normalizer, no cutting, no encodings
    assert [np.frombuffer(x, "<u2").tolist() for x in made.encode_all(texts)] == want


@pytest.mark.parametrize("file", FILES)
def test_every_plain_sign_between_words(file):
    path = public_tokenizers.path(file)
    texts = ["", *(f"{a}{sign}{b} and{sign}{sign}a {sign} é{sign}" for sign in SIGNS for a in LETTERS for b in "t7é "), "", "'", "a" * 300 + "." * 300]
    texts += ["".join(np.random.default_rng(k).choice([*LETTERS, *SIGNS, "the", "9"], 60)) for k in range(300)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for remembered in (20, 1_000_000):
        got = [np.frombuffer(x, "<u2").tolist() for x in Encoder(path, "<u2", remembered=remembered).encode_all(texts)]
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_every_plain_character_has_the_model_s_sign():
    path = public_tokenizers.path(FILES[0])
    plain = "".join(map(chr, [*range(33, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC]))
    texts = [c + d for c in plain for d in ("", "x", ".")] + [f" {c}b" for c in plain]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in Encoder(path, "<u2").encode_all(texts)] == want
