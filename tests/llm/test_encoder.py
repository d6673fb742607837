"""The word-wise encoder against the library on whole texts, where folding and splitting are odd."""

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from quarry.llm.queries import vocabulary
from quarry.llm.tokens import PLAIN_WORD, LibraryEncoder

TEXTS = [
    "Σίσυφος ΟΔΟΣ, ΟΔΟΣ. ΣΑΣ ΑΣ. σας, ẞ. Ǆ. ŉ. ſ. K. Å, Ω.", "don't. we're, it's: 'S. x's!", "é. é, é. é", "١٢. a1. ²,", "ª. ʰ, ʼ. Ⅰ.",
    "<|endoftext|>. <| <|startoftext|> b. <", "x\x1cy. z\x1f, ​.  q　r!", "中文。中文, ไทย. हिन्दी. İ. İ, क़. יִ. שׁ,", "", ". , ..", "a.. b?! c,",
    "ǆ. ĸ, Ÿ. ŉ, Ŀ. ſ, İ. I. ı, ß. ×, ÷. a×.", None, "a\u2003b.\u00a0c,\u3000d", "e\u0301. E\u0301, \u0301.", " lead", "trail ", "\n\t ", "<|endoftext|>",
    "ͅ. ᾳ, ﬁ. ⅷ,", "a̧. q̧́,", "豈, ＡＢ. Ⓐ. 𝐀. 𐐀, ᾼ. ǰ.", "Word word, WORD. word", "x" * 5000 + " " + "y." * 3000,
]


def of_library(encoder, texts):
    return [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def ids_of(encoder, texts):
    ids, stops = encoder.encode(pa.array(texts, pa.string()))
    return [p.tolist() for p in np.split(ids, stops[:-1])] if texts else []


@pytest.fixture(scope="module")
def encoder():
    return LibraryEncoder(vocabulary())


def test_ids_equal_the_library_cold_and_cached(encoder):
    want = of_library(encoder, TEXTS)
    assert ids_of(encoder, TEXTS) == want
    assert ids_of(encoder, TEXTS) == want
    ids, stops = encoder.encode(pa.array([*TEXTS, "left out"]).slice(3, len(TEXTS) - 3))
    assert [p.tolist() for p in np.split(ids, stops[:-1])] == want[3:]
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0] and ids_of(encoder, ["", None]) == [[], []]


def test_a_full_cache_changes_nothing(encoder):
    want = ids_of(encoder, TEXTS)
    small = LibraryEncoder(vocabulary())
    small.cache.most = 3
    assert ids_of(small, TEXTS) == want
    assert ids_of(small, TEXTS) == want


def test_every_folded_letter_alone_and_in_words(encoder):
    """Each letter that may be folded by itself, before and after others and with each mark."""
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [f"{c} {c}. x{c}y, {c}{c}! a{c}" for c in letters] + ["".join(letters)]
    assert ids_of(encoder, texts) == of_library(encoder, texts)


def test_plain_words_are_letters_with_one_mark_at_most():
    words = ["Word,", "word", "a.b.", "İ.", "ΑΣ.", ".", "a1,", "Ça!", "a..", ""]
    assert pa.compute.match_substring_regex(pa.array(words), PLAIN_WORD).to_pylist() == [True, True, False, False, False, False, False, True, False, False]
