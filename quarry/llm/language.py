"""Language ID by compression: one raw-content zstandard dictionary a language, the smallest total wins.

A whole text is cut into blocks; each block is compressed with every language's dictionary and the sizes
are added up.  The margin between the two smallest totals decides whether the answer is accepted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, hashed_part, held, map_rows, map_texts
from quarry.llm.compression import DictionaryCompressor, blocks, even_pieces, joined

#: Languages that are learnt, those with most labelled rows: each costs a dictionary and a compression of every text.
MOST_LANGUAGES = 200
#: Documents sampled a language, characters taken of a long one and dictionary bytes a language (some 130 a document);
#: bytes of a block.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 16_384
DICT_BYTES = 200_000
BLOCK_BYTES = 512
#: An answer is accepted if it saves so many bytes, and such a share of the text, against the runner-up.
MIN_MARGIN_BYTES = 1
MIN_MARGIN_SHARE = 0.001
#: Bits of confidence that one saved byte brings; well under 8, as neighbouring words depend on each other.
BITS_A_BYTE = 0.5
#: A letter by its Unicode category; superscripts, fractions and circled digits are none.
LETTER = regex.compile(r"\p{L}")
OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Lower case, with one space for whatever stands between letters: decoration must not decide."""
    return OTHER.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """(language, dictionary), the language with most labelled rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def compressors(model: LanguageModel) -> list[DictionaryCompressor]:
    return held(("language", model), lambda: [DictionaryCompressor(d, min_match=3, strategy=zstd.STRATEGY_LAZY) for _, d in model.dictionaries])


def interleave(texts: list[str], most: int) -> bytes:
    """At most ``most`` bytes of all distinct texts: an equal share of each, so that no text fills the dictionary."""
    return even_pieces([folded(t) for t in texts], most)


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn dictionaries from a bounded sample of the rows where ``train`` holds and the label isn't null."""
    rows = docs.where(train).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).alias("key"))
    rows = rows.where(F.length("text") > 0)
    by: dict[str, list[str]] = {}
    sample, counts = bounded_sample(rows, "lang", "key", sample_docs, MOST_LANGUAGES)
    for text, lang in sample.select(hashed_part(F.col("text"), F.col("key"), SAMPLE_CHARS), "lang").collect():
        by.setdefault(lang, []).append(text)
    return LanguageModel(tuple((lang, interleave(by[lang], DICT_BYTES)) for lang in sorted(by, key=lambda x: (-counts[x], x))))


def totals(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Compressed bytes of each text (rows) with each language's dictionary (columns)."""
    data, starts, sizes = joined([folded(t) for t in texts])
    owner, begin, size = blocks(starts, sizes, BLOCK_BYTES)
    out = np.zeros((len(texts), len(model.dictionaries)), np.int64)
    for k, compressor in enumerate(compressors(model)):
        out[:, k] = np.bincount(owner, compressor.lengths(data, begin, size), len(texts)) if len(owner) else 0
    return out


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and acceptance of each text; ``und`` with score 0 where a text has no letter."""
    names = [n for n, _ in model.dictionaries]
    lettered = np.array([bool(LETTER.search(t)) for t in texts], bool)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    sums = totals(model, texts)
    best = sums.argmin(1)
    smallest = sums.min(1)
    weight = np.exp2(-BITS_A_BYTE * (sums - smallest[:, None]))
    score = np.where(lettered, 1 / weight.sum(1), 0.0)
    if len(names) > 1:
        margin = np.partition(sums, 1, axis=1)[:, 1] - smallest
        bytes_of = np.array([len(t.encode()) for t in texts])
        accepted = lettered & (margin >= MIN_MARGIN_BYTES) & (margin >= MIN_MARGIN_SHARE * bytes_of)
    else:
        accepted = lettered
    return [names[b] if x else "und" for b, x in zip(best, lettered)], score, accepted


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: id_col, lang_pred, score, accepted.

    Null and empty texts, and texts without a letter, get ``und``, score 0 and are not accepted.  Equal totals
    go to the language with most labelled rows (then by name) and are not accepted.  Repeated rows give
    repeated answers.  Without a labelled row every answer is ``und``.
    """

    def run(ids, texts):
        lang, score, accepted = predict(model, texts)
        return {id_col: ids, "lang_pred": lang, "score": score, "accepted": accepted}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, run, f"{id_col} {kind}, lang_pred string, score double, accepted boolean")


def keep(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is accepted, with all their columns.

    Null and empty texts go, as do texts without a letter; of repeated rows all stay or go; an empty table gives
    no rows, and columns of any name stay as they are.
    """
    return map_rows(docs, text_col, lambda rows, texts, _: rows.filter(pa.array(predict(model, texts)[2])))
