"""Word-level BPE with word ends: a merge-rank priority queue over a doubly linked symbol list.

The vocabulary file gives the normalisation (NFC, white space, lower case), the split into letters, single
digits and other marks, and the merges.  No piece crosses white space, so a text is a sequence of
white-space words whose ids are remembered in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame

from quarry.llm.common import held, map_texts

#: Words kept in each of a cache's two generations; longer words than LONG_WORD are never kept.
CACHE_WORDS = 400_000
LONG_WORD = 64
#: A queue entry is a rank above, a place in the piece below.
PLACE_BITS = 32
PLACES = (1 << PLACE_BITS) - 1
#: Python's str.split() also splits at these, which are not white space to the vocabulary's patterns.
ODD_SPACES = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def words_of(text: str) -> list[str]:
    """The white-space separated words, by the Unicode property White_Space."""
    return [w for w in SPACES.split(text) if w] if ODD_SPACES.search(text) else text.split()


class WordCache(dict):
    """Word -> value in two generations: when the young one is full it becomes the old one."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value

    def put(self, word: str, value) -> None:
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value

    def put_all(self, values: dict) -> None:
        """put() of many at once; the young generation may go over its limit by those."""
        if len(self) + len(values) > self.most:
            self.old = dict(self)
            self.clear()
        self.update((w, v) for w, v in values.items() if len(w) <= LONG_WORD)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of one vocabulary file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.piece_cache = WordCache(self.merge)
        self.word_cache = WordCache(self.encode_word)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece.  The queue holds rank and place; an entry is stale when the symbols there now merge at another rank."""
        raw = piece.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n, merge_of = len(symbols), self.merges.get
        if n == 1:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0] << PLACE_BITS) + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := merge_of(pair))]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & PLACES
            j = after[i]
            if j >= n or not (found := merge_of((symbols[i], symbols[j]))) or found[0] != entry >> PLACE_BITS:
                continue
            symbols[i] = new = found[1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merge_of((new, symbols[k])):
                    push(queue, (found[0] << PLACE_BITS) + i)
            if (h := before[i]) >= 0 and (found := merge_of((symbols[h], new))):
                push(queue, (found[0] << PLACE_BITS) + h)
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids as decimals, vocabulary strings), both joined by spaces, of a white-space word."""
        folded = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        ids = [i for piece in self.pieces.findall(folded) for i in self.piece_cache[piece]]
        return self.written(ids)

    def written(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, concatenated with a space between, as a file without a decoder asks."""
        return " ".join([self.strings[i] for i in ids])

    def encode_text(self, text: str) -> list[tuple[int, str, str]]:
        """encode_word of each word; the special tokens' strings stand for themselves wherever they occur."""
        get = self.word_cache.__getitem__
        if "<|" not in text:
            return list(map(get, words_of(text)))
        out = []
        for part in self.at_special.split(text):
            out += [self.written([self.special[part]])] if part in self.special else map(get, words_of(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_text(text) for i in ids.split()]


def load(path: str) -> WordBPE:
    """One encoder a process: a Python worker keeps it, and its cache, over its tasks."""
    return held(("bpe", path), lambda: WordBPE(path))


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, then decode it; one row a document with digests of both.

    Columns: id_col, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256.  Null and
    empty texts have no ids and the digest of nothing; repeated rows give repeated results; an empty table an
    empty result.  No shuffle: each text is encoded where it is read.
    """

    def run(ids, texts):
        bpe, counts, shas, decoded = load(vocab_path), [], [], []
        for text in texts:
            words = bpe.encode_text(text)
            n, numbers, strings = zip(*words) if words else ((), (), ())
            counts.append(sum(n))
            shas.append(hashlib.sha256(" ".join(numbers).encode()).hexdigest())
            decoded.append(hashlib.sha256(" ".join(strings).encode()).hexdigest())
        return {id_col: ids, "n_tokens": counts, "ids_sha256": shas, "decoded_sha256": decoded}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
