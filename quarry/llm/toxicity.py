"""Toxicity by compression distance: the same window under an ordinary and a toxic dictionary.

Both dictionaries are trained on labelled text.  They share a base of ordinary text; the toxic one adds the
substrings that toxic documents hold far more often than ordinary ones.  A window that holds such a
substring compresses shorter with the toxic dictionary; others come out alike.  Thresholds on a window's
saving are calibrated on ordinary texts outside the dictionaries; the score of a document is a logistic
function of how many of its windows reach each, so one toxic window in a long text counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, hashed_part, held, map_rows, map_texts
from quarry.llm.compression import DictionaryCompressor, even_pieces, joined, word_windows

#: Labelled documents sampled a class, and characters taken of a long one for training.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 8192
#: Bytes of a window; of the base; of the added substrings.  Lengths of substrings in bytes.
WINDOW_BYTES = 64
BASE_BYTES = 96_000
TOXIC_BYTES = 8_000
SUBSTRING_BYTES = range(5, 13)
#: A substring is added if toxic documents hold it at so many times the ordinary rate, and if the logarithm of
#: the odds against chance (Poisson) is so large; there are some hundred thousand substrings to choose from.
LEAST_RATIO = 4.0
LEAST_PROOF = 14.0
#: Thresholds on a window's saving: such quantiles of ordinary windows, whole bytes from 1 on.
QUANTILES = (0.8, 0.9, 0.97, 0.99, 0.997, 0.999)
#: Folds of the calibration; word-triple hashes that tell copies among the training texts.
FOLDS = 4
SKETCH = 4
#: Ends every window and both dictionaries: without it zstandard stores short windows that hardly compress as they are.
TAIL = bytes(range(1, 33))


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries, thresholds on a window's saving, and weights of the windows that reach each, of all windows, and a bias."""

    ordinary: bytes
    toxic: bytes
    thresholds: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float


def without_copies(texts: list[str]) -> list[str]:
    """Training texts that share none of their SKETCH smallest word-triple hashes with an earlier one.

    Copies of one toxic text would make its rare words look like marks of toxicity.
    """
    seen: set[int] = set()
    out = []
    for text in texts:
        words = folded(text).split()
        sketch = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))})[:SKETCH]
        if not seen.intersection(sketch):
            out.append(text)
        seen.update(sketch)
    return out


def substrings(text: str) -> set[bytes]:
    """Beginnings of words (with the space before) of the lengths asked for, and whole words."""
    out: set[bytes] = set()
    for word in set(folded(text).split()):
        raw = b" " + word.encode() + b" "
        for n in SUBSTRING_BYTES:
            if n < len(raw):
                out.add(raw[:n])
        if len(raw) <= SUBSTRING_BYTES[-1] + 4:
            out.add(raw)
    return out


def folded(text: str) -> str:
    return text.lower()


def marked(have: Counter, rest: Counter, scale: float) -> list[bytes]:
    """Substrings over-represented in toxic documents, the strongest last.

    ``have`` and ``rest`` count the toxic and the ordinary documents that hold each; ``scale`` is the ratio of
    the classes' sizes.  A substring that holds a stronger one, or is part of it, is left out: what it adds is
    ordinary text.
    """
    proof = {s: n * np.log(n / expected) - (n - expected) for s, n in have.items() if n >= LEAST_RATIO * (expected := (rest[s] + 0.5) * scale)}
    strong = [s for s, x in proof.items() if x >= LEAST_PROOF]
    chosen: list[bytes] = []
    size = 0
    for s in sorted(strong, key=lambda s: (-proof[s], -len(s), s)):
        if size + len(s) <= TOXIC_BYTES and not any(s in c or c in s for c in chosen):
            chosen.append(s)
            size += len(s)
    return chosen[::-1]


def base_of(texts: list[str]) -> bytes:
    """Ordinary text for both dictionaries: an equal share of each distinct text."""
    return even_pieces([folded(t) for t in texts], BASE_BYTES)


def compressors(ordinary: bytes, toxic: bytes) -> tuple[DictionaryCompressor, DictionaryCompressor]:
    kind = {"min_match": 5, "strategy": zstd.STRATEGY_GREEDY}
    return held(("toxicity", ordinary, toxic), lambda: (DictionaryCompressor(ordinary, **kind), DictionaryCompressor(toxic, **kind)))


def savings(ordinary: bytes, toxic: bytes, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its text, and the bytes that the toxic dictionary saves against the ordinary one."""
    data, starts, sizes = joined([folded(t) for t in texts])
    owner, begin, size = word_windows(data, starts, sizes, WINDOW_BYTES)
    if not len(owner):
        return owner, np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    data = np.insert(raw, np.repeat(begin + size, len(TAIL)), np.tile(np.frombuffer(TAIL, np.uint8), len(begin))).tobytes()
    begin, size = begin + len(TAIL) * np.arange(len(begin)), size + len(TAIL)
    plain, other = compressors(ordinary, toxic)
    return owner, plain.lengths(data, begin, size) - other.lengths(data, begin, size)


def features(owner: np.ndarray, saved: np.ndarray, texts: int, thresholds: tuple[int, ...]) -> np.ndarray:
    """Per text the logarithms of its windows that reach each threshold, and of all its windows."""
    reached = [np.bincount(owner, saved >= t, texts) for t in thresholds]
    return np.log1p(np.stack([*reached, np.bincount(owner, minlength=texts)], axis=1))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-regularised logistic regression, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(toxic: list[str], ordinary: list[str], class_sizes: tuple[int, int]) -> ToxicityModel:
    """Calibration across folds (each scored with dictionaries of the others), then dictionaries of all texts.

    ``class_sizes`` are the sizes of the whole classes: the sampled ones are weighted back to them.
    """
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)

    if not toxic or not ordinary:
        base = base_of(ordinary) + TAIL
        return ToxicityModel(base, base, (), (0.0,), 4.0 if toxic else -4.0)
    by_fold = [[Counter(s for t in texts[k::FOLDS] for s in substrings(t)) for k in range(FOLDS)] for texts in (toxic, ordinary)]
    whole = [sum(folds, Counter()) for folds in by_fold]

    def dictionaries(fold: int | None) -> tuple[bytes, bytes]:
        """Of all texts, or of those outside a fold."""
        have, rest = (w if fold is None else w - folds[fold] for w, folds in zip(whole, by_fold))
        added = b"".join(marked(have, rest, len(toxic) / len(ordinary)))
        base = base_of([t for i, t in enumerate(ordinary) if i % FOLDS != fold])
        return base + bytes(128 + i % 61 for i in range(len(added))) + TAIL, base + added + TAIL

    outside = [(label, len(part), *savings(*dictionaries(k), part)) for k in range(FOLDS) for label, texts in ((1.0, toxic), (0.0, ordinary)) if (part := texts[k::FOLDS])]
    plain = np.concatenate([saved for label, _, _, saved in outside if not label])
    thresholds = tuple(sorted({max(1, int(q)) for q in np.quantile(plain, QUANTILES)})) if len(plain) else (1,)
    rows = [features(owner, saved, n, thresholds) for _, n, owner, saved in outside]
    weights, bias = logistic(np.vstack(rows), np.concatenate([np.full(n, label) for label, n, _, _ in outside]))
    shift = np.log(class_sizes[0] / len(toxic)) - np.log(class_sizes[1] / len(ordinary))
    return ToxicityModel(*dictionaries(None), thresholds, tuple(weights.tolist()), bias + float(shift))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, text_col: str = "text", key_col: str = "doc_id", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learn from a bounded sample of the labelled documents for which ``train_rows`` (of the key) holds.

    The sample is drawn from the labels; it has a bounded size and is broadcast to pick the texts.
    """
    known = labels.where(train_rows).select(F.col(key_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    sample, counts = bounded_sample(known, "label", "key", sample_docs, 2)
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    found = rows.join(F.broadcast(sample), "key").select("label", hashed_part(F.col("text"), F.col("key"), SAMPLE_CHARS)).collect()
    by = {label: sorted({r[1] for r in found if r[0] == label}, key=lambda t: hash_key(t)) for label in (0, 1)}
    return train(by[1], by[0], (max(1, counts.get(1, 0)), max(1, counts.get(0, 0))))


def hash_key(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()


def predict(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    z = features(*savings(model.ordinary, model.toxic, texts), len(texts), model.thresholds) @ np.array(model.weights) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: id_col, score, predicted (1 from 0.5 on).

    Null and empty texts have no window and get the score of a text that saves nothing.  Repeated rows give
    repeated scores; an empty table gives no rows.  Without labels of both kinds the score is constant.
    """

    def run(ids, texts):
        p = predict(model, texts)
        return {id_col: ids, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, run, f"{id_col} {kind}, score double, predicted int")


def keep(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows that score under 0.5, with all their columns.

    Null and empty texts have the score of a text that saves nothing; of repeated rows all stay or go; an empty
    table gives no rows, and columns of any name stay as they are.
    """
    return map_rows(docs, text_col, lambda rows, texts, _: rows.filter(pa.array(predict(model, texts) < 0.5)))
