"""Lengths of many byte windows compressed with a dictionary, in one library call for a batch."""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard as zstd


class DictionaryCompressor:
    """zstandard with a prepared dictionary and a bare frame: no magic, checksum, size or dictionary id."""

    def __init__(self, dictionary: bytes, level: int = 3, min_match: int = 4, strategy: int = zstd.STRATEGY_DFAST):
        content = zstd.ZstdCompressionDict(dictionary or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        log = max(12, min(20, len(dictionary).bit_length() + 1))
        tables = min(log, max(17, (len(dictionary) - 1).bit_length()))
        params = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, compression_level=level, strategy=strategy, min_match=min_match,
            window_log=log, hash_log=tables, chain_log=tables, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        content.precompute_compress(compression_params=params)
        self.compressor = zstd.ZstdCompressor(dict_data=content, compression_params=params)

    def lengths(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Compressed length of each window data[start:start+size]; empty windows count 0."""
        out = np.zeros(len(starts), np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            segments = np.empty((len(full), 2), np.uint64)
            segments[:, 0], segments[:, 1] = starts[full], sizes[full]
            packed = self.compressor.multi_compress_to_buffer(zstd.BufferWithSegments(data, segments.tobytes()), threads=1)
            out[full] = [len(x) for x in packed] if not hasattr(packed, "buffers") else segment_lengths(packed)
        return out


def segment_lengths(packed) -> np.ndarray:
    """Lengths of all segments of a result; it lists buffers of segments, each with an offset and a length."""
    return np.fromiter((len(x) for x in packed), np.int64, len(packed))


def hashed(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def even_pieces(texts: list[str], most: int) -> bytes:
    """Distinct texts in ``most`` bytes, in the order of their hashes: short ones whole, of the others equal pieces.

    A piece is taken at a hashed place, so that neither what texts open with nor how they sort decides.
    """
    raw = sorted({t.encode("utf-8", "replace") for t in texts}, key=lambda r: (hashed(r), r))
    left, share = most, 0
    for i, n in enumerate(sorted(map(len, raw))):
        share = left // (len(raw) - i) - 1
        if n > share:
            break
        left, share = left - n - 1, n
    starts = [hashed(r + b"@") % (max(0, len(r) - share) + 1) for r in raw]
    return b"\n".join(r[a : a + max(0, share)] for r, a in zip(raw, starts))


def joined(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of all texts in one buffer, with the start and the size of each."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    return b"".join(raw), np.cumsum(sizes) - sizes, sizes


def blocks(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut [start, start+size) into blocks of ``most`` bytes: owner, start and size of each."""
    n = -(-sizes // most)
    owner = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[owner] + k * most
    return owner, begin, np.minimum(most, starts[owner] + sizes[owner] - begin)


def word_windows(data: bytes, starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of about ``most`` bytes that begin at a space (or at the text's start) and so cut no word.

    Every byte of every text is in one window.  A word longer than ``most`` makes its window longer.
    """
    raw = np.frombuffer(data, np.uint8)
    space = np.append(np.flatnonzero(raw <= 32), len(raw))
    owner, cut, size = blocks(starts, sizes, most)
    if not len(owner):
        return owner, cut, size
    at = space[np.searchsorted(space, cut)]
    first = cut == starts[owner]
    begin = np.where(first, cut, np.minimum(at, starts[owner] + sizes[owner]))
    end = np.append(begin[1:], len(raw))
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = (starts + sizes)[owner[last]]
    size = end - begin
    return owner[size > 0], begin[size > 0], size[size > 0]
