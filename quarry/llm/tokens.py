"""Token ids by the tokenizers library, remembered by word; digests and packed id files.

The library encodes words, not whole texts: no piece of these vocabularies crosses white space, so the ids of
a text are those of its words in turn.  Nor does one cross from letters to a mark, so "Word," is remembered as
"word".  Texts are split, and their distinct words found, on the Arrow buffers of a batch; only distinct words
become Python strings, and the ids of all words are gathered in one step.  A text that holds a special
token's string goes to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held, small_batches, stage_table
from quarry.llm.wordbpe import WordCache

#: A word of letters and one of these is two pieces.
MARKS = ".,;:!?"
#: Letters that every Unicode version folds alike, one by one, and that no letter before them composes with.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN_WORD, PLAIN_PIECE = f"^[{LETTERS}]+[{MARKS}]?$", re.compile(f"[{LETTERS}]+")
#: White space (by the Unicode property) outside ASCII.
WIDE_SPACES = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: New words, and new pieces of letters, that the library gets as one text.
JOINED_WORDS, JOINED_PIECES = 2000, 200
#: Words kept in each generation of the cache: four times as many saved 7 % of the time, and took 150 MB more of a worker.
KEPT_WORDS = 100_000


class LibraryEncoder:
    """Ids of texts by the tokenizers library behind a word cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Pieces of folded letters need the same model, but neither the normaliser nor the splitting by kinds of characters.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.special_start = os.path.commonprefix(self.special)
        self.apart_id, self.apart = next((i, t.content) for i, t in added.items())
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.cache = WordCache(self.whole, KEPT_WORDS)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_piece = np.zeros(self.vocab_size, bool)
        self.ends_piece[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        #: The marks, and the ids of each (and of none).
        self.marks, self.mark_ids = pa.array(list(MARKS)), pa.array([*map(self.whole, MARKS), b""], pa.binary())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, tokenizer, words: list[str], joint: str, cut: np.ndarray, gap: int) -> list[bytes]:
        """Ids of the words as one text, joined by ``joint``; cut[id] tells the ids that end a word (or stand between, with a gap)."""
        ids = np.array(tokenizer.encode_batch_fast([joint.join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(cut[ids])
        if gap:
            ends = np.append(ends, len(ids))
        starts = np.concatenate([[0], ends[:-1] + 1])
        stops, raw, size = ends + 1 - gap, ids.tobytes(), self.kind.itemsize
        return [raw[size * a : size * b] for _, a, b in zip(words, starts.tolist(), stops.tolist(), strict=True)]

    def learn_all(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words without special tokens; long ones one by one, so that a text of them stays small."""
        pieces = [w for w in words if PLAIN_PIECE.fullmatch(w)]
        rest = [w for w in words if not PLAIN_PIECE.fullmatch(w)]
        out: dict[str, bytes] = {}
        for i in range(0, len(pieces), JOINED_PIECES):
            some = pieces[i : i + JOINED_PIECES]
            out.update(zip(some, self.learn(self.letters, some, " ", self.ends_piece, 0)))
        between = np.arange(self.vocab_size) == self.apart_id
        for i in range(0, len(rest), JOINED_WORDS):
            some = rest[i : i + JOINED_WORDS]
            out.update(zip(some, self.learn(self.tokenizer, some, self.apart, between, 1)))
        return out

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, folded if they are letters alone, out of the cache or learnt."""
        cache, old = self.cache, self.cache.old
        found = list(map(cache.get, words))
        absent = [i for i, x in enumerate(found) if x is None]
        if absent:
            wanted = [words[i] for i in absent]
            again = {w: old[w] for w in wanted if w in old}
            fresh = self.learn_all([w for w in wanted if w not in again] if again else wanted) | again
            cache.put_all(fresh)
            for i, w in zip(absent, wanted):
                found[i] = fresh[w]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) in one array, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        aside = pc.match_substring(texts, self.special_start)
        if pc.any(aside).as_py():
            aside = functools.reduce(pc.or_, (pc.match_substring(texts, s) for s in self.special))
        special = np.flatnonzero(aside.to_numpy(zero_copy_only=False)).tolist()
        raw = [texts[i].as_py() for i in special]
        if special:
            texts = pc.if_else(aside, "", texts)
        if pc.any(pc.match_substring_regex(texts, WIDE_SPACES)).as_py():
            texts = pc.replace_substring_regex(texts, WIDE_SPACES, " ")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        # Words of letters, with or without a mark, are looked up as folded letters.
        plain = pc.match_substring_regex(distinct, PLAIN_WORD)
        stems = pc.if_else(plain, pc.ascii_rtrim(pc.utf8_lower(distinct), characters=MARKS), distinct).dictionary_encode()
        of_stem = pa.array(self.ids_of(stems.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        mark = pc.index_in(pc.if_else(plain, pc.utf8_slice_codeunits(distinct, -1), ""), self.marks).fill_null(len(MARKS))
        of_word = pc.binary_join_element_wise(of_stem.take(stems.indices), self.mark_ids.take(mark), b"")
        every = of_word.take(coded.indices)
        ends = np.frombuffer(every.buffers()[1], np.int32, len(every) + 1) // self.kind.itemsize
        ids = np.frombuffer(every.buffers()[2] or b"", self.kind, ends[-1])
        stops = ends[words.offsets.to_numpy(zero_copy_only=False)[1:]].astype(np.int64)
        if special:
            parts = np.split(ids, stops[:-1])
            for i, text in zip(special, raw):
                parts[i] = np.frombuffer(self.whole(text), self.kind)
            ids, stops = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, stops


def encoder(path: str) -> LibraryEncoder:
    return held(("encoder", path), lambda: LibraryEncoder(path))


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = ((ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from place ``first`` on: one 64-bit window is gathered for each id, then shifted and masked."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, first * width // 8).astype(np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * width
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    window = np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        window |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((window >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


#: magic, version, bits of an id, ids in a block, documents, ids
HEADER = struct.Struct("<4sBBIIQ")
MAGIC, VERSION, BLOCK_IDS = b"QIDS", 1, 4096


@dataclass
class IdFile:
    """One packed file: header, ids per document (u64), byte offset of each block (u64), then the blocks.

    A block holds BLOCK_IDS ids (the last one fewer) and starts at a byte of its own, so any range of ids
    is read from the blocks that hold it alone.
    """

    width: int
    lengths: np.ndarray
    blocks: np.ndarray
    n_ids: int
    block_ids: int
    data: bytes

    @staticmethod
    def write(ids: np.ndarray, lengths: np.ndarray, vocab_size: int, block_ids: int = BLOCK_IDS) -> bytes:
        width = max(1, int(vocab_size - 1).bit_length())
        blocks = [pack_bits(ids[i : i + block_ids], width) for i in range(0, len(ids), block_ids)]
        starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
        head = HEADER.pack(MAGIC, VERSION, width, block_ids, len(lengths), len(ids))
        return b"".join([head, lengths.astype("<u8").tobytes(), starts.tobytes(), *blocks])

    @classmethod
    def open(cls, data: bytes) -> IdFile:
        magic, version, width, block_ids, docs, n_ids = HEADER.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a packed id file of this version")
        n_blocks = -(-n_ids // block_ids)
        lengths = np.frombuffer(data, "<u8", docs, HEADER.size).astype(np.int64)
        base = HEADER.size + 8 * docs
        blocks = np.frombuffer(data, "<u8", n_blocks, base).astype(np.int64) + base + 8 * n_blocks
        return cls(width, lengths, blocks, n_ids, block_ids, data)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids start..stop-1 of the file."""
        out = []
        for b in range(start // self.block_ids, -(-stop // self.block_ids) if stop > start else 0):
            first = b * self.block_ids
            lo, hi = max(start, first) - first, min(stop, first + self.block_ids, self.n_ids) - first
            end = self.blocks[b + 1] if b + 1 < len(self.blocks) else len(self.data)
            out.append(unpack_bits(self.data[self.blocks[b] : end], self.width, hi - lo, lo))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


#: A file is closed once it holds so many ids (a longer document stays in one file).
FILE_IDS = 1 << 18


def key_ranges(docs: DataFrame, keys: list[str]) -> tuple[int, list[tuple]]:
    """Range partitions of the keys: how many, and the least key of each but the first."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(*keys).repartitionByRange(n, *keys)
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("k")).collect()
    return n, [tuple(r.k) for r in sorted(firsts, key=lambda r: r.p)][1:]


def ordered_key(key: tuple) -> tuple:
    """A key whose null id comes first."""
    return (key[0] is not None, *([] if key[0] is None else [key[0]]), *key[1:])


def write_id_files(docs: DataFrame, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents into packed files, in ascending id order (null ids first, ties by the text's length and hash).

    The files are the ``file`` column of a Parquet table in the shared folder: (part, seq, first, n_ids, ids of
    the documents, file), where ``first`` counts the ids before the file within its range partition.  Texts are
    encoded where they are read; what moves is their ids.  Ranges are cut by (id, length, hash), so neither
    order nor rows of one id need a single task.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("chars"), F.xxhash64(text).alias("hash"), text.alias("text"))
    keys = ["id", "chars", "hash"]
    n, firsts = key_ranges(rows, keys)
    bounds = [ordered_key(k) for k in firsts]

    def encode(batches):
        lib = encoder(vocab_path)
        tail = np.array([end_id], lib.kind if end_id < 1 << 8 * lib.kind.itemsize else "<u4")
        for batch in batches:
            ids, stops = lib.encode(batch.column(3))
            ids = np.insert(ids.astype(tail.dtype, copy=False), stops, tail[0])
            ends = (stops + np.arange(1, len(stops) + 1)) * tail.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            places = [bisect_right(bounds, ordered_key(k)) for k in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), packed, pa.array(places, pa.int32())], names=[*keys, "ids", "part"])

    def write(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        lib = encoder(vocab_path)
        unit = np.dtype(lib.kind if end_id < 1 << 8 * lib.kind.itemsize else "<u4")
        names, chunks, size = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(chunks), unit).astype(np.uint32)
            lengths = np.array([len(c) // unit.itemsize for c in chunks], np.int64)
            blob = IdFile.write(ids, lengths, max(lib.vocab_size, end_id + 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(key_type)), pa.array([blob], pa.binary())],
                names=["part", "seq", "first", "n_ids", "keys", "file"],
            )

        for batch in batches:
            key_type = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(key)
                chunks.append(ids)
                size += len(ids) // unit.itemsize
                if size >= FILE_IDS:
                    yield flush()
                    seq, before = seq + 1, before + size
                    names, chunks, size = [], [], 0
        if names:
            yield flush()

    encoded = rows.mapInArrow(encode, f"id {kind}, chars long, hash long, ids binary, part int")
    ordered = encoded.repartitionById(n, "part").sortWithinPartitions(*keys, "ids").select("id", "ids")
    return stage_table(ordered.mapInArrow(write, f"part int, seq int, first long, n_ids long, keys array<{kind}>, file binary"), "ids")


def read_id_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read packed files back: per document its id, start (ids of all documents before), n_tokens and crc32 of its ids.

    Only one sum for each range partition comes to the driver.
    """
    key = files.schema["keys"].dataType.elementType.simpleString()
    totals = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_ids")).collect())
    base, so_far = {}, 0
    for part, n in totals:
        base[part], so_far = so_far, so_far + n
    small_batches(files.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, data = (batch.column(n)[i].as_py() for n in ("part", "first", "file"))
                f = IdFile.open(data)
                ids = memoryview(f.read(0, f.n_ids).astype("<u4").tobytes())
                ends = np.cumsum(f.lengths)
                starts = ends - f.lengths
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(starts + first + base[part]), pa.array(f.lengths), pa.array(crcs, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, f"{id_col} {key}, start long, n_tokens long, ids_crc32 long")


def id_file_digests(docs: DataFrame, vocab_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write_id_files, then read_id_files.

    Null and empty texts hold the end id alone; repeated rows and repeated ids are documents of their own; an
    empty table gives no file and no row.
    """
    return read_id_files(write_id_files(docs, vocab_path, end_id, id_col, text_col), id_col)
