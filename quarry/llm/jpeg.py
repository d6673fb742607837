"""Progressive JPEG: scans accumulate into coefficient arrays; numpy does the rest.

The decoder reads any number of files at once.  Restart intervals are independent bit streams, so all
intervals of all files advance together, one Huffman symbol a step, as numpy vectors: a step costs the same
however many streams there are.  First and refinement scans of spectral selection and successive
approximation are supported, with end-of-band runs, for Huffman-coded 8-bit pictures whose components are
sampled 1x1 or (luma) 2x2.

The writer is lossless for coefficients, the format's unit: a payload byte b becomes the quantised
coefficient b + 256, split into first and refinement scans as any progressive encoder does.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: the zigzag order of a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

#: A payload unit fills one restart interval of each component: 8 luma, 2 + 2 chroma blocks of BLOCK_BYTES.
UNIT, BLOCK_BYTES, OFFSET = 576, 48, 256
LUMA_BLOCKS, CHROMA_BLOCKS = 8, 2
#: Coefficients BAND[0]..BAND[1] (zigzag) hold the payload, in two bands; LOW bits come by refinement.
BANDS, LOW = ((1, 24), (25, 48)), 1


def basis() -> np.ndarray:
    """(zigzag coefficient, sample) matrix of the inverse transform."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = basis()


# ------------------------------------------------------------------ writing


def code_table(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body and symbol -> (code, bits) for symbols with these code lengths (Kraft sum under 1)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(lengths[s] == n for s in order) for n in range(1, 17)]
    code, last, out = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return bytes(counts) + bytes(order), out


#: One symbol says: no zeros before, a value of so many bits.  The other ends bands (0x00, and runs of them).
VALUE_BITS = (OFFSET * 2 - 1).bit_length() - LOW
AC_FIRST = code_table({VALUE_BITS: 1, 0x00: 2})
AC_REFINE = code_table({0x00: 2, 0x10: 2, 0x30: 2})
DC_TABLE = code_table({0: 1})


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def pack_fields(values: np.ndarray, bits: int, per_row: int) -> np.ndarray:
    """Rows of ``per_row`` fields of ``bits`` bits as bytes, padded with ones."""
    spread = ((values[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1, per_row * bits)
    pad = -spread.shape[1] % 8
    return np.packbits(np.hstack([spread, np.ones((len(spread), pad), np.uint8)]) if pad else spread, axis=1)


def interleaved(rows: np.ndarray, nth: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Entropy-coded rows of many files as restart intervals: 0xFF is stuffed, RSTn stands between a file's rows.

    File i has the rows edges[i]..edges[i + 1] - 1; nth is a row's number in its file.
    """
    n, width = rows.shape
    flat = np.empty((n, width + 2), np.uint8)
    flat[:, :width] = rows
    flat[:, width] = 0xFF
    flat[:, width + 1] = 0xD0 + nth % 8
    escape = np.flatnonzero(rows.ravel() == 0xFF)
    escape = escape // width * (width + 2) + escape % width
    begin, end = edges[:-1] * (width + 2), edges[1:] * (width + 2) - 2
    out = (np.insert(flat.ravel(), escape + 1, 0) if len(escape) else flat.ravel()).tobytes()
    begin, end = begin + np.searchsorted(escape, begin), end + np.searchsorted(escape, end)
    return [out[a:b] for a, b in zip(begin.tolist(), end.tolist())]


def scan_rows(values: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(first, last, high, low, rows) of all scans of one component; values: (intervals, blocks, 48)."""
    out = []
    n, blocks, _ = values.shape
    for first, last in BANDS:
        part = values[:, :, first - 1 : last].reshape(n, -1).astype(np.uint32)
        code, size = AC_FIRST[1][VALUE_BITS]
        out.append((first, last, 0, LOW, pack_fields(((code << VALUE_BITS) | (part >> LOW)).ravel(), size + VALUE_BITS, part.shape[1])))
        run = blocks.bit_length() - 1
        code, size = AC_REFINE[1][run << 4]
        head = code << run | (blocks - (1 << run))
        lead = np.tile(np.array([head >> k & 1 for k in range(size + run - 1, -1, -1)], np.uint8), (n, 1))
        for low in range(LOW - 1, -1, -1):
            bits = np.hstack([lead, ((part >> low) & 1).astype(np.uint8)])
            out.append((first, last, low + 1, low, np.packbits(np.hstack([bits, np.ones((n, -bits.shape[1] % 8), np.uint8)]), axis=1)))
    return out


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG (4:2:0) for each payload, whose coefficients hold it; lengths are positive multiples of UNIT."""
    units = [len(p) // UNIT for p in payloads]
    if any(len(p) % UNIT or not p for p in payloads):
        raise ValueError("a payload must be a positive multiple of 576 bytes")
    columns = [-(-u // 4000) for u in units]
    tall = [-(-u // c) for u, c in zip(units, columns)]
    total = np.array([c * r for c, r in zip(columns, tall)], np.int64)
    edges = np.concatenate([[0], np.cumsum(total)])
    raw = b"".join(p + b"\0" * (int(t) * UNIT - len(p)) for p, t in zip(payloads, total))
    rows = np.frombuffer(raw, np.uint8).reshape(-1, UNIT).astype(np.uint16) + OFFSET
    nth = np.arange(len(rows)) - np.repeat(edges[:-1], total)
    luma, chroma = LUMA_BLOCKS * BLOCK_BYTES, CHROMA_BLOCKS * BLOCK_BYTES
    parts = [rows[:, :luma], rows[:, luma : luma + chroma], rows[:, luma + chroma :]]
    # A DC scan of constant zero: two macroblocks of six blocks, one bit each, per interval.
    zero = np.repeat(np.packbits(np.array([[0] * 12 + [1] * 4], np.uint8), axis=1), len(rows), 0)
    head = segment(0xC4, b"\x00" + DC_TABLE[0]) + segment(0xC4, b"\x10" + AC_FIRST[0]) + segment(0xC4, b"\x11" + AC_REFINE[0])
    head += segment(0xDD, struct.pack(">H", 2)) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0]))
    out = [[file_head(u, c, r) + head, coded] for u, c, r, coded in zip(units, columns, tall, interleaved(zero, nth, edges))]
    for component, values in enumerate(parts, 1):
        blocks = values.shape[1] // BLOCK_BYTES
        mark = segment(0xDD, struct.pack(">H", blocks))
        for first, last, high, low, coded in scan_rows(values.reshape(-1, blocks, BLOCK_BYTES)):
            mark += segment(0xDA, bytes([1, component, 1 if high else 0, first, last, high << 4 | low]))
            for chunks, body in zip(out, interleaved(coded, nth, edges)):
                chunks += (mark, body)
            mark = b""
    return [b"".join([*chunks, b"\xff\xd9"]) for chunks in out]


def file_head(units: int, columns: int, tall: int) -> bytes:
    """Start of image, quantisation by one, the unit count as a comment, and the frame."""
    frame = struct.pack(">BHHB", 8, tall * 16, columns * 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xFE, struct.pack(">Q", units)) + segment(0xC2, frame)


# ------------------------------------------------------------------ reading


#: A marker that is neither stuffing nor a restart.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@dataclass
class Component:
    h: int
    v: int
    table: int
    wide: int
    high: int
    stride: int
    tall: int


@dataclass
class Scan:
    picture: int
    components: list[tuple[int, int, int]]
    first: int
    last: int
    high: int
    low: int
    restart: int
    begin: int
    end: int
    tables: dict


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    coefficients: list[np.ndarray]
    comment: bytes = b""


def lookup(body: bytes) -> np.ndarray:
    """16-bit window -> length << 8 | symbol (0: no such code) of a DHT body."""
    table = np.zeros(1 << 16, np.uint16)
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(body[bits - 1]):
            lo = code << (16 - bits)
            table[lo : lo + (1 << (16 - bits))] = bits << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def parse(data: bytes, number: int, tables: dict[bytes, np.ndarray]) -> tuple[Picture, list[Scan]]:
    """Headers of one file: the picture with zeroed coefficients, and its scans in order."""
    at, restart, quant, huffman, scans, picture, comment = 2, 0, {}, {}, [], None, b""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, n = (2, 129) if body[0] >> 4 else (1, 65)
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[n:]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            raw = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            ids = [body[6 + 3 * i] for i in range(n)]
            hm, vm = max(r[0] for r in raw), max(r[1] for r in raw)
            mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
            parts = [Component(h, v, q, -(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8), mx * h, my * v) for h, v, q in raw]
            picture = Picture(width, height, parts, quant, [np.zeros((c.stride * c.tall, 64), np.int16) for c in parts])
        elif marker in (0xC0, 0xC1, 0xC3, 0xC9, 0xCA):
            raise ValueError("only progressive Huffman-coded files are read")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                key = bytes(body[1:n])
                if key not in tables:
                    tables[key] = lookup(key)
                huffman[body[0]] = key
                body = body[n:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            n = body[0]
            parts = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            begin = at
            at = MARKER.search(data, at).start()
            s, e, a = body[1 + 2 * n : 4 + 2 * n]
            scans.append(Scan(number, parts, s, e, a >> 4, a & 15, restart, begin, at, dict(huffman)))
    picture.comment = comment
    return picture, scans


def streams(data: np.ndarray, begins: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unstuffed bytes of all scans, the first byte of each restart interval, and its scan's place in the list."""
    lengths = np.array(ends) - np.array(begins)
    owner = np.repeat(np.arange(len(begins)), lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins, lengths)
    raw = data[at]
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    escape = escape[owner[escape] == owner[np.minimum(escape + 1, len(owner) - 1)]]
    after = raw[np.minimum(escape + 1, len(raw) - 1)]
    keep = np.ones(len(raw), bool)
    keep[escape[after == 0] + 1] = False
    marks = escape[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    new_place = np.cumsum(keep) - keep
    starts = np.concatenate([np.cumsum(lengths) - lengths, marks + 2])
    order = np.argsort(starts, kind="stable")
    scan_of = owner[np.minimum(starts[order], len(owner) - 1)] if len(owner) else np.zeros(0, int)
    return np.append(raw[keep], np.full(16, 0xFF, np.uint8)), new_place[starts[order]], scan_of


class Bits:
    """One read position for each stream, all moved together."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = data.astype(np.uint64)
        n = len(padded) - 8
        self.words = np.zeros(n, np.uint64)
        for k in range(6):
            self.words |= padded[k : k + n] << np.uint64(40 - 8 * k)
        self.at = starts.astype(np.int64) * 8

    def peek(self, who, bits: int) -> np.ndarray:
        at = self.at[who]
        word = self.words[np.minimum(at >> 3, len(self.words) - 1)]
        return ((word >> (48 - bits - (at & 7)).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def take(self, who, count: np.ndarray) -> np.ndarray:
        """The next ``count`` (0..32) bits of each stream in who."""
        got = self.peek(who, 32) >> (32 - count)
        self.at[who] += count
        return got

    def symbol(self, who, table: np.ndarray) -> np.ndarray:
        found = table[self.peek(who, 16)].astype(np.int64)
        if not found.all():
            raise ValueError("a code that its table doesn't have")
        self.at[who] += found >> 8
        return found & 255


def extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number of ``size`` bits that these bits stand for."""
    half = np.left_shift(1, np.maximum(size - 1, 0))
    return np.where(size == 0, 0, np.where(value < half, value - np.left_shift(1, size) + 1, value))


def ac_first(bits: Bits, table: np.ndarray, coefficients: np.ndarray, block: np.ndarray, stop: np.ndarray, first: int, last: int, low: int) -> None:
    """First scan of a band: each stream's blocks run from block to stop in the list of coefficient rows."""
    k = np.full(len(block), first)
    who = np.flatnonzero(block < stop)
    while len(who):
        code = bits.symbol(who, table)
        run, size = code >> 4, code & 15
        end = (size == 0) & (run < 15)
        value = bits.take(who, np.where(end, run, size))
        at = k[who] + run
        real = size > 0
        if at[real].max(initial=0) > last:
            raise ValueError("a run goes over the band's end")
        coefficients[block[who[real]], at[real]] = extended(value[real], size[real]) << low
        k[who] = at + 1
        over = who[end]
        block[over] += (np.left_shift(1, run) + value)[end]
        k[over] = first
        over = who[~end & (k[who] > last)]
        block[over] += 1
        k[over] = first
        who = who[block[who] < stop[who]]


def ac_refine(bits: Bits, table: np.ndarray, coefficients: np.ndarray, block: np.ndarray, stop: np.ndarray, first: int, last: int, low: int) -> None:
    """Refinement scan of a band: one correction bit for what is known, new values of one bit in between."""
    width = last - first + 1
    lanes = np.arange(width)
    k = np.zeros(len(block), int)
    who = np.flatnonzero(block < stop)
    while len(who):
        code = bits.symbol(who, table)
        run, size = code >> 4, code & 15
        end = (size == 0) & (run < 15)
        extra = bits.take(who, np.where(end, run, size))
        if end.any():
            rows = who[end]
            blocks = np.minimum((np.left_shift(1, run) + extra)[end], stop[rows] - block[rows])
            correct_runs(bits, coefficients, rows, block, k, blocks, first, last, low)
            block[rows] += blocks
            k[rows] = 0
        new = ~end
        if new.any():
            rows, skip = who[new], run[new]
            band = coefficients[block[rows], first : last + 1]
            ahead = lanes >= k[rows][:, None]
            blank = (band == 0) & ahead
            seen = np.cumsum(blank, axis=1)
            target = np.where((seen >= (skip + 1)[:, None]).any(1), (blank & (seen == (skip + 1)[:, None])).argmax(1), width)
            passed = (band != 0) & ahead & (lanes < target[:, None])
            correct(bits, coefficients, rows, block, passed, first, low)
            real = (size[new] > 0) & (target < width)
            coefficients[block[rows[real]], first + target[real]] = np.where(extra[new][real] == 1, 1, -1) << low
            k[rows] = target + 1
            over = rows[k[rows] >= width]
            block[over] += 1
            k[over] = 0
        who = who[block[who] < stop[who]]


def correct(bits: Bits, coefficients: np.ndarray, rows: np.ndarray, block: np.ndarray, where: np.ndarray, first: int, low: int) -> None:
    """Read a correction bit for each marked coefficient of one block of each stream in rows."""
    count = where.sum(1)
    owner, lane = np.nonzero(where)
    apply_bits(bits, coefficients, rows, count, block[rows][owner], first + lane, low)


def correct_runs(bits: Bits, coefficients: np.ndarray, rows: np.ndarray, block: np.ndarray, k: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    """The same for whole runs of blocks; the first block of a run goes on from place k."""
    owner = np.repeat(np.arange(len(rows)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = block[rows][owner] + nth
    known = coefficients[at, first : last + 1] != 0
    if k[rows].any():
        known &= (np.arange(last - first + 1) >= k[rows][owner][:, None]) | (nth > 0)[:, None]
    count = np.bincount(owner, known.sum(1), len(rows)).astype(np.int64)
    who, lane = np.nonzero(known)
    apply_bits(bits, coefficients, rows, count, at[who], first + lane, low)


def apply_bits(bits: Bits, coefficients: np.ndarray, rows: np.ndarray, count: np.ndarray, block: np.ndarray, place: np.ndarray, low: int) -> None:
    """One bit for each (block, place), which are in order; count of them belong to each stream in rows."""
    at = np.repeat(bits.at[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    word = bits.words[np.minimum(at >> 3, len(bits.words) - 1)]
    one = ((word >> (47 - (at & 7)).astype(np.uint64)) & np.uint64(1)).astype(np.int16)
    value = coefficients[block, place]
    coefficients[block, place] = value + np.where(value > 0, one, -one) * np.int16(1 << low)
    bits.at[rows] += count


def block_order(picture: Picture, index: int) -> slice | np.ndarray:
    """Rows of the coefficient array in the order of a scan of this component alone."""
    c = picture.components[index]
    if (c.wide, c.high) == (c.stride, c.tall):
        return slice(0, c.wide * c.high)
    return (np.arange(c.high)[:, None] * c.stride + np.arange(c.wide)).ravel()


def macroblock_order(picture: Picture, parts: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(component, row) of each block of an interleaved scan, and blocks in a macroblock."""
    out = []
    for i in parts:
        c = picture.components[i]
        rows = np.arange(c.stride * c.tall).reshape(c.tall // c.v, c.v, c.stride // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.h * c.v)
        out.append((np.full(rows.shape, i), rows))
    kinds, rows = (np.hstack(x) for x in zip(*out))
    return kinds.ravel(), rows.ravel(), kinds.shape[1]


def decode_coefficients(files: list[bytes]) -> list[Picture]:
    """All scans of all files, scan number by scan number, all restart intervals at once."""
    tables: dict[bytes, np.ndarray] = {}
    parsed = [parse(f, i, tables) for i, f in enumerate(files)]
    data = [np.frombuffer(f, np.uint8) for f in files]
    pictures = [p for p, _ in parsed]
    for step in range(max((len(s) for _, s in parsed), default=0)):
        groups: dict[tuple, list[Scan]] = {}
        for _, scans in parsed:
            if step < len(scans):
                s = scans[step]
                key = (s.first, s.last, s.high, s.low, tuple((c, s.tables.get(d) if not s.first else s.tables.get(16 + a)) for c, d, a in s.components))
                groups.setdefault(key, []).append(s)
        for (first, last, high, low, parts), scans in groups.items():
            decode_scans(pictures, data, scans, first, last, high, low, parts, tables)
    return pictures


def decode_scans(pictures, data, scans: list[Scan], first: int, last: int, high: int, low: int, parts: tuple, tables: dict) -> None:
    sizes = [s.end - s.begin for s in scans]
    raw = np.concatenate([data[s.picture][s.begin : s.end] for s in scans])
    ends = np.cumsum(sizes)
    stuffed, starts, scan_of = streams(raw, (ends - sizes).tolist(), ends.tolist())
    bits = Bits(stuffed, starts)
    nth = np.arange(len(starts)) - np.searchsorted(scan_of, scan_of)
    if first:
        index = parts[0][0]
        orders = [block_order(pictures[s.picture], index) for s in scans]
        parts_of = [pictures[s.picture].coefficients[index][o] for s, o in zip(scans, orders)]
        rows = np.array([len(p) for p in parts_of])
        base = np.cumsum(rows) - rows
        step = np.array([s.restart or n for s, n in zip(scans, rows.tolist())])
        block = base[scan_of] + nth * step[scan_of]
        stop = np.minimum(block + step[scan_of], (base + rows)[scan_of])
        joined = np.concatenate(parts_of)
        (ac_refine if high else ac_first)(bits, tables[parts[0][1]], joined, block, stop, first, last, low)
        for s, o, b, n in zip(scans, orders, base.tolist(), rows.tolist()):
            pictures[s.picture].coefficients[index][o] = joined[b : b + n]
        return
    orders = []
    for s in scans:
        if len(parts) == 1:
            rows = np.arange(len(pictures[s.picture].coefficients[parts[0][0]]))[block_order(pictures[s.picture], parts[0][0])]
            orders.append((np.full(len(rows), parts[0][0]), rows, 1))
        else:
            orders.append(macroblock_order(pictures[s.picture], [c for c, _ in parts]))
    per = orders[0][2]
    count = np.array([len(o[1]) for o in orders])
    base = np.cumsum(count) - count
    step = np.array([(s.restart or 1 << 40) * per for s in scans])
    block = base[scan_of] + nth * step[scan_of]
    stop = np.minimum(block + step[scan_of], (base + count)[scan_of])
    kinds = np.concatenate([o[0] for o in orders])
    values = np.zeros(len(kinds), np.int64)
    slots = {c: i for i, (c, _) in enumerate(parts)}
    lanes = orders[0][0][:per]
    before = np.zeros((len(starts), len(parts)), np.int64)
    who, place = np.flatnonzero(block < stop), 0
    while len(who):
        lane = int(lanes[place % per])
        if high:
            values[block[who]] = bits.take(who, np.ones(len(who), np.int64)) << low
        else:
            size = bits.symbol(who, tables[parts[slots[lane]][1]])
            before[who, slots[lane]] += extended(bits.take(who, size), size)
            values[block[who]] = before[who, slots[lane]] << low
        block[who] += 1
        place += 1
        who = who[block[who] < stop[who]]
    for s, (kind, rows, _), b in zip(scans, orders, base):
        for c, _ in parts:
            mine = kind == c
            target = pictures[s.picture].coefficients[c]
            target[rows[mine], 0] |= values[b : b + len(rows)][mine].astype(np.int16)


def payload_of(picture: Picture) -> bytes:
    """The bytes that encode() stored in the coefficients."""
    units = struct.unpack(">Q", picture.comment)[0]
    parts = [(c[:, 1 : BLOCK_BYTES + 1] - OFFSET).astype(np.uint8) for c in picture.coefficients]
    wide = (LUMA_BLOCKS * BLOCK_BYTES, CHROMA_BLOCKS * BLOCK_BYTES, CHROMA_BLOCKS * BLOCK_BYTES)
    return np.hstack([p.reshape(-1, w) for p, w in zip(parts, wide)])[:units].tobytes()


def rgb(picture: Picture) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3): inverse transform, chroma upsampling, colour conversion."""
    planes = []
    hm, vm = max(c.h for c in picture.components), max(c.v for c in picture.components)
    for c, coefficients in zip(picture.components, picture.coefficients):
        samples = (coefficients.astype(np.float32) * picture.quant[c.table]) @ BASIS + 128
        np.clip(np.rint(samples, out=samples), 0, 255, out=samples)
        plane = samples.reshape(c.tall, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.tall * 8, c.stride * 8)
        if (c.h, c.v) != (hm, vm):
            plane = plane.repeat(vm // c.v, 0).repeat(hm // c.h, 1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, k] = np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
    return out
