"""Volume images: boot sector, data runs, file records and change records, read as a batch data source.

Partitions are slices of the master file table's runs, so a large image is read by many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.schema import DIRECTORY, RAW_RECORD

# Fixed values of the format: attribute types, name space of short names, records of a chunk.
STANDARD, FILE_NAME, DATA, END = 0x10, 0x30, 0x80, 0xFFFFFFFF
SHORT_NAMES, CHUNK_RECORDS = 2, 1024
RECORD_BITS = (1 << 48) - 1


class VolumeError(Exception):
    """A volume can't be read; other volumes can."""


class NotNtfs(VolumeError):
    pass


class Malformed(VolumeError):
    pass


@dataclass(frozen=True)
class Geometry:
    sector: int
    cluster: int
    record: int
    table_cluster: int


def geometry(boot: bytes) -> Geometry:
    """From the boot sector; a negative record size is a power of two in bytes."""
    if boot[3:11] != b"NTFS    ":
        raise NotNtfs("no NTFS signature")
    sector, clusters = struct.unpack_from("<HB", boot, 11)
    table = struct.unpack_from("<Q", boot, 0x30)[0]
    size = struct.unpack_from("<b", boot, 0x40)[0]
    cluster = sector * clusters
    if not cluster:
        raise Malformed("empty cluster")
    return Geometry(sector, cluster, 1 << -size if size < 0 else size * cluster, table)


def data_runs(raw: bytes) -> list[tuple[int | None, int]]:
    """(first cluster or None if sparse, clusters) of each run; places are signed steps from the one before."""
    out, at, place = [], 0, 0
    while at < len(raw) and raw[at]:
        wide, far = raw[at] & 15, raw[at] >> 4
        if at + 1 + wide + far > len(raw) or not wide:
            break
        count = int.from_bytes(raw[at + 1 : at + 1 + wide], "little")
        step = raw[at + 1 + wide : at + 1 + wide + far]
        place += int.from_bytes(step, "little", signed=True)
        out.append((place if far else None, count))
        at += 1 + wide + far
    return out


def number(kind: str, raw: bytes, at: int) -> int:
    """A little-endian number of a struct kind; 0 beyond the end, as on damaged records."""
    size = struct.calcsize(kind)
    return struct.unpack_from(f"<{kind}", raw, at)[0] if 0 <= at and at + size <= len(raw) else 0


def repaired(record: bytes, sector: int) -> bytes:
    """A record with its sectors' last two bytes put back, as far as the record and its list of them reach.

    The mark that stands there instead isn't compared: a torn record is read for what it still tells.
    """
    at, count = number("H", record, 4), number("H", record, 6)
    out = bytearray(record)
    for i in range(1, count if sector else 0):
        end, source = i * sector, at + 2 * i
        if end > len(record) or source + 2 > len(record):
            break
        out[end - 2 : end] = record[source : source + 2]
    return bytes(out)


def attributes_of(record: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, rest of the record from its header on) of each attribute that lies within the record."""
    at = number("H", record, 20)
    while at + 16 <= len(record):
        kind, size = number("I", record, at), number("I", record, at + 4)
        if kind == END or size < 16 or at + size > len(record):
            return
        yield kind, record[at:]
        at += size


def data_size(attribute: bytes) -> int:
    return number("Q", attribute, 48) if attribute[8] else number("I", attribute, 16)


def in_use(record: bytes) -> bool:
    return record[:4] == b"FILE" and bool(number("H", record, 22) & 1)


def file_record(record: bytes, place: int, drive: str) -> Iterator[tuple]:
    """A raw row for each name of a record in use, other than short names.  What lies beyond the record is left out."""
    if not in_use(record):
        return
    is_dir, times, bits, names, name_size, size = bool(number("H", record, 22) & 2), (0, 0, 0), 0, [], 0, None
    for kind, body in attributes_of(record):
        value = number("H", body, 20)
        if kind == STANDARD and value + 36 <= len(body):
            created, modified, accessed = (number("Q", body, value + k) for k in (0, 8, 24))
            times, bits = (modified, created, accessed), number("I", body, value + 32)
        elif kind == FILE_NAME and value + 66 <= len(body):
            start, end = value + 66, value + 66 + 2 * body[value + 64]
            if body[value + 65] != SHORT_NAMES and end <= len(body):
                names.append((number("Q", body, value) & RECORD_BITS, body[start:end].decode("utf-16-le", "replace")))
                name_size = number("Q", body, value + 48)
        elif kind == DATA and body[9] == 0:
            size = data_size(body)
    bits = bits | DIRECTORY if is_dir else bits & ~DIRECTORY
    for parent, name in names:
        yield drive, place, parent, name, is_dir, None if is_dir else name_size if size is None else size, *map(signed, times), bits


def signed(value: int) -> int:
    """Ticks as the table's signed number; what doesn't fit is damage and unknown."""
    return value if value < 1 << 63 else 0


def change_records(raw: bytes, drive: str) -> Iterator[tuple]:
    """(drive, usn, reference, parent, name, reason, attributes) of version 2 change records."""
    at = 0
    while at + 60 <= len(raw):
        size, major = struct.unpack_from("<IH", raw, at)
        if size < 60 or at + size > len(raw):
            return
        if major == 2:
            reference, parent, usn = struct.unpack_from("<QQQ", raw, at + 8)
            reason, _, _, bits, length, start = struct.unpack_from("<IIIIHH", raw, at + 40)
            yield drive, usn, reference, parent & RECORD_BITS, raw[at + start : at + start + length].decode("utf-16-le", "replace"), reason, bits
        at += size


@dataclass(frozen=True)
class Table:
    """Where the records of a volume are: its geometry, the runs of its table, and how many records that holds."""

    geometry: Geometry
    runs: tuple[tuple[int | None, int], ...]
    records: int

    @classmethod
    def of(cls, file) -> Table:
        g = geometry(file.read(512))
        file.seek(g.table_cluster * g.cluster)
        first = repaired(file.read(g.record), g.sector)
        if first[:4] != b"FILE":
            raise Malformed("the table's own record is damaged")
        body = next((b for k, b in attributes_of(first) if k == DATA and b[8] and not b[9]), None)
        if body is None:
            raise Malformed("the table has no runs")
        return cls(g, tuple(data_runs(body[number("H", body, 32) :])), data_size(body) // g.record)

    def stretches(self) -> Iterator[tuple[int, int, int]]:
        """(offset, first record, records) of the table's stretches on disk, up to its last record."""
        at = 0
        for place, clusters in self.runs:
            held = clusters * self.geometry.cluster // self.geometry.record
            if place is not None and at < self.records:
                yield place * self.geometry.cluster, at, min(held, self.records - at)
            at += held

    def record(self, file, place: int) -> bytes | None:
        """One record, repaired; None if the table doesn't hold it."""
        for offset, first, count in self.stretches():
            if first <= place < first + count:
                file.seek(offset + (place - first) * self.geometry.record)
                raw = file.read(self.geometry.record)
                return repaired(raw, self.geometry.sector) if len(raw) == self.geometry.record else None
        return None


def lookup(path: str, place: int, sequence: int, drive: str = "C") -> list[tuple]:
    """The rows of one record, if it is in use and still has this sequence number; reads that record alone."""
    with open(path, "rb") as f:
        record = Table.of(f).record(f, place)
    return list(file_record(record, place, drive)) if record and number("H", record, 16) == sequence else []


class Slice(InputPartition):
    def __init__(self, offset: int, first: int, count: int):
        super().__init__(offset)
        self.offset, self.first, self.count = offset, first, count


class ImageReader(DataSourceReader):
    """Reads the table of the image at option ``path``, on a file system that all executors mount."""

    def __init__(self, options: dict):
        self.path, self.drive = options["path"], options.get("drive", "C")

    def partitions(self) -> list[Slice]:
        with open(self.path, "rb") as f:
            table = Table.of(f)
        size = table.geometry.record
        return [
            Slice(offset + k * size, first + k, min(CHUNK_RECORDS, count - k)) for offset, first, count in table.stretches() for k in range(0, count, CHUNK_RECORDS)
        ]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            g = geometry(f.read(512))
            f.seek(partition.offset)
            raw = f.read(partition.count * g.record)
        for k in range(len(raw) // g.record):
            yield from file_record(repaired(raw[k * g.record : (k + 1) * g.record], g.sector), partition.first + k, self.drive)


class VolumeImage(DataSource):
    """spark.dataSource.register(VolumeImage); spark.read.format("volume-image").option("path", ...)"""

    @classmethod
    def name(cls) -> str:
        return "volume-image"

    def schema(self):
        return RAW_RECORD

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options)
