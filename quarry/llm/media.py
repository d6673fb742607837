"""Media columns: texts as progressive JPEG files, read back to payload bytes and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import jpeg
from quarry.llm.common import slices, small_batches

#: Files that are read together; their coefficients take about 12 bytes a payload byte.
MEDIA_SLICE = 3_000_000


def payload(text: str) -> bytes:
    """UTF-8 of the text, filled with bytes 255 to a positive multiple of the format's unit."""
    raw = text.encode("utf-8", "replace")
    return raw + b"\xff" * (max(1, -(-len(raw) // jpeg.UNIT)) * jpeg.UNIT - len(raw))


def feature(tensor: np.ndarray) -> str:
    """Size of the picture, and mean and mean square of each channel."""
    flat = tensor.reshape(-1, 3).astype(np.int64)
    sums, squares = flat.sum(0), (flat * flat).sum(0)
    return f"{tensor.shape[1]}x{tensor.shape[0]}:" + ",".join(f"{s / len(flat):.4f}/{q / len(flat):.4f}" for s, q in zip(sums.tolist(), squares.tolist()))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media: id_col, n_bytes (of the text in UTF-8) and media, a progressive JPEG that holds them losslessly.

    Null and empty texts are one unit of padding.  Repeated rows give repeated media; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, 1):
                media = jpeg.encode_many([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


def media_slices(files: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, f in enumerate(files):
        if size and size + len(f) > MEDIA_SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(f)
    if begin < len(files):
        yield begin, len(files)


def tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Full-resolution RGB tensors: id_col, height, width, rgb (row by row, three bytes a pixel).  Null media: nulls."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, files = batch.column("id"), batch.column("media").to_pylist()
            whole = [f or b"" for f in files]
            for a, b in media_slices(whole):
                known = [i for i in range(a, b) if whole[i]]
                out = dict(zip(known, map(jpeg.rgb, jpeg.decode_coefficients([whole[i] for i in known]))))
                rows = [(t.shape[0], t.shape[1], t.tobytes()) if (t := out.get(i)) is not None else (None, None, None) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary())))], names=[id_col, "height", "width", "rgb"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"{id_col} {kind}, height int, width int, rgb binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """store(), then every file is decoded from its bytes: digests of the payload and the file, and a feature of the tensor.

    Columns: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            files = batch.column("media").to_pylist()
            for a, b in media_slices(files):
                rows = []
                for data, picture in zip(files[a:b], jpeg.decode_coefficients(files[a:b])):
                    raw = jpeg.payload_of(picture)
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(jpeg.rgb(picture))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(a, b - a), batch.column("n_bytes").slice(a, b - a), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=names)

    return store(docs, id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
