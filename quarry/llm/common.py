"""Shared plumbing of the operators: shared storage, Arrow batches of texts, bounded samples.

Every operator reads its input as a DataFrame and takes only the columns it names, so extra columns
(whatever they are called) never clash with what it adds.  Null texts count as empty ones.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import shared_dir

#: Bytes that Spark puts into one Arrow batch, the same for every operator; bytes of text that are processed at a time.
BATCH_BYTES = "8m"
SLICE_BYTES = 2_000_000

_held: list[tuple] = []


def held(key: tuple, make: Callable):
    """A worker's large object (an encoder, dictionaries), kept over its tasks until another key is asked for.

    Workers outlive a stage, so without this they would hold what every operator before has made.
    """
    if not _held or _held[0][0] != key:
        let_go()
        _held.append((key, make()))
    return _held[0][1]


def let_go() -> None:
    """Drop what held() keeps; for operators that need none."""
    _held.clear()


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have ended; else they stay until the driver's memory is short."""
    gc.collect()
    spark._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete a table made by stage_table that no later step reads."""
    spark, path = df.sparkSession, df._quarry_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch: texts are long, and a batch is held whole by a Python worker.

    Every operator sets the same value, so lazily run results don't depend on which one came last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold SLICE_BYTES at most (a longer text stands alone)."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """text_slices, each with its texts (null: empty)."""
    for part in text_slices(batch, column):
        yield part, [t or "" for t in part.column(column).to_numpy(zero_copy_only=False)]


def map_texts(docs: DataFrame, id_col: str, text_col: str, fn: Callable[[pa.Array, list[str]], dict], schema: str) -> DataFrame:
    """Apply fn(ids, texts) -> columns to slices of (id, text); the result has the columns of schema."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, 1):
                out = fn(part.column(0), texts)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def map_rows(docs: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch, list[str], int], pa.RecordBatch]) -> DataFrame:
    """Apply fn(rows, texts, place of the text column) to slices of whole rows; the columns stay what they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, at):
                yield fn(part, texts, at)

    return docs.mapInArrow(run, docs.schema)


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds (null id: null)."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def hashed_part(text: Column, key: Column, most: int) -> Column:
    """A text of at most ``most`` characters whole; of a longer one, so many from a place by the hash of the key."""
    room = F.greatest(F.length(text) - F.lit(most), F.lit(0)) + 1
    return F.substring(text, F.pmod(F.xxhash64(key, F.lit(11)), room.cast("long")).cast("int") + 1, F.lit(most))


def bounded_sample(df: DataFrame, class_col: str, key_col: str, most: int, most_classes: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each class, by the hash of the key, and the size of each class; a smaller class is taken whole.

    One aggregation counts the classes; only the ``most_classes`` with most rows (then by name) are kept, so what
    comes to the driver is bounded however many labels a dirty column holds.  Their sampling fractions are a map
    literal.  The expected size is ``most``, with a deviation of its square root, whatever the input's size.  Rows
    with a null class or key are left out.
    """
    df = df.where(F.col(class_col).isNotNull() & F.col(key_col).isNotNull())
    largest = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), class_col).limit(most_classes)
    counts = {r[0]: r[1] for r in largest.collect()}
    if not counts:
        return df.where(F.lit(False)), counts
    unit = F.shiftrightunsigned(F.xxhash64(F.col(key_col), F.lit(7)), 11).cast("double") / float(1 << 53)
    share = F.create_map(*(F.lit(x) for value, n in sorted(counts.items()) for x in (value, min(1.0, most / n))))
    return df.where(unit < F.coalesce(F.element_at(share, F.col(class_col)), F.lit(0.0))), counts
