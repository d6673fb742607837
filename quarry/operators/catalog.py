"""Building the entries table: raw records to entries, volumes, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import derive
from quarry.schema import ENTRY_COLUMNS, ROOT_RECORD


def entries_of(raw: DataFrame) -> DataFrame:
    """Raw records as entries: empty names and the root go, names are folded once, times become milliseconds."""
    kept = raw.where((F.length("name") > 0) & (F.col("record") != ROOT_RECORD))
    times = {f"{t}_ms": derive.filetime_to_ms(F.col(f"{t}_ft")) for t in ("modified", "created", "accessed")}
    return kept.withColumn("name_lower", F.lower("name")).withColumns(times).select(*ENTRY_COLUMNS)


def usable_volumes(volumes: DataFrame) -> DataFrame:
    """Fixed drives with an NTFS file system, from (drive, drive_type, fs, serial)."""
    return volumes.where((F.col("drive_type") == 3) & (F.lower("fs") == "ntfs"))


def replace_volume(entries: DataFrame, volume: DataFrame, drive: str) -> DataFrame:
    """All volumes with one put in place of what it was."""
    return entries.where(F.col("drive") != drive).unionByName(volume.select(*entries.columns))


def volume(entries: DataFrame, drive: str) -> DataFrame:
    return entries.where(F.col("drive") == drive)


def links_per_record(entries: DataFrame) -> DataFrame:
    return entries.groupBy("drive", "record").agg(F.count(F.lit(1)).alias("links"))


def status(entries: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row a volume: state, count, message.

    ``runs`` (drive, read, error) tells of volumes that are being read, or failed: the state is ``error`` with its
    text, or ``indexing`` with the records read so far; every other volume with entries is ``ready``.
    """
    counts = entries.groupBy("drive").agg(F.count(F.lit(1)).alias("count"))
    if runs is None:
        return counts.select("drive", F.lit("ready").alias("state"), "count", F.lit(None).cast("string").alias("message"))
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("read").isNotNull(), "indexing").otherwise("ready")
    shown = F.coalesce(F.when(F.col("error").isNull(), F.col("read")), "count", F.lit(0).cast("long"))
    return counts.join(runs, "drive", "full").select("drive", state.alias("state"), shown.alias("count"), F.col("error").alias("message"))


def store(entries: DataFrame, path: str, slots: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Entries written in the order of the first screen (name, drive, parent, record), and how many each slot holds.

    A slot is a range of that order and a partition of the table, so a page of the whole catalog reads the
    slots that hold it and no others, and name prefixes skip files by their statistics.
    """
    order = ["name_lower", "drive", "parent", "record"]
    ranged = entries.repartitionByRange(slots, *order).withColumn("slot", F.spark_partition_id()).sortWithinPartitions(*order)
    ranged.write.partitionBy("slot").parquet(path)
    stored = entries.sparkSession.read.schema(ranged.schema).parquet(path)
    return stored, sorted((r[0], r[1]) for r in stored.groupBy("slot").count().collect())


def slots_of_page(counts: list[tuple[int, int]], limit: int, descending: bool) -> list[int]:
    """The slots that hold the first (or last) ``limit`` entries."""
    out, have = [], 0
    for slot, n in reversed(counts) if descending else counts:
        if have >= limit:
            break
        out.append(slot)
        have += n
    return out
