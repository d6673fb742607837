"""Snapshots of the entries: Parquet by drive, with the journal position each was taken at."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.cdc import catch_up, fold
from quarry.schema import ENTRY_COLUMNS, SNAPSHOT_VERSION

META = "version int, drive string, serial long, journal_id long, next_usn long, data string"


def save(entries: DataFrame, path: str, drive: str, serial: int, journal_id: int, next_usn: int) -> None:
    """Write a volume; the position must have been read before its entries.  The metadata row comes last.

    A failed save leaves the metadata of the one before, which names its own data folder.
    """
    spark = entries.sparkSession
    data = f"data-{drive}-{next_usn}"
    rows = entries.where(F.col("drive") == drive).drop("name_lower")
    rows.sortWithinPartitions(F.lower("name")).write.mode("overwrite").parquet(f"{path}/{data}")
    spark.createDataFrame([(SNAPSHOT_VERSION, drive, serial, journal_id, next_usn, data)], META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta-{drive}")


def load(spark: SparkSession, path: str, drive: str, serial: int) -> tuple[DataFrame, dict] | None:
    """Entries and metadata of a volume, or None if there is no snapshot of this version, drive and serial."""
    try:
        rows = spark.read.schema(META).parquet(f"{path}/meta-{drive}").collect()
    except AnalysisException:
        return None
    meta = rows[0].asDict() if len(rows) == 1 else {}
    if (meta.get("version"), meta.get("drive"), meta.get("serial")) != (SNAPSHOT_VERSION, drive, serial):
        return None
    entries = spark.read.parquet(f"{path}/{meta['data']}").withColumn("name_lower", F.lower("name"))
    return entries.select(*ENTRY_COLUMNS), meta


def bring_online(spark: SparkSession, path: str, drive: str, serial: int, journal: dict, changes: DataFrame, rebuild) -> tuple[DataFrame, str]:
    """A volume as it is now, and how it was had.

    ``caught``: a snapshot whose journal position still can be resumed, with all changes from that position on
    folded in.  ``changes`` are the journal's operations (as cdc.operations names them); those of other drives
    and earlier ones are left out.  ``stale``: what ``rebuild()`` reads, as there is no such snapshot.
    """
    found = load(spark, path, drive, serial)
    if not found or catch_up(found[1], journal) == "stale":
        return rebuild(), "stale"
    entries, meta = found
    tail = changes.where((F.col("drive") == drive) & (F.col("usn") >= meta["next_usn"]))
    return fold(entries, tail).select(*ENTRY_COLUMNS), "caught"
