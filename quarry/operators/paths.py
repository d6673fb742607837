"""Full paths from parent pointers, by pointer doubling over the folders alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import MAX_DEPTH, ROOT_RECORD
from quarry.storage import written


def folder_paths(entries: DataFrame) -> DataFrame:
    """(drive, record, folder_path) of every record that is the parent of some entry.

    Each folder holds the names down from an ancestor, and that ancestor; a round joins it to the ancestor's
    own row, so the distance doubles: the rounds are the logarithm of the depth.  Of a record with several
    links the smallest (parent, name) counts.  A folder whose parent is the root, or is missing, begins at the
    drive.  Folders in a parent cycle, and below one, keep the names that 4096 levels would cut: their path
    has their own name only.
    """
    parents = entries.select("drive", F.col("parent").alias("record")).distinct().where(F.col("record") != ROOT_RECORD)
    nodes = entries.join(parents, ["drive", "record"], "left_semi").groupBy("drive", "record").agg(F.min(F.struct("parent", "name")).alias("link"))
    known = nodes.select("drive", F.col("record").alias("up"))
    state = nodes.select("drive", "record", F.col("link.parent").alias("up"), F.col("link.name").alias("below"), F.col("link.name").alias("own"))
    state = state.join(known.withColumn("there", F.lit(True)), ["drive", "up"], "left").select("drive", "record", F.when(F.col("there"), F.col("up")).alias("up"), "below", "own")
    state, levels = written(state, "folders"), 1
    while levels < MAX_DEPTH and not state.where("up is not null").isEmpty():
        above = state.select("drive", F.col("record").alias("up"), F.col("up").alias("next"), F.col("below").alias("head"))
        joined = state.join(above, ["drive", "up"], "left")
        state = written(joined.select("drive", "record", F.col("next").alias("up"), F.concat_ws("\\", "head", "below").alias("below"), "own"), "folders")
        levels *= 2
    names = F.when(F.col("up").isNull(), F.col("below")).otherwise(F.col("own"))
    return state.select("drive", "record", F.concat("drive", F.lit(":\\"), names).alias("folder_path"))


def with_paths(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries with ``path``; one join, which Spark broadcasts if the folders are few."""
    above = folders.select("drive", F.col("record").alias("parent"), "folder_path")
    joined = entries.join(above, ["drive", "parent"], "left")
    base = F.coalesce(F.concat("folder_path", F.lit("\\")), F.concat("drive", F.lit(":\\")))
    return joined.withColumn("path", F.concat(base, "name")).drop("folder_path")
