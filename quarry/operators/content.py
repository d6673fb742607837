"""Content terms: entries joined to decoded bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import derive
from quarry.schema import MAX_BODY_BYTES, REPARSE_POINT


def containing(entries: DataFrame, bodies: DataFrame, terms: list[str], match_case: bool = False) -> DataFrame:
    """Files (no folders, no reparse points) whose body, (drive, record, text), holds all terms.

    Bodies are filtered before the join, so only those that match are moved.  Null bodies (binary files)
    hold nothing.
    """
    text = F.col("text") if match_case else F.lower("text")
    rows = bodies.where(F.col("text").isNotNull())
    for term in terms:
        rows = rows.where(text.contains(term if match_case else term.lower()))
    files = entries.where(~F.col("is_dir") & (F.col("attributes").bitwiseAND(F.lit(REPARSE_POINT)) == 0))
    return files.join(rows.select("drive", "record").distinct(), ["drive", "record"], "left_semi")


def decoded(files: DataFrame, raw_col: str = "content") -> DataFrame:
    """Bodies from raw bytes: binary ones get a null text."""
    return files.withColumn("text", derive.body_text(F.col(raw_col), MAX_BODY_BYTES)).drop(raw_col)
