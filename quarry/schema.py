"""Columns and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
ROOT_RECORD = 5
MAX_DEPTH = 4096
EPOCH_DIFF_MS = 11_644_473_600_000
DIRECTORY, REPARSE_POINT = 0x10, 0x400
DEFAULT_LIMIT, SERVICE_LIMIT, CONTENT_CANDIDATES, EXPORT_LIMIT = 5_000, 200_000, 50_000, 1_000_000
MAX_BODY_BYTES = 32 * 1024 * 1024
SNAPSHOT_VERSION = 2

RAW_RECORD = T.StructType([
    T.StructField("drive", T.StringType()), T.StructField("record", T.LongType()), T.StructField("parent", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("is_dir", T.BooleanType()), T.StructField("size", T.LongType()),
    T.StructField("modified_ft", T.LongType()), T.StructField("created_ft", T.LongType()), T.StructField("accessed_ft", T.LongType()),
    T.StructField("attributes", T.LongType()),
])

ENTRY_COLUMNS = ["drive", "record", "parent", "name", "name_lower", "is_dir", "size", "modified_ms", "created_ms", "accessed_ms", "attributes"]
HIT_COLUMNS = ["drive", "record", "parent", "name", "path", "size", "modified", "created", "accessed", "attributes", "is_dir"]
