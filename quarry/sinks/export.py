"""Results as text, CSV or file lists: each row becomes one line by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import derive
from quarry.schema import EXPORT_LIMIT

# Headers of the formats.
HEADERS = {"txt": None, "csv": "Name,Path,Size,Date Modified,Date Created,Date Accessed,Attributes", "efu": "Filename,Size,Date Modified,Date Created,Attributes"}


#: Part files begin with "part".
HEADER_FILE = "header.txt"


def format_of(name: str) -> str:
    kind = name.lower()
    if kind not in HEADERS:
        raise ValueError(f"unknown export format: {name}")
    return kind


def quoted(text: Column) -> Column:
    """In quotes only if it holds a comma, a quote or a line break; quotes are doubled."""
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def guarded(text: Column) -> Column:
    """A text that a spreadsheet would run as a formula gets a tab before it."""
    risky = F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r")
    return F.when(risky, F.concat(F.lit('"\t'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(quoted(text))


def line(kind: str, tz: str = "UTC") -> Column:
    """A hit as a line of the format."""
    size, comma = F.col("size"), ","
    if format_of(kind) == "txt":
        return F.col("path")
    if kind == "csv":
        shown = F.when(size >= 0, size.cast("string")).otherwise("")
        times = [derive.local_time(F.col(t), tz) for t in ("modified", "created", "accessed")]
        return F.concat_ws(comma, guarded(F.col("name")), guarded(F.col("path")), shown, *times, derive.attribute_letters(F.col("attributes")))
    ticks = [derive.ms_to_filetime(F.col(t)).cast("string") for t in ("modified", "created")]
    return F.concat_ws(comma, quoted(F.col("path")), F.greatest(size, F.lit(0)).cast("string"), *ticks, F.col("attributes").cast("string"))


def lines(hits: DataFrame, kind: str, tz: str = "UTC") -> DataFrame:
    return hits.select(line(kind, tz).alias("line"))


def write(hits: DataFrame, path: str, kind: str, tz: str = "UTC", total: int | None = None, most: int = EXPORT_LIMIT) -> dict:
    """Write ordered hits, at most ``most``, as part files with the header first; {written, total, capped}.

    The header is a file whose name sorts before those of the rows.  Rows are in one file, in their order: an
    export is bounded by ``most`` rows.
    """
    count = hits.count() if total is None else total
    rows, header = lines(hits.limit(most), kind, tz), HEADERS[format_of(kind)]
    rows.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    if header:
        spark = hits.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{HEADER_FILE}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray((header + "\n").encode()))
        out.close()
    return {"written": min(count, most), "total": count, "capped": count > most}
