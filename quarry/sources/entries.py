"""The test tables as three volumes of file entries, a change journal and file bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schema import ENTRY_COLUMNS

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(df: DataFrame, drive: str, record, parent, name) -> DataFrame:
    return df.select(F.lit(drive).alias("drive"), record.cast("long").alias("record"), F.lit(parent).cast("long").alias("parent") if isinstance(parent, int) else parent.cast("long").alias("parent"), name.alias("name"), F.lit(True).alias("is_dir"), *nothing("size", "modified_ms", "created_ms", "accessed_ms"), F.lit(16).cast("long").alias("attributes"))


def nothing(*names: str) -> list:
    return [F.lit(None).cast("long").alias(n) for n in names]


def volume_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = F.col
    key, day = col("o_orderkey"), F.unix_date(col("o_orderdate").cast("date")).cast("long") * DAY_MS
    orders = table(spark, sf_dir, "orders").select(
        F.lit("C").alias("drive"), (key + 100_000_000).alias("record"), (col("o_custkey") + 1_000_000).alias("parent"),
        F.concat(F.lit("order-"), key.cast("string"), F.lit("."), F.lower(F.substring("o_orderpriority", 3, 3))).alias("name"), F.lit(False).alias("is_dir"),
        F.when(key % 97 != 0, F.floor(col("o_totalprice") * 100).cast("long")).alias("size"), day.alias("modified_ms"), (day - key % 30 * DAY_MS).alias("created_ms"),
        F.when(key % 13 != 0, day + key % 10 * DAY_MS).alias("accessed_ms"),
        (32 + F.when(key % 7 == 0, 1).otherwise(0) + F.when(key % 11 == 0, 2).otherwise(0)).cast("long").alias("attributes"),
    )
    regions = folder(table(spark, sf_dir, "region"), "C", col("r_regionkey") + 100, 5, col("r_name"))
    nations = folder(table(spark, sf_dir, "nation"), "C", col("n_nationkey") + 1000, col("n_regionkey") + 100, col("n_name"))
    customers = folder(table(spark, sf_dir, "customer"), "C", col("c_custkey") + 1_000_000, col("c_nationkey") + 1000, col("c_name"))
    return regions.unionByName(nations).unionByName(customers).unionByName(orders)


def volume_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts below every supplier that ships them: records with several links."""
    col = F.col
    shipped = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = table(spark, sf_dir, "part").join(shipped, col("p_partkey") == col("l_partkey")).select(
        F.lit("D").alias("drive"), (col("p_partkey") + 200_000_000).alias("record"), (col("l_suppkey") + 10_000).alias("parent"), F.concat("p_name", F.lit("."), F.lower("p_type")).alias("name"),
        F.lit(False).alias("is_dir"), (col("p_size").cast("long") * 1024).alias("size"), *nothing("modified_ms", "created_ms", "accessed_ms"), F.lit(32).cast("long").alias("attributes"),
    )
    return folder(table(spark, sf_dir, "supplier"), "D", col("s_suppkey") + 10_000, 5, col("s_name")).unionByName(parts)


def volume_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, docs = F.col, table(spark, sf_dir, "documents")
    at = F.when(col("lang") == "en", 1).when(col("lang") == "de", 2).when(col("lang") == "fr", 3).otherwise(4)
    home = 400 + 100 * at + F.substring("source", 4, 9).cast("int")
    languages = folder(docs.select("lang").distinct(), "E", 300 + at, 5, col("lang"))
    sources = folder(docs.select("lang", "source").distinct(), "E", home, 300 + at, col("source"))
    ending = F.element_at(F.array(*map(F.lit, ("txt", "log", "md", "csv"))), (col("doc_id") % 4 + 1).cast("int"))
    files = docs.select(
        F.lit("E").alias("drive"), (col("doc_id") + 300_000_000).alias("record"), home.cast("long").alias("parent"), F.concat(F.lit("doc-"), col("doc_id").cast("string"), F.lit("."), ending).alias("name"),
        F.lit(False).alias("is_dir"), col("n_chars").alias("size"), *nothing("modified_ms", "created_ms", "accessed_ms"), F.lit(32).cast("long").alias("attributes"),
    )
    return languages.unionByName(sources).unionByName(files)


def entries(spark: SparkSession, sf_dir: str, drives: str = "CDE") -> DataFrame:
    parts = [v(spark, sf_dir) for d, v in (("C", volume_c), ("D", volume_d), ("E", volume_e)) if d in drives]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("name_lower", F.lower("name")).select(*ENTRY_COLUMNS)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("E").alias("drive"), (F.col("doc_id") + 300_000_000).alias("record"), "text")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal of volume C; views don't close, errors delete."""
    return journal_of(table(spark, sf_dir, "events"))


def journal_of(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    return events.select(
        F.lit("C").alias("drive"), F.col("event_id").alias("usn"), (user + 100_000_000).alias("record"), (user + 1_000_000).alias("parent"),
        F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k"), F.lit(".log")).alias("name"), F.lit(False).alias("is_dir"), *nothing("size", "modified_ms", "created_ms", "accessed_ms"),
        F.lit(32).cast("long").alias("attributes"), (F.col("event_type") != "view").alias("is_close"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
    )
