"""The change stream as a fold over each record's links.

An event upserts or deletes a record.  Events of one record act in the order of their number; records don't
affect each other, so a fold for each (drive, record) is exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import derive
from quarry.schema import ROOT_RECORD

# Bits of a change's reason.
REASON_CLOSE, REASON_DELETE = 0x80000000, 0x200

LINK = ["parent", "name", "is_dir", "size", "modified_ms", "created_ms", "accessed_ms", "attributes"]
LINK_TYPE = "parent long, name string, is_dir boolean, size long, modified_ms long, created_ms long, accessed_ms long, attributes long"


def operations(changes: DataFrame) -> DataFrame:
    """Journal records as operations: only closing ones act; (reference, reason) become (record, seq, op)."""
    reason = F.col("reason")
    closed = changes.where(reason.bitwiseAND(F.lit(REASON_CLOSE)) != 0)
    op = F.when(reason.bitwiseAND(F.lit(REASON_DELETE)) != 0, "delete").otherwise("upsert")
    return closed.withColumn("record", derive.record_of(F.col("reference"))).withColumn("seq", derive.sequence_of(F.col("reference"))).withColumn("op", op)


def enriched(ops: DataFrame, meta: DataFrame) -> DataFrame:
    """Size, times and attributes from the live record if (record, seq) still is there; else what the event had."""
    fields = ["size", "modified_ms", "created_ms", "accessed_ms", "attributes"]
    live = meta.select("drive", "record", "seq", *(F.col(f).alias(f"live_{f}") for f in fields), F.lit(True).alias("found"))
    joined = ops.join(live, ["drive", "record", "seq"], "left")
    value = lambda f: F.when(F.col("found"), F.col(f"live_{f}")).otherwise(F.col(f))
    new = {f: value(f) for f in fields} | {"size": F.when(~F.col("is_dir"), value("size"))}
    return joined.withColumns(new).drop("found", *(f"live_{f}" for f in fields))


def valid(ops: DataFrame) -> DataFrame:
    """Upserts without a name, and those of the root, do nothing."""
    return ops.where((F.col("op") == "delete") | ((F.length("name") > 0) & (F.col("record") != ROOT_RECORD)))


def fold(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """Entries after all operations (drive, usn, record, op, and a link's columns).

    A deletion takes all links of a record, so only upserts after the last one count.  A record with one link or
    none then has the last upsert as its only link, whatever came between.  One with several keeps several: the
    last upsert of each (parent, name) takes the place of that link or is added.  So nothing but the last event
    of each record, parent and name is kept, by aggregation alone; rows of records that no operation names pass
    through.
    """
    key = ["drive", "record"]
    ops = valid(ops)
    gone = ops.where(F.col("op") == "delete").groupBy(key).agg(F.max("usn").alias("gone"))
    live = ops.where(F.col("op") != "delete").join(gone, key, "left").where(F.col("gone").isNull() | (F.col("usn") > F.col("gone")))
    named = live.groupBy(*key, "parent", "name").agg(F.max_by(F.struct(*LINK), "usn").alias("event"), F.max("usn").alias("usn"))
    links = entries.select(*key, F.struct(*LINK).alias("link"))
    touched = links.join(ops.select(key).distinct(), key, "left_semi").join(gone, key, "left_anti")
    several = touched.groupBy(key).agg(F.count(F.lit(1)).alias("links")).where("links > 1").select(key)
    # Several links: each with the last event of its name, and the events of new names.
    old = touched.join(several, key, "left_semi").withColumns({"parent": F.col("link.parent"), "name": F.col("link.name")})
    new = named.join(several, key, "left_semi").drop("usn")
    many = old.join(new, [*key, "parent", "name"], "full").select(*key, F.coalesce("event", "link").alias("link"))
    # One link or none: the last event of all.
    last = named.join(several, key, "left_anti").groupBy(key).agg(F.max_by("event", "usn").alias("event"))
    one = touched.join(several, key, "left_anti").join(last, key, "full").select(*key, F.coalesce("event", "link").alias("link"))
    rest = links.join(ops.select(key).distinct(), key, "left_anti")
    return rest.unionByName(many).unionByName(one).select(*key, "link.*").withColumn("name_lower", F.lower("name"))


def replay(links: list[dict], events: list[dict]) -> list[dict]:
    """The same fold of one record in plain Python, event by event; the stateful stream uses it, and tests compare it."""
    links = list(links)
    for e in events:
        if e["op"] == "delete":
            links = []
            continue
        if not e["name"] or e["record"] == ROOT_RECORD:
            continue
        link = {f: e[f] for f in LINK}
        if len(links) <= 1:
            links = [link]
        elif any((x["parent"], x["name"]) == (link["parent"], link["name"]) for x in links):
            links = [link if (x["parent"], x["name"]) == (link["parent"], link["name"]) else x for x in links]
        else:
            links.append(link)
    return links


def catch_up(saved: dict | None, journal: dict) -> str:
    """``caught`` if a saved position can be resumed, else ``stale``: the volume must be read anew."""
    fits = saved and saved["journal_id"] == journal["journal_id"] and saved["next_usn"] >= journal["lowest_valid_usn"]
    return "caught" if fits else "stale"


STATE_SCHEMA = T.StructType([T.StructField("links", T.ArrayType(T.StructType([
    T.StructField("parent", T.LongType()), T.StructField("name", T.StringType()), T.StructField("is_dir", T.BooleanType()), T.StructField("size", T.LongType()),
    T.StructField("modified_ms", T.LongType()), T.StructField("created_ms", T.LongType()), T.StructField("accessed_ms", T.LongType()), T.StructField("attributes", T.LongType()),
])))])


def plain(value):
    """A pandas value as a Python one."""
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value.item() if hasattr(value, "item") else value
