"""Queries over the test tables, one an operator, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import derive
from quarry.operators import catalog as volumes
from quarry.operators import cdc
from quarry.operators.paths import folder_paths, with_paths
from quarry.plans import search
from quarry.plans.query import SearchOptions
from quarry.plans.search import Catalog
from quarry.sinks import export
from quarry.sources import entries as source
from quarry.streaming import journal as streaming

Query = Callable[[SparkSession, str], DataFrame]

# ------------------------------------------------------------------ the entries in SQL

ENTRIES_SQL = """
  SELECT 'C' AS drive, CAST(100 + r_regionkey AS BIGINT) AS record, CAST(5 AS BIGINT) AS parent, r_name AS name, true AS is_dir, CAST(NULL AS BIGINT) AS size,
         CAST(NULL AS BIGINT) AS modified_ms, CAST(NULL AS BIGINT) AS created_ms, CAST(NULL AS BIGINT) AS accessed_ms, CAST(16 AS BIGINT) AS attributes FROM region
  UNION ALL SELECT 'C', 1000 + n_nationkey, 100 + n_regionkey, n_name, true, NULL, NULL, NULL, NULL, 16 FROM nation
  UNION ALL SELECT 'C', 1000000 + c_custkey, 1000 + c_nationkey, c_name, true, NULL, NULL, NULL, NULL, 16 FROM customer
  UNION ALL SELECT 'C', 100000000 + o_orderkey, 1000000 + o_custkey, 'order-' || o_orderkey || '.' || lower(substr(o_orderpriority, 3, 3)), false,
         CASE WHEN o_orderkey % 97 <> 0 THEN CAST(floor(o_totalprice * 100) AS BIGINT) END, epoch_ms(o_orderdate), epoch_ms(o_orderdate) - (o_orderkey % 30) * 86400000,
         CASE WHEN o_orderkey % 13 <> 0 THEN epoch_ms(o_orderdate) + (o_orderkey % 10) * 86400000 END,
         32 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END FROM orders
  UNION ALL SELECT 'D', 10000 + s_suppkey, 5, s_name, true, NULL, NULL, NULL, NULL, 16 FROM supplier
  UNION ALL SELECT 'D', 200000000 + p_partkey, 10000 + l_suppkey, p_name || '.' || lower(p_type), false, p_size * 1024, NULL, NULL, NULL, 32
         FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON p_partkey = l_partkey
  UNION ALL SELECT DISTINCT 'E', 300 + {at}, 5, lang, true, NULL, NULL, NULL, NULL, 16 FROM documents
  UNION ALL SELECT DISTINCT 'E', 400 + 100 * {at} + CAST(substr(source, 4) AS INT), 300 + {at}, source, true, NULL, NULL, NULL, NULL, 16 FROM documents
  UNION ALL SELECT 'E', 300000000 + doc_id, 400 + 100 * {at} + CAST(substr(source, 4) AS INT), 'doc-' || doc_id || '.' || ['txt', 'log', 'md', 'csv'][doc_id % 4 + 1], false,
         n_chars, NULL, NULL, NULL, 32 FROM documents
""".replace("{at}", "(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END)")

#: entries, the folders' paths (region 4 of volume C may be taken out), and entries with paths.
BASE_SQL = f"""WITH RECURSIVE e0 AS ({ENTRIES_SQL}), entries AS (SELECT *, lower(name) AS name_lower FROM e0 WHERE NOT ({{without}})),
 folders AS (
  SELECT d.drive, d.record, d.drive || ':\\' || d.name AS folder_path FROM entries d LEFT JOIN entries u ON u.drive = d.drive AND u.record = d.parent AND u.is_dir
   WHERE d.is_dir AND u.record IS NULL
  UNION ALL SELECT d.drive, d.record, f.folder_path || '\\' || d.name FROM entries d JOIN folders f ON d.drive = f.drive AND d.parent = f.record WHERE d.is_dir),
 pathed AS (SELECT e.*, coalesce(f.folder_path || '\\', e.drive || ':\\') || e.name AS path, lower(coalesce(f.folder_path || '\\', e.drive || ':\\') || e.name) AS path_lower
  FROM entries e LEFT JOIN folders f ON f.drive = e.drive AND f.record = e.parent)
"""
ORPHANS = "drive = 'C' AND record = 104"


def base_sql(without: str = "false") -> str:
    return BASE_SQL.replace("{without}", without)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(source.entries(spark, sf_dir))


# ------------------------------------------------------------------ predicates: options, and the condition in SQL

NOW = datetime(1995, 6, 14, 12, 0)


def ms(day: str) -> str:
    return f"epoch_ms(TIMESTAMP '{day}')"


SIZED = "(NOT is_dir AND size IS NOT NULL AND size"
PREDICATES: dict[str, tuple[dict, str]] = {
    "substr_ci": ({"query": "ORDER-12"}, "contains(name_lower, 'order-12')"),
    "substr_case": ({"query": "Customer", "match_case": True}, "contains(name, 'Customer')"),
    "phrase_literal": ({"query": '"order-1"'}, "contains(name_lower, 'order-1')"),
    "and_terms": ({"query": "order 12 low"}, "contains(name_lower, 'order') AND contains(name_lower, '12') AND contains(name_lower, 'low')"),
    "or_terms": ({"query": "urg | hig"}, "contains(name_lower, 'urg') OR contains(name_lower, 'hig')"),
    "not_term": ({"query": "order !urg"}, "contains(name_lower, 'order') AND NOT contains(name_lower, 'urg')"),
    "group_and_or": ({"query": "order (low | hig) !urg"}, "contains(name_lower, 'order') AND (contains(name_lower, 'low') OR contains(name_lower, 'hig')) AND NOT contains(name_lower, 'urg')"),
    "group_negated": ({"query": "doc !(txt | log)"}, "contains(name_lower, 'doc') AND NOT (contains(name_lower, 'txt') OR contains(name_lower, 'log'))"),
    "double_not": ({"query": "!!urg"}, "contains(name_lower, 'urg')"),
    "glob_suffix": ({"query": "*.low"}, "name_lower LIKE '%.low'"),
    "glob_qmark": ({"query": "order-1?.???"}, "name_lower LIKE 'order-1_.___'"),
    "glob_path_unanchored": ({"query": "*.md", "match_path": True}, "path_lower LIKE '%.md%'"),
    "glob_path_rooted": ({"query": "E:\\en\\*.csv"}, "path_lower LIKE 'e:\\en\\%.csv' ESCAPE '!'"),
    "whole_word": ({"query": "12", "whole_word": True}, "regexp_matches(name_lower, '(^|[^a-z0-9_])12([^a-z0-9_]|$)')"),
    "whole_word_dot": ({"query": ".txt", "whole_word": True}, "regexp_matches(name_lower, '\\.txt([^a-z0-9_]|$)')"),
    "regex_name": ({"query": "^ORDER-[0-9]{2}\\.(low|urg)$", "regex": True}, "regexp_matches(name_lower, '^order-[0-9]{2}\\.(low|urg)$')"),
    "regex_path": ({"query": "^e:.*src1\\\\doc", "regex": True, "match_path": True}, "regexp_matches(path_lower, '^e:.*src1\\\\doc')"),
    "ext_single": ({"query": "ext:low"}, "name_lower LIKE '%.low'"),
    "ext_list": ({"query": "ext:txt;md,csv"}, "name_lower LIKE '%.txt' OR name_lower LIKE '%.md' OR name_lower LIKE '%.csv'"),
    "ext_leading_dot": ({"query": "EXT:.Log"}, "name_lower LIKE '%.log'"),
    "file_only": ({"query": "file: 99"}, "NOT is_dir AND contains(name_lower, '99')"),
    "folder_only": ({"query": "dir: customer"}, "is_dir AND contains(name_lower, 'customer')"),
    "attrib_one": ({"query": "attrib:h"}, "(attributes & 2) = 2"),
    "attrib_all_bits": ({"query": "attrib:rha"}, "(attributes & 35) = 35"),
    "never_malformed": ({"query": "size:gb order"}, "false"),
    "not_never": ({"query": "!size:gb urg"}, "contains(name_lower, 'urg')"),
    "blank_filter_dropped": ({"query": "size: dm: urg"}, "contains(name_lower, 'urg')"),
    "path_fragment": ({"query": "src1\\doc-1"}, "contains(path_lower, 'src1\\doc-1')"),
    "path_function": ({"query": "path:src7"}, "contains(path_lower, 'src7')"),
    "drive_term": ({"query": "e: 77"}, "drive = 'E' AND contains(name_lower, '77')"),
    "match_path_plain": ({"query": "src3", "match_path": True}, "contains(path_lower, 'src3')"),
    "match_all": ({"query": ""}, "true"),
    "size_gt": ({"query": "size:>10mb"}, f"{SIZED} > 10485760)"),
    "size_ge_lt": ({"query": "size:>=1mb size:<16mb"}, f"{SIZED} >= 1048576) AND {SIZED} < 16777216)"),
    "size_eq": ({"query": "size:=10kb"}, f"{SIZED} = 10240)"),
    "size_range": ({"query": "size:1.5kb..20kb"}, f"{SIZED} BETWEEN 1536 AND 20480)"),
    "size_range_reversed": ({"query": "size:20kb..1.5kb"}, f"{SIZED} BETWEEN 1536 AND 20480)"),
    "size_open_hi": ({"query": "size:40mb.."}, f"{SIZED} >= 41943040)"),
    "size_open_lo": ({"query": "size:..4k"}, f"{SIZED} <= 4096)"),
    "size_lt_zero": ({"query": "size:<0"}, "false"),
    "not_size_unknown": ({"query": "!size:>1kb"}, f"NOT {SIZED} > 1024)"),
    "dm_year": ({"query": "dm:1995"}, f"modified_ms >= {ms('1995-01-01')} AND modified_ms < {ms('1996-01-01')}"),
    "dm_month": ({"query": "dm:1995/06"}, f"modified_ms >= {ms('1995-06-01')} AND modified_ms < {ms('1995-07-01')}"),
    "dm_day": ({"query": "dm:1995-06-14"}, f"modified_ms >= {ms('1995-06-14')} AND modified_ms < {ms('1995-06-15')}"),
    "dm_gt": ({"query": "dm:>1996"}, f"modified_ms >= {ms('1997-01-01')}"),
    "dm_le": ({"query": "dm:<=1995-02"}, f"modified_ms < {ms('1995-03-01')}"),
    "dm_range": ({"query": "dm:1997..1996-02"}, f"modified_ms >= {ms('1996-02-01')} AND modified_ms < {ms('1998-01-01')}"),
    "dm_range_open": ({"query": "dm:1997.."}, f"modified_ms >= {ms('1997-01-01')}"),
    "dc_range": ({"query": "dc:1995..1996"}, f"created_ms >= {ms('1995-01-01')} AND created_ms < {ms('1997-01-01')}"),
    "da_range": ({"query": "da:..1995-06"}, f"accessed_ms < {ms('1995-07-01')}"),
    "dm_keyword_fixed_now": ({"query": "dm:lastmonth", "now": NOW}, f"modified_ms >= {ms('1995-05-01')} AND modified_ms < {ms('1995-06-01')}"),
    "dm_week_fixed_now": ({"query": "dm:thisweek", "now": NOW}, f"modified_ms >= {ms('1995-06-12')} AND modified_ms < {ms('1995-06-19')}"),
    "not_dm_unknown": ({"query": "!dm:>1992"}, f"NOT coalesce(modified_ms >= {ms('1993-01-01')}, false)"),
}

# ------------------------------------------------------------------ sorted pages: options, and the order in SQL

SIZE_KEY = "CASE WHEN is_dir THEN -1 ELSE coalesce(size, -1) END"
EXT_KEY = "CASE WHEN NOT is_dir AND regexp_matches(name_lower, '.\\.[^.]*$') THEN regexp_extract(name_lower, '\\.([^.]*)$', 1) ELSE '' END"
PAGES: dict[str, tuple[dict, str, str]] = {
    "topk_name_asc": ({"query": "order", "limit": 100}, "contains(name_lower, 'order')", "name_lower"),
    "topk_name_desc": ({"query": "", "limit": 100, "descending": True}, "true", "name_lower DESC"),
    "topk_size_desc": ({"query": "file:", "limit": 200, "sort": "size", "descending": True}, "NOT is_dir", f"{SIZE_KEY} DESC"),
    "topk_modified_desc": ({"query": "", "limit": 150, "sort": "modified", "descending": True}, "true", "coalesce(modified_ms, 0) DESC"),
    "topk_created": ({"query": "order", "limit": 150, "sort": "created"}, "contains(name_lower, 'order')", "coalesce(created_ms, 0)"),
    "topk_accessed": ({"query": "ext:urg", "limit": 150, "sort": "accessed"}, "name_lower LIKE '%.urg'", "coalesce(accessed_ms, 0)"),
    "topk_ext": ({"query": "file: 1", "limit": 300, "sort": "ext"}, "NOT is_dir AND contains(name_lower, '1')", EXT_KEY),
    "topk_attributes": ({"query": "", "limit": 100, "sort": "attributes", "descending": True}, "true", "attributes DESC"),
    "topk_path": ({"query": "doc", "limit": 100, "sort": "path"}, "contains(name_lower, 'doc')", "path_lower"),
    "topk_folders_first_asc": ({"query": "1", "limit": 900, "folders_first": True}, "contains(name_lower, '1')", "is_dir DESC, name_lower"),
    "topk_folders_first_desc": ({"query": "", "limit": 1200, "folders_first": True, "sort": "size", "descending": True}, "true", f"is_dir DESC, {SIZE_KEY} DESC"),
    "multi_volume_merge": ({"query": "0", "limit": 500}, "contains(name_lower, '0')", "name_lower"),
    "browse_all": ({"query": ""}, "true", "name_lower"),
}

HIT_SQL = f"drive, record, parent, name, path, {SIZE_KEY} AS size, coalesce(modified_ms, 0) AS modified, coalesce(created_ms, 0) AS created, coalesce(accessed_ms, 0) AS accessed, attributes, is_dir"


def predicate_query(options: dict) -> Query:
    return lambda spark, sf_dir: search.matching(catalog(spark, sf_dir), SearchOptions(**options)).select("drive", "record", "parent", "name")


def page_query(options: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = SearchOptions(**options)
        return search.ranked(search.page(catalog(spark, sf_dir), wanted), wanted)

    return run


def page_sql(condition: str, keys: str, limit: int = 5000) -> str:
    order = f"{keys}, name_lower, drive, parent, record"
    return f"{base_sql()} SELECT {HIT_SQL}, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS rk FROM pathed WHERE {condition} ORDER BY rk LIMIT {limit}"


# ------------------------------------------------------------------ other operators

QUERIES: dict[str, Query] = {name: predicate_query(options) for name, (options, _) in PREDICATES.items()}
ORACLE_SQL: dict[str, str] = {name: f"{base_sql()} SELECT drive, record, parent, name FROM pathed WHERE {condition}" for name, (_, condition) in PREDICATES.items()}
QUERIES |= {name: page_query(options) for name, (options, _, _) in PAGES.items()}
ORACLE_SQL |= {name: page_sql(condition, keys, options.get("limit", 5000)) for name, (options, condition, keys) in PAGES.items()}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("total_count", f"{base_sql()} SELECT drive, count(*) AS total FROM entries WHERE contains(name_lower, 'order') OR contains(name_lower, 'doc') GROUP BY ROLLUP (drive)")
def total_count(spark, sf_dir):
    return search.total(catalog(spark, sf_dir), SearchOptions(query="order | doc"))


@query("path_reconstruct", f"{base_sql()} SELECT drive, record, parent, path FROM pathed")
def path_reconstruct(spark, sf_dir):
    rows = source.entries(spark, sf_dir)
    return with_paths(rows, folder_paths(rows)).select("drive", "record", "parent", "path")


@query("orphan_path", f"{base_sql(ORPHANS)} SELECT drive, record, path FROM pathed WHERE drive = 'C'")
def orphan_path(spark, sf_dir):
    rows = source.entries(spark, sf_dir, "C").where(f"NOT ({ORPHANS})")
    return with_paths(rows, folder_paths(rows)).select("drive", "record", "path")


@query("hardlink_paths", f"{base_sql()} SELECT record, path FROM pathed WHERE drive = 'D' AND NOT is_dir")
def hardlink_paths(spark, sf_dir):
    rows = source.entries(spark, sf_dir, "D")
    return with_paths(rows, folder_paths(rows)).where("NOT is_dir").select("record", "path")


@query("links_per_record", f"{base_sql()} SELECT drive, record, count(*) AS links FROM entries GROUP BY drive, record")
def links_per_record(spark, sf_dir):
    return volumes.links_per_record(source.entries(spark, sf_dir))


@query("volume_status", f"{base_sql()} SELECT drive, 'ready' AS state, count(*) AS count, CAST(NULL AS VARCHAR) AS message FROM entries GROUP BY drive")
def volume_status(spark, sf_dir):
    return volumes.status(source.entries(spark, sf_dir))


@query("volume_replace", f"{base_sql()} SELECT drive, record, parent, name FROM entries WHERE drive <> 'D' OR NOT is_dir")
def volume_replace(spark, sf_dir):
    rows = source.entries(spark, sf_dir)
    files = source.entries(spark, sf_dir, "D").where("NOT is_dir")
    return volumes.replace_volume(rows, files, "D").select("drive", "record", "parent", "name")


def content_query(options: dict) -> Query:
    def run(spark, sf_dir):
        found = search.content_matches(catalog(spark, sf_dir), source.bodies(spark, sf_dir), SearchOptions(**options))
        return found.select("drive", "record", "parent", "name")

    return run


BODY = "SELECT 'E' AS drive, 300000000 + doc_id AS record, text FROM documents"
for name, options, condition, entry_condition in (
    ("content_one_term", {"query": "e: content:licensed"}, "contains(lower(text), 'licensed')", "drive = 'E'"),
    ("content_two_terms", {"query": 'ext:txt;log content:"the " content:and'}, "contains(lower(text), 'the ') AND contains(lower(text), 'and')", "(name_lower LIKE '%.txt' OR name_lower LIKE '%.log')"),
    ("content_case", {"query": "doc- content:The", "match_case": True}, "contains(text, 'The')", "contains(name, 'doc-')"),
    ("content_with_name_filter", {"query": "*.md size:>2kb content:token"}, "contains(lower(text), 'token')", "name_lower LIKE '%.md' AND size > 2048"),
):
    QUERIES[name] = content_query(options)
    ORACLE_SQL[name] = f"{base_sql()} SELECT e.drive, e.record, e.parent, e.name FROM entries e JOIN ({BODY}) b USING (drive, record) WHERE NOT is_dir AND {entry_condition} AND {condition}"


@query("content_cap_total", f"{base_sql()} SELECT count(*) AS total FROM entries e JOIN ({BODY}) b USING (drive, record) WHERE contains(lower(text), 'version')")
def content_cap_total(spark, sf_dir):
    found = search.content_matches(catalog(spark, sf_dir), source.bodies(spark, sf_dir), SearchOptions(query="e: content:version"))
    return found.agg(F.count(F.lit(1)).alias("total"))


LETTERS_SQL = " || ".join(f"CASE WHEN attributes & {bit} <> 0 THEN '{letter}' ELSE '' END" for bit, letter in derive.ATTRIBUTE_LETTERS)


@query("attr_letters", f"{base_sql()} SELECT drive, record, parent, {LETTERS_SQL} AS letters FROM entries")
def attr_letters(spark, sf_dir):
    return source.entries(spark, sf_dir).select("drive", "record", "parent", derive.attribute_letters(F.col("attributes")).alias("letters"))


@query(
    "size_human",
    f"""{base_sql()} SELECT drive, record, parent, CASE WHEN is_dir OR size IS NULL THEN '' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024.0, 1))
     WHEN size < 1073741824 THEN printf('%.1f MB', round(size / 1048576.0, 1)) ELSE printf('%.1f GB', round(size / 1073741824.0, 1)) END AS shown FROM entries""",
)
def size_human(spark, sf_dir):
    return source.entries(spark, sf_dir).select("drive", "record", "parent", derive.human_size(F.col("is_dir"), F.col("size")).alias("shown"))


@query("date_local", f"{base_sql()} SELECT drive, record, parent, CASE WHEN coalesce(modified_ms, 0) = 0 THEN '' ELSE strftime(make_timestamp(modified_ms * 1000), '%Y-%m-%d %H:%M:%S') END AS modified FROM entries")
def date_local(spark, sf_dir):
    return source.entries(spark, sf_dir).select("drive", "record", "parent", derive.local_time(F.col("modified_ms"), "UTC").alias("modified"))


@query("ext_display", f"{base_sql()} SELECT drive, record, parent, {EXT_KEY} AS ext FROM entries")
def ext_display(spark, sf_dir):
    return source.entries(spark, sf_dir).select("drive", "record", "parent", derive.sort_extension(F.col("is_dir"), F.col("name_lower")).alias("ext"))


@query("icon_ext", f"{base_sql()} SELECT drive, record, parent, CASE WHEN NOT is_dir AND contains(name_lower, '.') THEN regexp_extract(name_lower, '\\.([^.]*)$', 1) ELSE '' END AS ext FROM entries")
def icon_ext(spark, sf_dir):
    return source.entries(spark, sf_dir).select("drive", "record", "parent", derive.icon_extension(F.col("is_dir"), F.col("name_lower")).alias("ext"))


@query("dir_of", f"{base_sql()} SELECT drive, record, parent, regexp_replace(path, '\\\\[^\\\\]*$', '') AS folder FROM pathed")
def dir_of(spark, sf_dir):
    rows = with_paths(source.entries(spark, sf_dir), catalog(spark, sf_dir).paths())
    return rows.select("drive", "record", "parent", derive.folder_of(F.col("path")).alias("folder"))


@query("filetime_roundtrip", f"{base_sql()} SELECT drive, record, parent, CASE WHEN coalesce(modified_ms, 0) = 0 THEN 0 ELSE (modified_ms + 11644473600000) * 10000 END AS ft, modified_ms AS back FROM entries")
def filetime_roundtrip(spark, sf_dir):
    ft = derive.ms_to_filetime(F.col("modified_ms"))
    return source.entries(spark, sf_dir).select("drive", "record", "parent", ft.alias("ft")).withColumn("back", derive.filetime_to_ms(F.col("ft")))


TYPES = {"txt": "Text Document", "log": "Log File", "md": "Markdown Document", "csv": "CSV File", "low": "Low Priority Order"}


@query(
    "type_label_join",
    f"{base_sql()}, t(ext, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in TYPES.items())}) SELECT drive, record, parent, CASE WHEN is_dir THEN 'File folder' ELSE coalesce(label, upper(x) || ' File') END AS type "
    f"FROM (SELECT *, {EXT_KEY} AS x FROM entries) LEFT JOIN t ON t.ext = x",
)
def type_label_join(spark, sf_dir):
    # A fixed dimension of a few rows.
    types = spark.createDataFrame(list(TYPES.items()), "ext string, label string")
    rows = source.entries(spark, sf_dir).withColumn("ext", derive.sort_extension(F.col("is_dir"), F.col("name_lower"))).join(F.broadcast(types), "ext", "left")
    label = F.when(F.col("is_dir"), "File folder").otherwise(F.coalesce("label", F.concat(F.upper("ext"), F.lit(" File"))))
    return rows.select("drive", "record", "parent", label.alias("type"))


@query("highlight_single", f"{base_sql()} SELECT drive, record, parent, replace(name, 'order', '<mark>order</mark>') AS shown FROM entries WHERE contains(name_lower, 'order-1')")
def highlight_single(spark, sf_dir):
    rows = search.matching(catalog(spark, sf_dir), SearchOptions(query="order-1"))
    return rows.select("drive", "record", "parent", derive.highlight(F.col("name"), ["order"]).alias("shown"))


def export_query(kind: str) -> Query:
    def run(spark, sf_dir):
        found = catalog(spark, sf_dir)
        hits = search.as_hits(with_paths(search.matching(found, SearchOptions(query="order (urg | low)")), found.paths()))
        return export.lines(hits, kind)

    return run


def quote_sql(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '[,"\\n\\r]') THEN '"' || replace({text}, '"', '""') || '"' ELSE {text} END"""


def when_sql(column: str) -> str:
    return f"CASE WHEN {column} = 0 THEN '' ELSE strftime(make_timestamp({column} * 1000), '%Y-%m-%d %H:%M:%S') END"


EXPORTED = f"{base_sql()}, hits AS (SELECT {HIT_SQL} FROM pathed WHERE contains(name_lower, 'order') AND (contains(name_lower, 'urg') OR contains(name_lower, 'low')))"
TICKS = "CASE WHEN {0} = 0 THEN 0 ELSE ({0} + 11644473600000) * 10000 END"
for kind, text in (
    ("txt", "path"),
    ("csv", f"{quote_sql('name')} || ',' || {quote_sql('path')} || ',' || CASE WHEN size >= 0 THEN CAST(size AS VARCHAR) ELSE '' END || ',' || {when_sql('modified')} || ',' || {when_sql('created')} || ',' || {when_sql('accessed')} || ',' || {LETTERS_SQL}"),
    ("efu", f"{quote_sql('path')} || ',' || greatest(size, 0) || ',' || {TICKS.format('modified')} || ',' || {TICKS.format('created')} || ',' || attributes"),
):
    QUERIES[f"export_{kind}_lines"] = export_query(kind)
    ORACLE_SQL[f"export_{kind}_lines"] = f"{EXPORTED} SELECT {text} AS line FROM hits"

JOURNAL_SQL = """WITH j AS (SELECT event_id AS usn, 100000000 + user_id AS record, 1000000 + user_id AS parent, event_type || '-' || json_extract_string(props, '$.k') || '.log' AS name,
  event_type <> 'view' AS is_close, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events)"""
LAST_SQL = f"{JOURNAL_SQL}, l AS (SELECT record, arg_max(parent, usn) AS parent, arg_max(name, usn) AS name, arg_max(op, usn) AS op FROM j WHERE is_close GROUP BY record)"


def no_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"drive string, record long, {cdc.LINK_TYPE}")


@query("cdc_batch_fold", f"{LAST_SQL} SELECT 'C' AS drive, record, parent, name FROM l WHERE op = 'upsert'")
def cdc_batch_fold(spark, sf_dir):
    return cdc.fold(no_entries(spark), source.journal(spark, sf_dir).where("is_close")).select("drive", "record", "parent", "name")


@query("cdc_delete_all_links", f"{LAST_SQL} SELECT 'C' AS drive, record FROM l WHERE op = 'delete'")
def cdc_delete_all_links(spark, sf_dir):
    ops = source.journal(spark, sf_dir).where("is_close")
    return ops.select("drive", "record").distinct().join(cdc.fold(no_entries(spark), ops), ["drive", "record"], "left_anti")


@query("cdc_close_only", f"{JOURNAL_SQL} SELECT record, count(*) AS events, max(usn) AS last_usn FROM j WHERE is_close GROUP BY record")
def cdc_close_only(spark, sf_dir):
    rows = source.journal(spark, sf_dir)
    changes = rows.withColumn("reason", F.when(F.col("is_close"), F.lit(cdc.REASON_CLOSE)).otherwise(F.lit(1)).cast("long")).withColumn("reference", F.col("record") + (F.lit(3).cast("long") * (1 << 48))).drop("record")
    return cdc.operations(changes).groupBy("record").agg(F.count(F.lit(1)).alias("events"), F.max("usn").alias("last_usn"))


@query("cdc_enrich_join", f"{JOURNAL_SQL} SELECT usn, record, CASE WHEN o_orderkey IS NOT NULL THEN CAST(floor(o_totalprice * 100) AS BIGINT) END AS size FROM j LEFT JOIN orders ON record = 100000000 + o_orderkey")
def cdc_enrich_join(spark, sf_dir):
    ops = source.journal(spark, sf_dir).withColumn("seq", F.lit(1).cast("long"))
    live = source.table(spark, sf_dir, "orders").select(
        F.lit("C").alias("drive"), (F.col("o_orderkey") + 100_000_000).alias("record"), F.lit(1).cast("long").alias("seq"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("size"),
        *source.nothing("modified_ms", "created_ms", "accessed_ms"), F.lit(32).cast("long").alias("attributes"),
    )
    return cdc.enriched(ops, live).select("usn", "record", "size")


#: Fixture F3b as SQL: upserts after a record's last deletion; records that still have several links keep them, with the
#: names that events add; the others have the last event's link alone.
MULTI_LINK_SQL = """WITH e AS (SELECT event_id AS usn, 200000000 + user_id % 50 AS record, event_id % 100 + 10000 AS parent, event_type = 'error' AS gone FROM events
   WHERE event_type <> 'view' AND (event_type <> 'error' OR event_id % 40 = 0)),
 o AS (SELECT e.*, p_name || '.' || lower(p_type) AS name FROM e JOIN part ON p_partkey + 200000000 = record),
 g AS (SELECT record, max(usn) AS last FROM o WHERE gone GROUP BY record),
 up AS (SELECT o.* FROM o LEFT JOIN g USING (record) WHERE NOT gone AND (last IS NULL OR usn > last)),
 old AS (SELECT DISTINCT l_partkey + 200000000 AS record, l_suppkey + 10000 AS parent, p_name || '.' || lower(p_type) AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
 kept AS (SELECT * FROM old WHERE record NOT IN (SELECT record FROM g)),
 several AS (SELECT record FROM kept GROUP BY record HAVING count(*) > 1)
 SELECT 'D' AS drive, record, parent, name FROM (SELECT record, parent, name FROM kept WHERE record IN (SELECT record FROM several) UNION SELECT record, parent, name FROM up WHERE record IN (SELECT record FROM several))
 UNION ALL SELECT 'D', record, parent, name FROM kept WHERE record NOT IN (SELECT record FROM several) AND record NOT IN (SELECT record FROM up)
 UNION ALL SELECT 'D', record, arg_max(parent, usn), arg_max(name, usn) FROM up WHERE record NOT IN (SELECT record FROM several) GROUP BY record"""


@query("cdc_multi_link_fold", MULTI_LINK_SQL)
def cdc_multi_link_fold(spark, sf_dir):
    """Changes to records with several links (fixture F3b); the tests also hold it against a replay event by event."""
    user, event = F.col("user_id"), F.col("event_id")
    names = source.table(spark, sf_dir, "part").select((F.col("p_partkey") + 200_000_000).alias("record"), F.concat("p_name", F.lit("."), F.lower("p_type")).alias("part_name"))
    rows = source.table(spark, sf_dir, "events").where("event_type <> 'view' AND (event_type <> 'error' OR event_id % 40 = 0)")
    ops = source.journal_of(rows).drop("record").withColumn("drive", F.lit("D")).join(rows.select(event.alias("usn"), (user % 50 + 200_000_000).alias("record")), "usn")
    ops = ops.withColumn("parent", F.col("usn") % 100 + 10_000).join(names, "record").withColumn("name", F.col("part_name")).drop("part_name")
    return cdc.fold(source.entries(spark, sf_dir, "D").where("NOT is_dir"), ops).select("drive", "record", "parent", "name")


@query("stream_fold_available_now", f"{LAST_SQL} SELECT 'C' AS drive, record, parent, name FROM l WHERE op = 'upsert'")
def stream_fold_available_now(spark, sf_dir):
    """The journal as a stream that ends with what is there; compared with the batch fold in the tests."""
    return streaming.fold_available(spark, sf_dir).select("drive", "record", "parent", "name")


@query("folder_sizes_by_type", f"{base_sql()} SELECT drive, is_dir, count(*) AS n, max(size) AS largest FROM entries GROUP BY drive, is_dir")
def folder_sizes_by_type(spark, sf_dir):
    """Entries and largest size by volume and kind: the summary a status view shows."""
    return source.entries(spark, sf_dir).groupBy("drive", "is_dir").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_query({"query": "order (low | hig) !urg", "limit": 500})(spark, sf_dir)
