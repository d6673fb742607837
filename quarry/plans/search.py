"""Searches as DataFrame plans: filter, count, top rows, and paths only where they are needed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import derive
from quarry.operators import content
from quarry.operators.catalog import slots_of_page
from quarry.operators.paths import folder_paths, with_paths
from quarry.plans import compile as compiler
from quarry.plans import query as language
from quarry.plans.query import QueryError, SearchOptions
from quarry.schema import HIT_COLUMNS, SERVICE_LIMIT


@dataclass
class SearchResult:
    """hits (a page), total (all matches, before the limit), an error text, and whether candidates were cut."""

    hits: DataFrame | None
    total: int
    error: str | None = None
    capped: bool = False


@dataclass
class Catalog:
    """All volumes: entries partitioned by drive, and their folder paths (made once, reused by searches).

    ``slots`` is what catalog.store tells of entries in stored order: the first screen then reads a few of them.
    """

    entries: DataFrame
    folders: DataFrame | None = None
    slots: list[tuple[int, int]] | None = None

    def paths(self) -> DataFrame:
        if self.folders is None:
            self.folders = folder_paths(self.entries)
        return self.folders


def sort_column(sort: str) -> Column:
    dirs, name = F.col("is_dir"), F.col("name_lower")
    if sort in ("modified", "created", "accessed"):
        return derive.known_time(F.col(f"{sort}_ms"))
    return {"name": name, "path": F.lower("path"), "size": derive.size_key(dirs, F.col("size")), "ext": derive.sort_extension(dirs, name), "attributes": F.col("attributes")}[sort]


def order(options: SearchOptions) -> list[Column]:
    """Folders first (whatever the direction), the key, and tie-breakers that make every order total."""
    key = sort_column(options.sort)
    first = [F.col("is_dir").desc()] if options.folders_first else []
    return [*first, key.desc() if options.descending else key.asc(), F.col("name_lower").asc(), F.col("drive").asc(), F.col("parent").asc(), F.col("record").asc()]


def matching(catalog: Catalog, options: SearchOptions) -> DataFrame:
    """All matching entries.  Paths are joined only for queries (or sorts) that read them; drives are pruned."""
    tree = language.parse(options)
    rows = catalog.entries
    on = compiler.drives(tree)
    if on is not None:
        rows = rows.where(F.col("drive").isin(*sorted(on))) if on else rows.where(F.lit(False))
    if language.needs_path(tree) or options.sort == "path":
        rows = with_paths(rows, catalog.paths()).withColumn("path_lower", F.lower("path"))
    return rows if tree is None else rows.where(compiler.column(tree))


def as_hits(rows: DataFrame) -> DataFrame:
    """The output row: unknown sizes are -1, unknown times 0."""
    times = [derive.known_time(F.col(f"{t}_ms")).alias(t) for t in ("modified", "created", "accessed")]
    size = derive.size_key(F.col("is_dir"), F.col("size")).alias("size")
    return rows.select("drive", "record", "parent", "name", "path", size, *times, "attributes", "is_dir")


def page(catalog: Catalog, options: SearchOptions) -> DataFrame:
    """The first ``limit`` hits in order, as a distributed top-k; paths are made for those rows alone."""
    rows, limit = matching(catalog, options), min(options.limit, SERVICE_LIMIT)
    if catalog.slots is not None and options.sort == "name" and not options.folders_first and language.parse(options) is None:
        rows = rows.where(F.col("slot").isin(slots_of_page(catalog.slots, limit, options.descending)))
    rows = rows.orderBy(*order(options)).limit(limit)
    if "path" in rows.columns:
        return as_hits(rows)
    return as_hits(with_paths(rows, catalog.paths()).orderBy(*order(options)))


def total(catalog: Catalog, options: SearchOptions) -> DataFrame:
    """Counts of matches by drive and in all (drive null)."""
    return matching(catalog, options).rollup("drive").agg(F.count(F.lit(1)).alias("total"))


def candidates(catalog: Catalog, options: SearchOptions) -> tuple[SearchOptions, list[str]]:
    rest, terms = language.extract_content(options.query)
    language.check_content_scope(options.query, terms)
    return replace(options, query=rest), terms


def content_matches(catalog: Catalog, bodies: DataFrame, options: SearchOptions) -> DataFrame:
    """Entries whose metadata match and whose body holds every content term.

    ``options.content_candidates`` (the desktop program's limit is CONTENT_CANDIDATES) restricts the search to
    the first candidates in the wanted order; without it every candidate is searched.
    """
    narrowed, terms = candidates(catalog, options)
    if not terms:
        return matching(catalog, narrowed)
    rows = matching(catalog, narrowed)
    if options.content_candidates is not None:
        rows = rows.orderBy(*order(options)).limit(options.content_candidates)
    return content.containing(rows, bodies, terms, options.match_case)


def search(catalog: Catalog, options: SearchOptions, bodies: DataFrame | None = None) -> SearchResult:
    """A page of hits with the full count; a bad query is an error text, not an exception."""
    try:
        narrowed, terms = candidates(catalog, options)
        if terms and bodies is not None:
            found = content_matches(catalog, bodies, options)
            ordered = found.orderBy(*order(options)).limit(options.limit)
            hits = as_hits(ordered if "path" in ordered.columns else with_paths(ordered, catalog.paths()).orderBy(*order(options)))
            most = options.content_candidates
            return SearchResult(hits, found.count(), None, most is not None and matching(catalog, narrowed).count() > most)
        plain = narrowed if terms else options
        return SearchResult(page(catalog, plain), matching(catalog, plain).count())
    except QueryError as e:
        return SearchResult(None, 0, str(e))


def ranked(hits: DataFrame, options: SearchOptions) -> DataFrame:
    """A page with its row numbers ``rk``; the page is bounded by its limit, so one task may number it."""
    from pyspark.sql import Window

    columns = hits.withColumn("name_lower", F.lower("name"))
    for t in ("modified", "created", "accessed"):
        columns = columns.withColumn(f"{t}_ms", F.col(t))
    return columns.withColumn("rk", F.row_number().over(Window.orderBy(*order(options)))).select(*HIT_COLUMNS, "rk")
