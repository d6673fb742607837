"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) takes a unit vector to a
place whose nearest signed axis is its hash.  A table's code joins two such hashes.  Several tables, and the
several nearest codes of a query in each (multiprobe), collect candidates, which are ranked by their exact
Euclidean distance.

How many codes a query probes follows from what it finds, never from the number of rows: the same few first, and
where rows as near and as long as the k nearest of these may lie wider than so few probes reach, as many as reach it.
Where no number of probes does, or fewer than k were found, the query is compared with every row.

The index holds every vector with its codes, hashed once, in shards by a hash of the vector; each block of
queries, with its probes, visits each shard, so a task holds one shard and one block whatever the data's size.
Shards and blocks are layout alone, no answer depends on them.  Equal vectors are one entry of the index.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop_table, small_batches, stage_table

#: Hash tables; codes that a query probes in each at first, and at most.
TABLES, PROBES, MOST_PROBES = 40, 16, 1024
#: Probes reach an angle if this share of the rows at it share a code with the query, as so many random pairs at angles
#: whose cosines are so far apart show.
REACHED, PAIRS, COSINE_STEP = 0.9, 256, 0.02
#: Ratios of lengths and distances are held within this and its inverse.
FAR = 1e9
#: Probes for so many evenly spread rows are PROBES and this over the root of the rows (probe_count).
MORE_PROBES = 2900
#: Cells of a table: the second hash of a code uses so many dimensions that there are about this many.
CELLS = 1 << 14
#: Nearest axes of each hash that probes are made of; dimensions up to which rotations are applied as matrices.
AXES, MATRIX_DIMS = 32, 256
#: Vectors of a shard grow slowly with the data between these bounds; queries of a block, and their probes a table.
LEAST_SHARD, MOST_SHARD, QUERY_BLOCK, PROBE_BLOCK = 4096, 131_072, 4096, 1 << 18


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def signs(d: int, number: int) -> np.ndarray:
    return np.random.default_rng([d, number]).choice([-1.0, 1.0], (3, d))


@functools.lru_cache(maxsize=2 * TABLES + 2)
def rotation(d: int, number: int) -> np.ndarray:
    """The pseudo-rotation as a matrix: what it makes of each axis."""
    x = np.eye(d)
    for flip in signs(d, number):
        x = hadamard(x * flip)
    return x


def rotated(unit: np.ndarray, number: int) -> np.ndarray:
    """The pseudo-rotation of that number; rows are filled with zeros to a power of two."""
    d = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.hstack([unit, np.zeros((len(unit), d - unit.shape[1]))])
    if d <= MATRIX_DIMS:
        return x @ rotation(d, number)
    for flip in signs(d, number):
        x = hadamard(x * flip)
    return x


def second_dims(d: int) -> int:
    return max(1, min(d, CELLS // (4 * d)))


def both_signs(unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row along the signed axes (2 * axis, plus 1 for the negative one) of a table's two hashes."""
    first, second = rotated(unit, 2 * table), rotated(unit, 2 * table + 1)
    second = second[:, : second_dims(second.shape[1])]
    return tuple(np.stack([x, -x], axis=2).reshape(len(x), -1) for x in (first, second))


def codes(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Codes of each row (rows) in each table (columns): the nearest signed axes of both hashes."""
    out = np.empty((len(unit), tables), np.int32)
    for t in range(tables):
        first, second = both_signs(unit, t)
        out[:, t] = first.argmax(1) * second.shape[1] + second.argmax(1)
    return out


def probes(unit: np.ndarray, count: int, tables: int = TABLES) -> np.ndarray:
    """The ``count`` nearest codes of each row in each table: those that lose least against the nearest axes."""
    out = []
    for t in range(tables):
        pair = both_signs(unit, t)
        near = [np.argsort(-x, axis=1, kind="stable")[:, :AXES] for x in pair]
        loss = [(x.max(1, keepdims=True) - np.take_along_axis(x, n, 1)) ** 2 for x, n in zip(pair, near)]
        both = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(len(unit), -1)
        code = (near[0][:, :, None] * pair[1].shape[1] + near[1][:, None, :]).reshape(len(unit), -1)
        best = np.argsort(both, axis=1, kind="stable")[:, :count]
        out.append(np.take_along_axis(code, best, 1).astype(np.int32))
    return np.stack(out, axis=1)


@functools.lru_cache(maxsize=64)
def reach(d: int, tables: int = TABLES) -> tuple[int, ...]:
    """Probes a table that reach rows whose cosine with a query is at least COSINE_STEP times the place; 0: none do."""
    rng = np.random.default_rng([d, tables])
    query = units(rng.normal(size=(PAIRS, d)))
    aside = rng.normal(size=(PAIRS, d))
    aside -= (aside * query).sum(1, keepdims=True) * query
    aside = units(aside) if d > 1 else aside * 0
    asked = probes(query, MOST_PROBES, tables)
    cosines = np.arange(0, 1, COSINE_STEP)
    first = np.full((len(cosines), PAIRS), MOST_PROBES + 1)
    for t in range(tables):
        pairs = list(zip(both_signs(query, t), both_signs(aside, t)))
        for i, c in enumerate(cosines):
            # Rotations are linear, so the places of a row between the two are made of theirs.
            near, far = ((c * q + np.sqrt(1 - c * c) * a).argmax(1) for q, a in pairs)
            same = asked[:, t] == (near * pairs[1][0].shape[1] + far)[:, None]
            first[i] = np.minimum(first[i], np.where(same.any(1), same.argmax(1) + 1, MOST_PROBES + 1))
    count = np.sort(first, axis=1)[:, int(np.ceil(REACHED * PAIRS)) - 1]
    count = np.maximum.accumulate(count[::-1])[::-1]
    return tuple(0 if c > MOST_PROBES else int(c) for c in count)


def probe_count(rows: int) -> int:
    """Probes a table that evenly spread vectors need, for callers who give nearest a fixed ``count``."""
    return PROBES + int(MORE_PROBES / max(1, rows) ** 0.5)


def units(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lengths(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, initial=0)
    with np.errstate(over="ignore"):
        return scale * np.linalg.norm(x / scale[:, None], axis=1)


def candidates(asked: np.ndarray | list[np.ndarray], held: np.ndarray) -> list[np.ndarray]:
    """For each query, by its probes (table, probe), the rows whose code it probes in any table; held: (row, table)."""
    out = []
    orders = np.argsort(held, axis=0, kind="stable")
    for i in range(0, len(asked), 64):
        most = max(x.shape[1] for x in asked[i : i + 64])
        some = np.stack([np.pad(x, ((0, 0), (0, most - x.shape[1])), constant_values=-1) for x in asked[i : i + 64]])
        mark = np.zeros((len(some), len(held)), bool)
        for t in range(held.shape[1]):
            order = orders[:, t]
            code = held[order, t]
            begin, end = (np.searchsorted(code, some[:, t].ravel(), side) for side in ("left", "right"))
            size = end - begin
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            mark[np.repeat(np.repeat(np.arange(len(some)), some.shape[2]), size), order[at]] = True
        out += [np.flatnonzero(m) for m in mark]
    return out


def search_shard(queries: np.ndarray, asked: list[np.ndarray], vectors: np.ndarray, held: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the nearest candidates (rows of vectors) and their distances.

    All candidates as near as the k-th are listed.  A query without probes is compared with the whole shard.
    """
    out = []
    for query, own, rows in zip(queries, asked, candidates(asked, held)):
        if not own.size:
            rows = np.arange(len(vectors))
        distance = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
        near = distance <= np.partition(distance, k - 1)[k - 1] if len(rows) > k else slice(None)
        out.append((rows[near], distance[near]))
    return out


def hashed(rows: DataFrame, make, name: str) -> DataFrame:
    """The rows with make(unit vectors, n) of their ``vector`` and ``n`` as the bytes of column ``name``; lengths may differ."""
    small_batches(rows.sparkSession)
    at, n_at = rows.columns.index("vector"), rows.columns.index("n")

    def run(batches):
        for batch in batches:
            column, ns = batch.column(at), batch.column(n_at).to_numpy(zero_copy_only=False)
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            starts, out = np.cumsum(sizes) - sizes, [b""] * len(sizes)
            for d, n in set(zip(sizes.tolist(), ns.tolist())):
                some = np.flatnonzero((sizes == d) & (ns == n))
                made = make(units(flat[starts[some][:, None] + np.arange(d)]), n)
                for i, x in zip(some.tolist(), made):
                    out[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, {name} binary")


def usable(vector: Column) -> Column:
    """No null or empty vector, no null or non-finite component, not all zeros."""
    value = lambda x: x.cast("double")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: value(x) != 0), F.lit(False))


def visited(asked: DataFrame, index: DataFrame, entries: int, k: int, tables: int) -> DataFrame:
    """query_id, id, score and rank of the k nearest that the asked (id, vector, n) find by n probes a table; 0: all rows.

    ``length`` and ``away`` are a found row's length and its distance in lengths of the query.
    """
    total = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-total[0] // QUERY_BLOCK), -(-total[1] // PROBE_BLOCK))
    shards = max(1, -(-entries // min(MOST_SHARD, max(LEAST_SHARD, entries // 64))))
    dims = F.size("vector").alias("dim")
    index = index.select("vector", "ids", "codes", dims, F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = hashed(asked, lambda unit, n: probes(unit, n, tables), "probes")
    asked = asked.select("id", "vector", "probes", dims, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def visit(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found_rows = []
        if len(queries) and len(shard):
            queries = queries.iloc[np.argsort(queries["probes"].map(len).to_numpy(), kind="stable")]
            asks, vectors = np.stack(queries["vector"].to_numpy()), np.stack(shard["vector"].to_numpy())
            probed = [np.frombuffer(p, np.int32).reshape(tables, -1) for p in queries["probes"]]
            held = np.frombuffer(b"".join(shard["codes"]), np.int32).reshape(-1, tables)
            ids = shard["ids"].to_numpy()
            for query, own, (at, distance) in zip(queries["id"].tolist(), lengths(asks), search_shard(asks, probed, vectors, held, k + 1)):
                with np.errstate(all="ignore"):
                    ratios = np.nan_to_num(np.stack([lengths(vectors[at]), distance]) / own, nan=FAR, posinf=FAR).clip(1 / FAR, FAR).tolist()
                near = sorted((d, i, *x) for r, d, *x in zip(at.tolist(), distance.tolist(), *ratios) for i in ids[r].tolist() if i != query)
                found_rows += [(query, *x) for x in near[:k]]
        return pd.DataFrame(found_rows, columns=["query_id", "score", "id", "length", "away"]).astype({"query_id": "int64", "score": "float64", "id": "int64", "length": "float64", "away": "float64"})

    keys = ["dim", "block", "shard"]
    found = asked.groupBy(keys).cogroup(index.groupBy(keys)).applyInPandas(visit, "query_id long, score double, id long, length double, away double")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, count: int | None = None) -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, id_col, score (Euclidean distance).

    Every usable row but the query's own is a candidate; vectors of another length are never near.  Ties go to
    the smaller id.  Rows with a null id are left out; a row that is repeated (same id, same vector) counts
    once.  Of equal vectors the index keeps the k + 1 smallest ids, which are all that any answer can hold.
    ``count`` probes a table are made (None: PROBES, then as many as reach the widest angle that rows as near
    and as long as the k nearest of these may have).  Queries that find fewer than k, or whose angle no probes reach, are compared with every row.  An
    empty table gives no rows; other columns, whatever they are called, are not read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    copies = Window.partitionBy("vector").orderBy("id")
    index = rows.select("id", "vector").withColumn("nth", F.dense_rank().over(copies)).where(F.col("nth") <= k + 1).dropDuplicates(["vector", "id"])
    index = index.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("n", F.lit(0))
    index = stage_table(hashed(index, lambda unit, n: codes(unit, tables), "codes").drop("n"), "index")
    entries = index.count()
    asked = rows.where(F.coalesce(F.col("asks"), F.lit(False))).select("id", "vector").dropDuplicates(["id", "vector"])
    asked = stage_table(asked.withColumn("n", F.lit(PROBES if count is None else count)), "asked")
    first = stage_table(visited(asked, index, entries, k, tables), "found")

    last = round(1 / COSINE_STEP) - 1
    # A row no farther than the k-th found, and as long as any of the k, has at least this cosine with the query.
    farthest = F.max("away").over(Window.partitionBy("query_id"))
    cosine = (1 + F.col("length") * F.col("length") - farthest * farthest) / (2 * F.col("length"))
    widest = F.min("cosine")
    step = F.lit(0) if count is not None else F.when(widest >= 0, F.least(F.floor(F.least(widest, F.lit(1.0)) / COSINE_STEP), F.lit(last)).cast("int"))
    full = first.withColumn("cosine", cosine).groupBy(F.col("query_id").alias("id")).agg(step.alias("step"), F.count("*").alias("found")).where(F.col("found") >= k)
    dims = [r.dim for r in asked.select(F.size("vector").alias("dim")).distinct().collect()]
    needs = [(d, *x) for d in dims for x in enumerate(reach(d, tables) if count is None else [count])]
    needs = spark.createDataFrame(needs, "dim int, step int, needed int")
    again = asked.withColumn("dim", F.size("vector")).join(full, "id", "left").join(F.broadcast(needs), ["dim", "step"], "left")
    again = again.select("id", "vector", F.when(F.col("needed") > 0, F.greatest("needed", "n")).otherwise(0).alias("n"), (F.col("needed") <= F.col("n")).alias("enough"))
    # An id that is repeated with other vectors is asked again with all of them.
    again = again.withColumn("enough", F.min(F.coalesce(F.col("enough") & (F.col("n") > 0), F.lit(False))).over(Window.partitionBy("id")))
    again = stage_table(again.where("not enough").drop("enough"), "again")
    found = first
    if not again.isEmpty():
        settled = first.join(again.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
        found = settled.unionByName(visited(again, index, entries, k, tables))
    found = stage_table(found.select("query_id", "rank", F.col("id").alias(id_col), "score"), "nearest")
    for done in (index, asked, first, again):
        drop_table(done)
    return found
