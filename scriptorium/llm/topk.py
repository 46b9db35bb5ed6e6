"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers, floor(1024 * x). Pivots are a bounded sample of vectors; data and queries belong to the cell of
their nearest pivot. Each cell is summarised by its count, its largest distance to the pivot and how its rows' scores with
respect to the pivot can lie: for x in the cell of p, q.x is within |q| r of q.p. Cells sorted by their lower bounds give a
score that at least k candidates reach; a cell whose upper bound is below it cannot matter and the query is not sent there.
A cell's rows are dealt into blocks of bounded size, as are the queries of a cell, so a hot cell is many tasks; each block
solves its queries by one matrix product and sends on its k best, and those are merged per query.

The number of pivots grows with the square root of the rows, and blocks with the rows and queries, up to BLOCK of each, so
that what is written again for each block a query or row meets grows as slowly as memory allows.

Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part. Vectors of
different lengths are never compared. Equal ids are one query, by the shortest and then least of their vectors, and no row
with the query's own id is a candidate. Ties go to the smaller vec_id. Fewer candidates than k are all returned; an empty
table gives an empty result. Integer components and scores beyond 64 bits are held at the ends of that range. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read_table

LEAST_PIVOTS, MOST_PIVOTS = 32, 2048
LEAST_BLOCK, BLOCK = 4096, 32768
CHUNK = 128
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim) of vectors (vec_id, embedding) that take part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    out = out.withColumn("fine", F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))).where("fine")
    return out.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("x").alias("dim"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T over integers, exactly: in doubles or 64 bits where they hold every partial sum, else in Python's integers, held at
    the ends of 64 bits."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), BOTTOM, TOP).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten()).reshape(len(column), -1)


def with_cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, v, dim, cell, far): the nearest pivot of the same length, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in set(table["dim"].to_pylist()):
                own = table.filter(pa.compute.equal(table["dim"], dim))
                v = _matrix(own["v"]).astype(float)
                p = pivots[dim].astype(float)
                best = np.argmax(v @ p.T - 0.5 * (p * p).sum(1), axis=1)
                far = np.linalg.norm(v - p[best], axis=1)
                out = own.append_column("cell", pa.array(best.astype(np.int32))).append_column("far", pa.array(far))
                yield from out.to_batches()

    return vectors.mapInArrow(run, "vec_id long, v array<long>, dim int, cell int, far double")


def top_k(vectors: DataFrame, is_query: str, k: int = 10, n_pivots: int | None = None, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of vectors (vec_id, embedding) that the SQL condition marks."""
    data = cut(integer_vectors(vectors), "vectors")
    # pivots: n_pivots rows a length at most, the first by a hash of the id
    sizes = data.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.expr(is_query).cast("long")).alias("queries")).collect()
    n, n_queries = sum(r.n for r in sizes), sum(r.queries or 0 for r in sizes)
    n_pivots = n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n**0.5) // 8))
    block = block or min(BLOCK, max(LEAST_BLOCK, n // 64))
    query_block = query_block or min(BLOCK, max(LEAST_BLOCK // 2, n_queries // 16))
    pivots = {}
    for dim in sorted(r.dim for r in sizes):
        rows = data.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(n_pivots).select("v").collect()
        pivots[dim] = np.unique(np.array([r.v for r in rows], np.int64), axis=0)
    placed = cut(with_cells(data, pivots), "cells")
    # one row for each cell
    cells = {}
    for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.sum(F.expr(is_query).cast("long")).alias("queries")).collect():
        cells.setdefault(r.dim, []).append((r.cell, r.n, r.far, r.queries or 0))
    blocks = {(d, c): -(-n // block) for d, x in cells.items() for c, n, _, _ in x}
    # query groups of about query_block: several small cells next to one another, or a part of a large one
    groups, used, room = {}, 0, 0
    for d, x in sorted(cells.items()):
        room = 0
        for c, _, _, q in sorted(x):
            n = max(1, -(-q // query_block))
            if n > 1 or q > room:
                used, room = used + n, query_block if n == 1 else 0
            groups[d, c] = (used - n, n)
            room -= min(q, room)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to the blocks of the cells that its bounds don't rule out."""
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in set(table["dim"].to_pylist()):
                own = table.filter(pa.compute.equal(table["dim"], dim))
                q = _matrix(own["v"])
                names, counts, far = (np.array(x) for x in zip(*((c, n, f) for c, n, f, _ in cells[dim]), strict=True))
                near = q.astype(float) @ pivots[dim][names].astype(float).T
                length, weight = np.linalg.norm(q.astype(float), axis=1, keepdims=True), np.linalg.norm(pivots[dim][names].astype(float), axis=1)
                reach = length * far * (1 + 1e-9) + length * weight * (dim * 1e-15) + 1
                low, high = np.clip(near - reach, BOTTOM, TOP), np.clip(near + reach, BOTTOM, TOP)
                order = np.argsort(-low, axis=1)
                enough = np.cumsum(counts[order], axis=1) >= k + np.array(own["twins"])[:, None]  # the rows with the query's own id don't count
                at = np.where(enough.any(1), enough.argmax(1), low.shape[1] - 1)
                floor = np.where(enough.any(1), low[np.arange(len(q)), order[np.arange(len(q)), at]], -np.inf)
                need = high >= floor[:, None]
                rows, cols = np.nonzero(need)
                times = np.array([blocks[dim, int(c)] for c in names])[cols]
                rows, cell = np.repeat(rows, times), np.repeat(names[cols], times)
                first = np.repeat(np.cumsum(times) - times, times)
                part = np.arange(len(rows)) - first
                for i in range(0, len(rows), 8192):
                    s = slice(i, i + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [own["vec_id"].combine_chunks().take(pa.array(rows[s])), own["v"].combine_chunks().take(pa.array(rows[s])), pa.array(np.full(len(rows[s]), dim, np.int32)), pa.array(cell[s].astype(np.int32)), pa.array(part[s].astype(np.int32)), own["group"].combine_chunks().take(pa.array(rows[s]))],
                        ["query_id", "q", "dim", "cell", "part", "group"],
                    )

    queries = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "cell")).alias("q"), F.count("*").alias("twins")).select("vec_id", "q.*", "twins")

    @F.pandas_udf("int")
    def group_of(dim: pd.Series, cell: pd.Series, spread: pd.Series) -> pd.Series:
        first, n = np.array([groups[x] for x in zip(dim, cell, strict=True)]).reshape(-1, 2).T
        return pd.Series((first + spread.to_numpy() % n).astype(np.int32))

    @F.pandas_udf("int")
    def part_of(dim: pd.Series, cell: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series((spread.to_numpy() % np.array([blocks[x] for x in zip(dim, cell, strict=True)])).astype(np.int32))

    queries = queries.withColumn("group", group_of("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))))
    sent = cut(queries.select("vec_id", "v", "dim", "group", "twins").mapInArrow(send, "query_id long, q array<long>, dim int, cell int, part int, group int"), "queries")
    dealt = placed.select("vec_id", "v", "dim", "cell", part_of("dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))).alias("part"))
    # a block of rows goes to each group of queries that needs it
    pairs = sent.select(*[F.col(c).alias(f"to_{c}") for c in ("dim", "cell", "part", "group")]).distinct()
    rows = dealt.join(pairs, F.expr("dim = to_dim and cell = to_cell and part = to_part")).select("vec_id", "v", "to_dim", "to_cell", "to_part", "to_group")
    rows = rows.groupBy("to_dim", "to_cell", "to_part", "to_group")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, found = right["vec_id"].to_numpy(), []
        if len(left) and len(right):
            v = np.stack(right["v"].to_numpy())
            for i in range(0, len(left), CHUNK):
                own = left.iloc[i : i + CHUNK]
                scores = products(np.stack(own["q"].to_numpy()), v)
                for query, row in zip(own["query_id"].to_numpy(), scores, strict=True):
                    other = np.flatnonzero(ids != query)
                    if len(other) > k:  # all that reach the k-th best, as ties go to the smaller id
                        floor = np.partition(row[other], len(other) - k)[len(other) - k]
                        other = other[row[other] >= floor]
                    best = other[np.lexsort((ids[other], -row[other]))][:k]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": row[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    near = sent.groupBy("dim", "cell", "part", "group").cogroup(rows).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q, v x where q.vec_id % 100 = 0 and x.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""
