"""Exact top-k inner products by block-at-a-time pruning.

Rows are put in an order that keeps similar vectors together and cut into document-range blocks.
A block keeps, per term (dimension), its largest and smallest value: the sum of a query's best
terms bounds every score in the block. Per query, blocks are visited by falling bound and scored
through their forward index, until the next bound falls below the k-th best score so far.

Queries come in batches and blocks in shards; every batch meets every shard in one task, whose
memory is one batch and one shard. Batches first meet one shard each, whose k-th scores then
let all other tasks skip blocks from the start.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK_ROWS = 64
SHARD_ROWS = 8192
BATCH_QUERIES = 4096
_EXACT = 2.0 ** 53

INT_DDL = "vec_id long, v array<long>"


def quantised(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v): floor(factor * x) of every component as a double. Rows with a NULL id, a NULL
    vector, or a NULL or non-finite component are left out; repeated rows count once."""
    x = F.col("embedding")
    whole = F.transform(x, lambda e: F.floor(F.lit(factor) * e.cast("double")))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select("vec_id", whole.alias("v")).distinct()


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def block_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 floor: np.ndarray | None = None, block_rows: int = BLOCK_ROWS):
    """(query number, row number, score) of each query's best k rows among ``rows``, its own id
    left out, and of no row below the query's ``floor``; ties go to the smaller id.

    Scores are exact integers: products go through doubles only where no sum can pass 2^53.
    """
    if not len(rows) or not len(queries):
        return (np.zeros(0, np.int64),) * 3
    limit = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    kind = np.float64 if limit < _EXACT else object if limit >= 2.0 ** 62 else np.int64
    blocks = [slice(a, min(a + block_rows, len(rows))) for a in range(0, len(rows), block_rows)]
    r, q = rows.astype(kind), queries.astype(kind)
    top = np.array([r[b].max(axis=0) for b in blocks]).reshape(len(blocks), -1)
    low = np.array([r[b].min(axis=0) for b in blocks]).reshape(len(blocks), -1)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    bound = plus @ top.T + minus @ low.T  # summed term maxima of every block, per query
    visit = np.argsort(-bound, axis=1, kind="stable")
    # the k best so far; NONE below every score, so that it never passes for one
    none = -(1 << 62)
    best = np.full((len(q), k), none, object if kind is object else np.int64)
    best_row = np.full((len(q), k), -1)
    kth = np.full(len(q), none, best.dtype) if floor is None else np.maximum(floor, none)
    alive = np.arange(len(q))
    for step in range(len(blocks)):
        b = visit[alive, step]
        alive = alive[bound[alive, b] >= kth[alive]]
        if not len(alive):
            break
        b = visit[alive, step]
        order = np.argsort(b, kind="stable")
        edges = np.flatnonzero(np.append(True, b[order][1:] != b[order][:-1]))
        for lo, hi in zip(edges, np.append(edges[1:], len(order)), strict=True):
            who, at = alive[order[lo:hi]], blocks[b[order[lo]]]
            score = q[who] @ r[at].T
            score = score if kind is object else np.rint(score).astype(np.int64)
            number = np.broadcast_to(np.arange(at.start, at.stop), score.shape)
            score = np.where(ids[at][None, :] == query_ids[who][:, None], none, score)
            score = np.concatenate([best[who], score], axis=1)
            number = np.concatenate([best_row[who], number], axis=1)
            tie = np.where(number >= 0, ids[number], np.iinfo(np.int64).max)
            pick = np.lexsort((tie, -score), axis=1)[:, :k]
            best[who] = np.take_along_axis(score, pick, 1)
            best_row[who] = np.take_along_axis(number, pick, 1)
            kth[who] = np.maximum(kth[who], best[who][:, -1])
    keep = (best_row >= 0) & (best > none) & (best >= (none if floor is None else floor[:, None]))
    who, slot = np.nonzero(keep)
    return who, best_row[who, slot], best[who, slot]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS,
          batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over
    ``vectors`` (both tables from ``quantised``), ties to the smaller id; all, if fewer.

    A query never meets rows of its own id; vectors of another length have no score with it. Two
    different vectors under one id are two rows. Scores must fit a long. An empty table of
    either kind gives an empty result.
    """
    # similar vectors side by side: the signs of the components, then the ids
    signs = F.xxhash64(F.transform(F.slice("v", 1, 8), lambda e: e > 0))
    sized = vectors.withColumn("dim", F.size("v")).withColumn("sign", signs)
    rows = materialise(sized, "vectors")
    asked = queries.withColumn("dim", F.size("v"))
    n_rows, n_asked = rows.count(), asked.count()
    n_shards, n_batches = max(1, -(-n_rows // shard_rows)), max(1, -(-n_asked // batch_queries))
    # a shard holds the vectors of some sign patterns; a pattern with many rows is cut by id
    order = rows.repartitionByRange(n_shards, "dim", "sign", F.xxhash64("vec_id"))
    placed = materialise(order.withColumn("shard", F.spark_partition_id()), "shards").drop("sign")
    batches = materialise(asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(n_batches)).cast("int")), "queries")
    ddl = "query_id long, vec_id long, score long, batch int"

    def cell(key, table, floors):
        out = []
        shard_table = table.filter(pa.compute.is_null(table.column("batch")))
        query_table = table.filter(pa.compute.is_valid(table.column("batch")))
        for dim in sorted(set(query_table.column("dim").to_pylist())):
            t = shard_table.filter(pa.compute.equal(shard_table.column("dim"), dim))
            s = query_table.filter(pa.compute.equal(query_table.column("dim"), dim))
            if not len(t) or not dim:
                continue
            rows_, ids = _matrix(t.column("v")), t.column("vec_id").to_numpy()
            lead = np.lexsort((ids, *[rows_[:, j] > 0 for j in range(min(8, dim))]))
            q, qid = _matrix(s.column("v")), s.column("vec_id").to_numpy()
            floor = s.column("floor").to_numpy(zero_copy_only=False) if floors else None
            who, at, score = block_search(ids[lead], rows_[lead], qid, q, k, floor)
            if len(who):
                out.append(pa.table({"query_id": qid[who], "vec_id": ids[lead][at], "score": pa.array(score.tolist(), pa.int64()),
                                     "batch": pa.array([key[0].as_py()] * len(who), pa.int32())}))
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.int64()), "batch": pa.array([], pa.int32())})
        return pa.concat_tables(out) if out else empty

    def met(pairs: DataFrame, asking: DataFrame, floors: bool) -> DataFrame:
        """Every (batch, shard) of ``pairs`` in a task of its own."""
        left = placed.join(pairs, "shard").select(
            F.col("batch_no"), "shard", "vec_id", "v", "dim", F.lit(None).cast("int").alias("batch"), F.lit(None).cast("long").alias("floor"))
        right = asking.join(pairs, asking["batch"] == pairs["batch_no"]).select(
            "batch_no", "shard", "vec_id", "v", "dim", "batch", "floor" if floors else F.lit(None).cast("long").alias("floor"))
        return left.unionByName(right).groupBy("batch_no", "shard").applyInArrow(
            (lambda key, table: cell(key, table, True)) if floors else (lambda key, table: cell(key, table, False)), ddl)

    spark = rows.sparkSession
    grid = spark.range(n_batches).select(F.col("id").cast("int").alias("batch_no")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    first = F.col("shard") == F.col("batch_no") % n_shards
    # a query's k-th score in any one shard is a lower bound of its k-th score overall
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    seeds = met(grid.where(first), batches, False)
    floors = (seeds.withColumn("place", F.row_number().over(rank)).where(F.col("place") == k)
              .groupBy("query_id").agg(F.min("score").alias("floor")))
    none = F.lit(-(1 << 62)).cast("long")
    asking = batches.join(floors, batches["vec_id"] == floors["query_id"], "left").select(
        batches["*"], F.coalesce("floor", none).alias("floor"))
    return (met(grid, asking, True).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
