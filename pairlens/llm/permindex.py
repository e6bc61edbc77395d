"""Approximate nearest neighbours by a permutation index.

Pivots are different vectors of a bounded sample (8 times as many rows as pivots). Each vector is represented by the order of its ``prefix`` nearest pivots, and posted in the inverted file of each with
the pivot's rank. A query reads the files of its own nearest pivots; ranks met there add up to the footrule distance of the two orders (a pivot
outside a prefix counts as rank ``prefix``). The best ``share`` of a shard by footrule are reranked by exact cosine in double precision, and with
them all whose footrule is nearly that of the last: the cut never falls between rows alike in footrule. If the last is at less than half of the
largest footrule, the cut lies inside a crowd of near copies; then all up to twice its footrule are reranked, at most the whole shard.

The index is dealt into shards by the id's hash (as many as there are cores while they hold ``least_shard`` vectors or more, then of about ``shard_rows``), the queries into blocks of about
``block_rows``; each pair of a shard and a block is one task's group and gives k rows a query, whose best k are the result. What is shuffled is each vector once a block of queries and each query
once a shard. A shard ranks all its vectors for a query: in many dimensions without clusters the nearest are hardly nearer than the rest, and a file of few pivots misses them. Copies of one vector are
one candidate in a shard.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids and vectors of another length than
most (of equally frequent lengths the smallest). Of rows with one id the vector that is smallest in array order counts. Ties go to the smaller
id. With fewer than k other vectors all are returned. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import smallest, stage_table


def clean(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): usable vectors as arrays of double, one for each id."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct_directions(x: np.ndarray, n: int, most_cosine: float = 0.9) -> np.ndarray:
    """The first n rows of a sample that lie apart from those before: near copies of one vector would be one pivot many times."""
    u = unit(x)
    chosen: list[int] = []
    for k in range(len(u)):
        if len(chosen) == n:
            break
        if not chosen or (u[chosen] @ u[k]).max() <= most_cosine:
            chosen.append(k)
    return u[chosen]


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    return np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def reach(cut: int, largest: int) -> float:
    """The footrule up to which to rerank, if the best share ends at cut."""
    return cut + (max(cut, 0.05 * largest) if cut < largest / 2 else 0.02 * largest)


def search_shard(ids: np.ndarray, x: np.ndarray, order: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_order: np.ndarray, k: int, share: float, least: int) -> list[tuple[int, int, float]]:
    """(query, id, cosine): the k best of the shard for each query."""
    by_id = np.argsort(ids, kind="stable")
    ids, x, order = ids[by_id], x[by_id], order[by_id]
    # copies of a vector are one candidate, for which its k + 1 smallest ids stand
    _, one, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
    x, order, group = x[one], order[one], group.ravel()
    members = np.argsort(group, kind="stable")
    start = np.searchsorted(group[members], np.arange(len(one) + 1))
    n, m = order.shape
    # the inverted files: postings of pivot p are rows[first[p]:first[p + 1]] with their ranks
    flat = order.ravel()
    post = np.argsort(flat, kind="stable")
    rows, ranks = (post // m).astype(np.int32), (post % m).astype(np.int32)
    first = np.searchsorted(flat[post], np.arange(flat.max() + 2)) if n else np.zeros(1, np.int64)
    u, w = unit(x), unit(q)
    take = min(n, max(least, int(np.ceil(share * n)), k + 1))
    largest = m * (m + 1) // 2
    out = []
    for i, p in enumerate(q_order):
        gain = np.zeros(n, np.int64)
        for rank, pivot in enumerate(p):
            if pivot + 1 < len(first):
                s = slice(first[pivot], first[pivot + 1])
                gain[rows[s]] += m - np.maximum(ranks[s], rank)
        far = largest - gain  # half of the footrule
        best = np.nonzero(far <= reach(int(np.partition(far, take - 1)[take - 1]), largest))[0] if take < n else np.arange(n)
        cosine = (u[best] * w[i]).sum(1)
        # the best k + 1 distinct vectors hold the best k ids, the query's own left out
        few = np.lexsort((ids[one[best]], -cosine))[: k + 1]
        edge = cosine[few[-1]]
        near = [(-float(cosine[j]), int(v)) for j in np.nonzero(cosine >= edge)[0] for v in ids[members[start[best[j]] : start[best[j] + 1]][: k + 1]] if v != q_ids[i]]
        out += [(int(q_ids[i]), v, -c) for c, v in sorted(near)[:k]]
    return out


def search(table: DataFrame, is_query: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", k: int = 5, pivots: int = 128, prefix: int = 48, share: float = 0.18, least: int = 300, shard_rows: int = 65536, block_rows: int = 65536, least_shard: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each id that is_query is true of, against all rows.

    At least ``least`` vectors of a shard are reranked, however small the share.
    """
    rows = stage_table(clean(table, key, vector), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return table.sparkSession.createDataFrame([], schema)
    rows, d = rows.where(F.size("v") == sizes["d"]), sizes["d"]
    by = F.xxhash64("id", F.lit("pivot"))
    centre = distinct_directions(np.array([r["v"] for r in smallest(rows, 8 * pivots, by, F.col("id")).collect()], float), pivots)
    prefix = min(prefix, len(centre))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), float).reshape(-1, d)
            o = orders(x, centre, prefix) if len(x) else np.zeros((0, prefix), np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in o], pa.binary()), b.column(2)], names=["id", "v", "o", "q"])

    posted = stage_table(rows.select("id", "v", is_query(F.col("id")).alias("q")).mapInArrow(post, "id bigint, v binary, o binary, q boolean"), "postings")
    n_queries = posted.where("q").count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-sizes["n"] // shard_rows), min(cores, -(-sizes["n"] // least_shard)))
    blocks = max(1, -(-n_queries // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = posted.select("id", "v", "o", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asked = posted.where("q").select("id", "v", "o", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.asarray(t["id"]), np.frombuffer(b"".join(t["v"].to_pylist()), float).reshape(-1, d), np.frombuffer(b"".join(t["o"].to_pylist()), np.int16).reshape(-1, prefix)

        found = search_shard(*arrays(left), *arrays(right), k, share, least) if left.num_rows and right.num_rows else []
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

