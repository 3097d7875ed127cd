"""Exact top-k inner products by segment statistics, coarse to fine.

A vector is cut in equal segments; each keeps its mean and its standard deviation. For one segment of n
components, sum(q * x) <= n * (mean_q * mean_x + dev_q * dev_x) (Cauchy's inequality on the
centred parts), so the sum over segments bounds the product from above, and the distance
|q - x|^2 = |q|^2 + |x|^2 - 2 q.x from below. Bounds of a block are one matrix product a level. A level with more segments
looks at the pairs the coarser one left; exact integer products are computed for what survives the last: for the surviving pairs alone if
they are few, else for the box of their rows and columns. The threshold of a
query is its k-th best exact score so far, from a small first chunk on; a candidate is only dropped if its bound is strictly under it.

Candidates are dealt in blocks, queries too (a stated query set against all rows); a task takes one block of
queries and one stripe of candidates, so its memory is bounded, and keeps k rows for each query and stripe.

Scores are exact: components are integers, products are summed in int64 (components beyond 2**31 could overflow it). Ties go to the
smaller id. Null vectors, vectors with null or non-finite components and null ids take no part. Vectors meet those of
their own length. Repeated candidate rows are rows; queries with one id and one vector are one query, those with one id and
different vectors are queries of their own, and rows with a query's id are never its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytide.workspace import materialise

LEVELS = (2, 8, 32)
QUERY_BLOCK, STRIPE, SMALL_STRIPE = 4096, 65_536, 256
FIRST_CHUNK, ROWS, PAIRS = 256, 256, 1 << 16
GATHER = 1 / 32  # below this share of a box, products are computed for the surviving pairs alone; one of those costs as much as some 36 of a box
LOWEST = np.iinfo(np.int64).min


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """(mean, deviation) of each segment, scaled so that a product of two rows is the bound."""
    n, d = v.shape
    size = -(-d // segments)
    pad = np.zeros((n, size * segments))
    pad[:, :d] = v  # zeros add nothing to a product
    s = pad.reshape(n, segments, size)
    return np.concatenate([s.mean(axis=2), s.std(axis=2)], axis=1) * np.sqrt(size)


def block_topk(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels=LEVELS, chunk: int = 4096, seen: dict | None = None):
    """The k best (score, id) of each query over the candidates: two int64 arrays (queries, k) and how many are real."""
    nq = len(q_ids)
    best = np.full((nq, k), LOWEST)
    ids = np.full((nq, k), np.iinfo(np.int64).max)
    count = np.zeros(nq, dtype=np.int64)
    levels = [s for s in levels if s < q.shape[1]]
    stats_q = [statistics(q.astype(np.float64), s) for s in levels]
    size_q = np.abs(q).astype(np.float64).sum(axis=1)
    # candidates with the largest norms first: their scores raise the thresholds early, and so does a small first chunk
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    a, step = 0, min(chunk, FIRST_CHUNK)
    while a < len(c_ids):
        part = order[a : a + step]
        a, step = a + step, min(chunk, 2 * step)
        cv, ci = c[part], c_ids[part]
        slack = 1e-9 * (1 + size_q[:, None] * np.abs(cv).max() * 1.0)  # rounding of the bounds
        floor = np.where(count >= k, best[:, -1], LOWEST)
        alive = np.ones((nq, len(part)), dtype=bool)
        for s, sq in zip(levels, stats_q, strict=True):
            rows, cols = np.nonzero(alive.any(axis=1))[0], np.nonzero(alive.any(axis=0))[0]
            if not len(rows):
                break
            bound = sq[rows] @ statistics(cv[cols].astype(np.float64), s).T
            alive[np.ix_(rows, cols)] &= bound + slack[rows] >= floor[rows, None].astype(np.float64)
            if seen is not None:
                seen[s] = seen.get(s, 0) + int(alive.sum())
        for i in range(0, nq, ROWS):
            live = alive[i : i + ROWS]
            rows, cols = np.nonzero(live.any(axis=1))[0], np.nonzero(live.any(axis=0))[0]
            pairs = int(live.sum())
            if not pairs:
                continue
            if pairs < GATHER * len(rows) * len(cols):
                r, j = np.nonzero(live)
                r += i
                dot = np.concatenate([_row_products(q[r[x : x + PAIRS]], cv[j[x : x + PAIRS]]) for x in range(0, pairs, PAIRS)])
                took = pairs
            else:
                r, j, dot = _likely(_products(q[rows + i], cv[cols]), live[np.ix_(rows, cols)] & (ci[cols] != q_ids[rows + i, None]), floor[rows + i], k)
                r, j = rows[r] + i, cols[j]
                took = len(rows) * len(cols)
            if seen is not None:
                seen["exact"] = seen.get("exact", 0) + took
            ok = (ci[j] != q_ids[r]) & (dot >= floor[r])
            _take(best, ids, count, r[ok], dot[ok], ci[j[ok]], k)
    return best, ids, count


def _likely(dot: np.ndarray, live: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the live pairs of a box that may be among their row's k best, ties with the k-th too."""
    live &= dot >= floor[:, None]
    if dot.shape[1] > k and live.sum() > 4 * k * len(dot):
        live &= dot >= np.partition(np.where(live, dot, LOWEST), dot.shape[1] - k, axis=1)[:, dot.shape[1] - k, None]
    r, j = np.nonzero(live)
    return r, j, dot[r, j]


def _take(best: np.ndarray, ids: np.ndarray, count: np.ndarray, r: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> None:
    """Merges scored pairs, in any order, into the k best of their rows: larger scores first, then smaller ids."""
    touched = np.unique(r)
    old_r, old_j = np.nonzero(np.arange(k)[None, :] < count[touched][:, None])
    r = np.concatenate([r, touched[old_r]])
    score, vec = np.concatenate([score, best[touched[old_r], old_j]]), np.concatenate([vec, ids[touched[old_r], old_j]])
    o = np.lexsort((vec, ~score, r))
    r, score, vec = r[o], score[o], vec[o]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    top = place < k
    best[r[top], place[top]], ids[r[top], place[top]] = score[top], vec[top]
    count[touched] = np.minimum(k, np.searchsorted(r, touched, side="right") - np.searchsorted(r, touched))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where they cannot round, else by integers."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of a's rows with the rows of b beside them."""
    return np.einsum("ij,ij->i", a, b)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.to_list(), dtype=np.int64).reshape(len(v), -1)


def topk(vectors: DataFrame, queries: DataFrame, k: int, levels=LEVELS, query_block: int = QUERY_BLOCK, stripe: int = STRIPE) -> DataFrame:
    """Both tables: (id bigint, v array<bigint>). -> (query_id, rank, vec_id, score)."""
    queries = queries.select("id", "v").distinct().withColumn("qn", F.xxhash64("v"))
    nq, nc = queries.count(), vectors.count()
    # as many stripes as tasks can run, but none under SMALL_STRIPE rows, and none over ``stripe``
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_blocks, stripes = max(1, -(-nq // query_block)), max(1, -(-nc // stripe), min(tasks, -(-nc // SMALL_STRIPE)))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id", "qn"), F.lit(q_blocks))).withColumn("cs", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    c = vectors.withColumn("cs", F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))
    both = q.select("qb", "cs", F.lit(True).alias("is_q"), "id", "qn", "v").unionByName(c.select("qb", "cs", F.lit(False).alias("is_q"), "id", F.lit(0).cast("bigint").alias("qn"), "v"))
    both = both.withColumn("n", F.size("v"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.is_q], pdf[~pdf.is_q]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "qn": [], "vec_id": [], "score": []}, dtype=np.int64)
        best, ids, count = block_topk(a.id.to_numpy(), _matrix(a.v), b.id.to_numpy(), _matrix(b.v), k, levels)
        real = np.arange(k)[None, :] < count[:, None]
        return pd.DataFrame({"query_id": np.repeat(a.id.to_numpy(), count), "qn": np.repeat(a.qn.to_numpy(), count), "vec_id": ids[real], "score": best[real]})

    part = both.groupBy("n", "qb", "cs").applyInPandas(run, "query_id bigint, qn bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id", "qn").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of vectors whose components are all there and finite."""
    x = F.col(vec_col)
    t = table.select(F.col(id_col).cast("bigint").alias("id"), x.cast("array<double>").alias("x")).filter("id is not null and x is not null")
    t = t.filter(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("x") > 0))
    return t.select("id", F.transform("x", lambda e: F.floor(e * scale).cast("bigint")).alias("v"))


def op1_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = materialise(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    return topk(v, v.filter("id % 20 = 0"), 20)


SQL = """
with f as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.v as qv, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT as score
  from (select distinct vec_id, v from f where vec_id % 20 = 0) q join f c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, (row_number() over (partition by query_id, qv order by score desc, vec_id))::INTEGER as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""
