"""Operator 3, exact top-k search by segment statistics.

Vectors are cut to equal segments. For two segments of n components, the inner product is at most
n * (m1 * m2 + s1 * s2), with means m and deviations s: the distance is at least what these leave.
From coarse to fine segments, a candidate whose bound falls below a query's k-th best score so far is
dropped; exact scores, in whole numbers, are computed for the survivors alone. The first 4 k candidates of a block set the
first floor; all others meet the bounds.

Queries and candidates are dealt into blocks of bounded size; each pair of blocks is one group, and
a group returns k rows a query, so the last step ranks k rows a block for each query: the work is queries
times candidates, in blocks. Scores beyond 64 bits are held at the largest such number.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part, so an
empty table gives no rows. Vectors are compared with those of equal length only. A row never meets rows of
its own id; a repeated id counts once as a query (its smallest vector), and each of its rows as a candidate;
equal scores go to the smaller id. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltgrain.llm.common import table, written

QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 2048, 8192, 1024
#: Candidates, for each place of k, whose exact scores set the first floor.
START = 4
FOUND = "query_id long, vec_id long, score long"
#: Numbers of segments, coarse to fine; those beyond a vector's length are skipped.
SEGMENTS = (1, 4, 16, 32)


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, each times the root of its segment's length: their products add up to the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    n = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    mean = total / n
    spread = np.sqrt(np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) / n - mean**2, 0))
    return np.hstack([mean, spread]) * np.sqrt(np.hstack([n, n]))


def products(q: np.ndarray, v: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Inner products of rows; large: which may need more than 64 bits."""
    with np.errstate(over="ignore"):
        out = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[a : a + 65536], v[a : a + 65536]) for a in range(0, len(q), 65536))])
    for i in np.flatnonzero(large):
        exact = sum(x * y for x, y in zip(q[i].tolist(), v[i].tolist(), strict=True))
        out[i] = max(-(2**63), min(2**63 - 1, exact))
    return out


def best_of(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: query's place, vec_id, score. seen: gets the numbers of pairs and of survivors."""
    fq, fv = q.astype(float), v.astype(float)
    levels = [(segment_features(fq, s), segment_features(fv, s)) for s in SEGMENTS if s <= q.shape[1]]
    norm_q, norm_v = np.linalg.norm(fq, axis=1), np.linalg.norm(fv, axis=1)
    place, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    floor = np.full(len(q), -np.inf)
    start = min(len(v), START * k)
    for at, end in zip([0, *range(start, len(v), CHUNK)], [start, *range(start + CHUNK, len(v), CHUNK), len(v)], strict=False):
        rows = np.arange(at, end)
        alive = q_id[:, None] != v_id[rows][None, :]
        all_of = int(alive.sum())
        for of_q, of_v in levels if at else ():
            who = np.flatnonzero(alive.any(axis=0))
            rounding = 1e-9 * np.outer(norm_q, norm_v[rows[who]]) + 1e-6
            alive[:, who] &= of_q @ of_v[rows[who]].T + rounding >= floor[:, None]
        i, j = np.nonzero(alive)
        if seen is not None and at:
            seen[0], seen[1] = seen[0] + all_of, seen[1] + len(i)
        if not len(i):
            continue
        j = rows[j]
        got = np.concatenate([products(q[i[a : a + CHUNK * 64]], v[j[a : a + CHUNK * 64]], norm_q[i[a : a + CHUNK * 64]] * norm_v[j[a : a + CHUNK * 64]] >= 2**62) for a in range(0, len(i), CHUNK * 64)])
        place, ids, scores = np.concatenate([place, i]), np.concatenate([ids, v_id[j]]), np.concatenate([scores, got])
        by = np.lexsort((ids, ~scores, place))  # ~x is -x - 1, which fits
        place, ids, scores = place[by], ids[by], scores[by]
        first = np.searchsorted(place, place)
        keep = np.arange(len(place)) - first < k
        place, ids, scores = place[keep], ids[keep], scores[keep]
        n = np.bincount(place, minlength=len(q))
        last = np.cumsum(n) - 1
        floor = np.where(n >= k, scores[np.maximum(last, 0)], -np.inf)
    return place, ids, scores


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = rows["v"].combine_chunks()
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return rows["vec_id"].to_numpy(), flat.to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among vectors, whose components are taken as floor(scale * x)."""

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
        df = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v")).withColumn("d", F.size("v"))

    asked = whole(queries).groupBy("vec_id", "d").agg(F.min("v").alias("v"))
    asked = written(asked.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy("d"))).filter("r = 1").drop("r"), "topk-queries")
    held = written(whole(vectors), "topk-vectors")
    n_q, n_v = max(1, math.ceil(asked.count() / QUERY_BLOCK)), max(1, math.ceil(held.count() / CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("qb", block(n_q)).withColumn("vb", each(n_v))
    held = held.withColumn("vb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_v)).cast("int")).withColumn("qb", each(n_q))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        (q_id, q), (v_id, v) = _matrix(left), _matrix(right)
        place, ids, scores = best_of(q_id, q, v_id, v, k)
        return pa.table({"query_id": q_id[place], "vec_id": ids, "score": scores})

    keys = ("d", "qb", "vb")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
