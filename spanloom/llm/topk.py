"""Exact top-k inner-product search by no-random-access aggregation (NRA) over sorted lists.

Candidates are dealt into bounded blocks. A block keeps one list per dimension, sorted by component. For a query,
a list is read from its top where the query's component is positive and from its bottom where it is negative, so
contributions only fall. Each round reads the next entries of every list in order and adds them to the candidates'
partial scores; no entry is read twice, and none out of turn. A candidate's upper bound is its partial score plus the
frontier of every list that hasn't come to it yet, its lower bound the same with the last entry of those lists. A
candidate whose upper bound is under the k-th best lower bound can't qualify any more. A query stops once few are left;
of those, and only those, the lists' unread parts are read for the final scores. All values are integers, so bounds
are exact.

Rounds work on all queries of a block that haven't stopped, and each halves what is left unread. With many dense
dimensions bounds separate outsiders only deep in the lists, so the first round goes deep at once.

Defined cases: vectors that are null, or hold a null or non-finite component, or one whose integer doesn't fit a long,
take no part (neither as query nor as candidate), nor do empty ones and rows without an id; a vector meets those of its
own length; ties go to the smaller id; repeated ids are separate candidates, except that a query row never meets rows
of its own id, and queries of one id give one list each k long together; a score beyond a long is the nearest long; an
empty table gives no rows; fewer than k candidates give all of them; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, table

#: Rows of a candidate block and of a query block at most; smaller inputs make up to SIDES blocks of LEAST_ROWS each.
BLOCK_ROWS, LEAST_ROWS, SIDES = 32_768, 2048, 8
#: Share of a list that the first round leaves unread; each further round halves it.
UNREAD = 0.125
#: A query stops once this share of the block's candidates, or k, are left.
FEW = 0.02
#: Partial scores that are held at once.
SCORES_AT_ONCE = 1 << 22
K = 20
SCALE = 64


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null if the vector is null or a component is null, not finite or too large."""
    x = F.transform(vector, lambda c: c.cast("double") * scale)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**63))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.transform(x, lambda c: F.floor(c).cast("long")))


class Lists:
    """One sorted list per dimension over a block of integer vectors, read from either end."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        #: Each entry's place in its list, from the bottom.
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)

    def entries(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """What reading on from ``first`` to ``end`` entries gives, from the tops and from the bottoms; 0 elsewhere."""
        n = len(self.x)
        top = (self.place < n - first) & (self.place >= n - end)
        bottom = (self.place >= first) & (self.place < end)
        return np.where(top, self.x, 0), np.where(bottom, self.x, 0)

    def frontiers(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For every candidate the last entry read of each list that hasn't come to it; 0 for the others."""
        n = len(self.x)
        return np.where(self.place < n - depth, self.sorted[n - depth], 0), np.where(self.place >= depth, self.sorted[depth - 1], 0)

    def slack(self, depth: int, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The least that the unread lists still give each of these candidates."""
        n = len(self.x)
        place = self.place[rows]
        unread = np.where(query >= 0, place < n - depth, place >= depth)
        return np.where(unread, np.where(query >= 0, self.sorted[0], self.sorted[-1]), 0) @ query

    def rest(self, depth: int, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What the unread parts of the lists hold for each of these candidates."""
        n = len(self.x)
        place = self.place[rows]
        unread = np.where(query >= 0, place < n - depth, place >= depth)
        return np.where(unread, self.x[rows], 0) @ query


def exact(x: np.ndarray, q: np.ndarray) -> type:
    """The type in which all partial scores are exact: double where they stay under 2**53, else unbounded integers."""
    most = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
    return np.float64 if most(x) * most(q) * max(1, x.shape[1]) < 2.0**53 else object


def nra(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, unread: float = UNREAD) -> pd.DataFrame:
    """Each query's k best candidates of the block, as (query_id, vec_id, score)."""
    kind, n = exact(x, queries), len(ids)
    lists, queries = Lists(x.astype(kind)), queries.astype(kind)
    few = max(k, int(n * FEW))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, SCORES_AT_ONCE // max(n, 1))
    for at in range(0, len(queries), step):
        own, q = query_ids[at : at + step], queries[at : at + step]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        partial = np.zeros((len(q), n), kind)
        alive = own[:, None] != ids[None, :]
        depth, left = 0, unread
        while len(own):
            before, depth = depth, min(n, max(depth + 1, n - int(n * left)))
            left /= 2
            top, bottom = lists.entries(before, depth)
            partial += up @ top.T + down @ bottom.T
            stop = np.ones(len(own), bool)
            if depth < n:
                top, bottom = lists.frontiers(depth)
                upper = partial + up @ top.T + down @ bottom.T
                for i in range(len(own)):
                    held = np.flatnonzero(alive[i])
                    if len(held) > k:
                        # The k-th best lower bound of the most promising ones; any others' would only be smaller.
                        promising = held[np.argpartition(upper[i, held], -min(4 * k, len(held)))[-min(4 * k, len(held)) :]]
                        lower = np.sort(partial[i, promising] + lists.slack(depth, q[i], promising))
                        alive[i, held[upper[i, held] < lower[-k]]] = False
                stop = alive.sum(axis=1) <= few
            for i in np.flatnonzero(stop):
                rows = np.flatnonzero(alive[i])
                score = partial[i, rows] + (lists.rest(depth, q[i], rows) if depth < n else 0)
                best = np.lexsort((ids[rows], -score))[:k] if kind is not object else np.array(sorted(range(len(rows)), key=lambda j: (-score[j], ids[rows[j]]))[:k], int)
                found.append((np.full(len(best), own[i]), ids[rows[best]], score[best]))
            own, q, up, down, partial, alive = own[~stop], q[~stop], up[~stop], down[~stop], partial[~stop], alive[~stop]
    columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3)]
    score = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in columns[2]] if kind is object else columns[2]
    return pd.DataFrame({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": np.array(score, np.int64)})


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best other rows.

    Blocks of candidates meet blocks of queries, each pair in one task of bounded size; a pair returns k rows a query.
    Blocks are made by row, so rows that repeat an id are dealt like any others.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.where("v is not null and id is not null").withColumn("dims", F.size("v")), "topk")
    n, nq = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    blocks, qblocks = (max(1, -(-count // block_rows), min(sides, count // LEAST_ROWS)) for count, sides in ((n, SIDES), (nq, 1)))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    row_hash = F.xxhash64("row")
    candidates = rows.select("dims", "id", "v", F.pmod(row_hash, F.lit(blocks)).cast("int").alias("cb"), every(qblocks).alias("qb"), F.lit(False).alias("is_q"))
    queries = rows.where("q").select("dims", "id", "v", every(blocks).alias("cb"), F.pmod(row_hash, F.lit(qblocks)).cast("int").alias("qb"), F.lit(True).alias("is_q"))

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf["is_q"].to_numpy(bool)
        if not q.any() or q.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        x, ids = np.stack(pdf["v"].to_list()), pdf["id"].to_numpy(np.int64)
        return nra(ids[~q], x[~q], ids[q], x[q], k)

    met = candidates.unionByName(queries).groupBy("dims", "cb", "qb").applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(64 * CAST(x AS DOUBLE)) >= 9223372036854775808)) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_exact_topk": op10_exact_topk}
SQL = {"op10_exact_topk": OP10_SQL}
