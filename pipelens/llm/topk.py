"""Exact top-k search by inner product, over multi-resolution segment statistics.

A vector of integers is cut into segments, at 4 and at 16 segments of equal length (the last padded with zeros). With
m and s the mean and deviation of a segment of n values, ||q - x||^2 is at least the sum over segments of
n * ((mq - mx)^2 + (sq - sx)^2); as q.x = (||q||^2 + ||x||^2 - ||q - x||^2) / 2, a lower bound of the distance is an
upper bound of the score, n * (mq * mx + sq * sx) summed over the segments. Candidates whose coarse bound stays below a
query's k-th best score so far go; the finer level follows for those left, and exact products for the survivors.

Queries and candidates come in blocks; a task holds its candidates in one block at a time and keeps k rows a query.
The best of all tasks are merged by rank. Ties go to the smaller id. Every comparison is exact: values are integers,
and products stay below 2**53 (components up to 2**22 in size at 512 dimensions).

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id. A query
meets the candidates of its own length. Rows that repeat an id are candidates each; a query is no candidate of its
own id. Fewer candidates than k: all. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import staged
from pipelens.llm.vectors import blocks, matrix, usable

LEVELS = (4, 16)
QUERY_BLOCK, BLOCK = 512, 4096


def segments(x: np.ndarray, count: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a product of two rows bounds the inner product."""
    n, d = x.shape
    size = -(-d // count)
    padded = np.zeros((n, size * count))
    padded[:, :d] = x
    parts = padded.reshape(n, count, size)
    return np.concatenate([parts.mean(2), parts.std(2)], 1) * np.sqrt(size)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The k best of the candidates shown so far, for each of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.levels = [segments(vectors, c) for c in LEVELS]
        self.top = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        self.worst = np.full(len(ids), -np.inf)

    def show(self, ids: np.ndarray, x: np.ndarray, levels: list[np.ndarray]) -> None:
        for at in range(0, len(ids), 512):
            part = slice(at, at + 512)
            slack = 1e-6
            coarse = self.levels[0] @ levels[0][part].T
            left = coarse >= (self.worst - slack - 1e-9 * np.abs(self.worst))[:, None]
            rows = np.flatnonzero(left.any(1))
            if not len(rows):
                continue
            columns = np.flatnonzero(left.any(0))
            fine = self.levels[1][rows] @ levels[1][part][columns].T
            left = left[np.ix_(rows, columns)] & (fine >= (self.worst - slack - 1e-9 * np.abs(self.worst))[rows, None])
            keep = left.any(0)
            if not keep.any():
                continue
            columns, left = columns[keep], left[:, keep]
            exact = self.q[rows] @ x[part][columns].T
            left &= exact >= self.worst[rows, None]
            own = ids[part][columns]
            for i in np.flatnonzero(left.any(1)):
                r = rows[i]
                hit = left[i] & (own != self.ids[r])
                if hit.any():
                    all_ids = np.concatenate([self.top[r][0], own[hit]])
                    all_scores = np.concatenate([self.top[r][1], exact[i][hit]])
                    best = _best(all_ids, all_scores, self.k)
                    self.top[r] = all_ids[best], all_scores[best]
                    if len(best) == self.k:
                        self.worst[r] = all_scores[best[-1]]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows are pairs of blocks in order of the query block."""
    now, search = None, None

    def out() -> pa.RecordBatch:
        q = np.repeat(search.ids, [len(t[0]) for t in search.top])
        ids = np.concatenate([np.zeros(0, np.int64), *[t[0] for t in search.top]])
        scores = np.concatenate([np.zeros(0), *[t[1] for t in search.top]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    for batch in batches:
        for row in range(len(batch)):
            get = lambda c: batch.column(batch.schema.get_field_index(c))[row]  # noqa: E731, B023
            mark = (get("dim").as_py(), get("qblock").as_py())
            if mark != now:
                if search is not None:
                    yield out()
                search, now = Search(get("qids").values.to_numpy(), matrix(get("qvs")), k), mark
            x = matrix(get("vs"))
            search.show(get("ids").values.to_numpy(), x, [segments(x, c) for c in LEVELS])
    if search is not None:
        yield out()


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, parts: int | None = None, id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query``, against all rows.

    ``vector`` holds integers. ``parts`` is the number of groups that candidates are dealt to, a task each; it grows
    with the number of candidate blocks.
    """
    rows = vectors.where(usable(vector) & F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim"), is_query.alias("q")
    )
    rows = staged(rows, "vectors")
    candidates = staged(blocks(rows.select("id", "v", "dim"), ["dim"], BLOCK, ["id", "v"], F.xxhash64("id")), "candidates")
    n = candidates.count()
    parts = parts or max(1, min(n, 8 + n // 8))
    queries = blocks(rows.where("q").select("id", "v", "dim"), ["dim"], QUERY_BLOCK, ["id", "v"], F.xxhash64("id", F.lit(1)))
    queries = queries.select("dim", F.col("block").alias("qblock"), F.col("id").alias("qids"), F.col("v").alias("qvs"))
    # The stated query set against all rows: each block of queries goes to every group of candidate blocks.
    dealt = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    grouped = candidates.select("dim", F.pmod("block", F.lit(parts)).cast("int").alias("part"), "block", F.col("id").alias("ids"), F.col("v").alias("vs"))
    pairs = dealt.join(grouped, ["dim", "part"]).repartition(max(1, parts), "part").sortWithinPartitions("part", "dim", "qblock", "block")
    found = pairs.select("dim", "qblock", "qids", "qvs", "ids", "vs").mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
