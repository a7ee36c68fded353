"""Vectors in blocks: what exact top-k search and embedding near-dedup share.

Vectors travel as packed blocks, each a row with the ids and the float32 values of a bounded number of vectors, so that
a pair of blocks is a row of a join and numpy works on whole blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for arrays that are not null or empty and hold finite numbers only."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def blocks(rows: DataFrame, keys: list[str], size: int, columns: list[str], spread: Column) -> DataFrame:
    """Rows of each combination of ``keys``, in blocks of about ``size``: keys, block, and a list for each column.

    The number of blocks of a combination follows its count; ``spread`` deals its rows to them.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    dealt = rows.withColumn("__h", spread).alias("r").join(counts.alias("c"), same).select(
        *[f"r.{c}" for c in rows.columns], F.pmod("__h", F.ceil(F.col("__n") / size)).alias("block")
    )
    packed = F.sort_array(F.collect_list(F.struct(*columns)))
    return dealt.groupBy(*keys, "block").agg(packed.alias("__l")).select(*keys, "block", *[F.col("__l")[c].alias(c) for c in columns])


def matrix(lists) -> np.ndarray:
    """A (vectors, dim) array of float64 from an Arrow list-of-lists scalar."""
    values = lists.values
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(np.float64)
