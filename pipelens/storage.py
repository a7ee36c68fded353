"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; without it, in local mode alone, one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "pipelens-shared")
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_written() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


def place_for(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    if not _written:
        atexit.register(_drop_written)
    path = f"{shared_dir(spark)}/pipelens-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table.

    This cuts the lineage, and what is written outlives any executor.
    """
    path = place_for(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path in _written:
            _delete(_written.pop(path), path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of a step, whose own tables are deleted then; nothing else may be staging meanwhile."""
    before = set(_written)
    out = staged(make(), name)
    for path in [p for p in _written if p not in before and p != out._staged_at]:
        _delete(_written.pop(path), path)
    return out


def ranged(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt by ranges of the order, with the range's number in ``__p``, written once; and (range, rows) sorted.

    The numbers are a column of the written table, so that whatever is counted by range, or counted within one, speaks
    of the same ranges. The second table has at most as many rows as there are shuffle partitions.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = staged(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), name)
    return out, out.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based place in the order, without moving all rows to one task.

    Rows are dealt by ranges, numbered within each, and shifted by the sizes of the ranges before it. A range without
    a known start is an error, never a lost row.
    """
    rows, sizes = ranged(df, order, "ranged")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    base = F.coalesce("__base", F.raise_error(F.lit("a range of rows has no start")).cast("bigint"))
    numbered = rows.withColumn("__k", inside).join(F.broadcast(starts), "__p", "left")
    return numbered.withColumn(name, (F.col("__k") + base).cast("bigint")).drop("__p", "__k", "__base")


def order_statistics(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Exact percentiles of the values that are not null, interpolated between neighbours; None for no values.

    Values are counted first, the distinct ones dealt by ranges, and only the ranges that hold a wanted rank are
    cumulated. No task gathers a column, and the driver gets a row for each range and for each wanted rank.
    """
    counts = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    rows, _ = ranged(counts, [F.col("v")], "values")
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("__p").agg(F.sum("c")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        discard(rows)
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    ranks = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    wanted, first = [], 0
    for part, n in sizes:
        wanted += [(part, first, r) for r in ranks if first <= r < first + n]
        first += n
    bases = df.sparkSession.createDataFrame(wanted, "__p int, __first bigint, __rank bigint")
    within = Window.partitionBy("__p").orderBy("v")
    ends = rows.where(F.col("__p").isin(sorted({p for p, _, _ in wanted}))).withColumn("__end", F.sum("c").over(within))
    end, start = F.col("__first") + F.col("__end"), F.col("__first") + F.col("__end") - F.col("c")
    hits = ends.join(F.broadcast(bases), "__p").where((F.col("__rank") >= start) & (F.col("__rank") < end))
    found = {r["__rank"]: r["v"] for r in hits.select("__rank", "v").collect()}
    discard(rows)
    out = []
    for p in places:
        low = int(p)
        a, b = found[low], found[min(low + 1, total - 1)]
        out.append(a + (b - a) * (p - low) if b != a else a)
    return out


def grouped_median(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, ``name``): the exact median of each group, without gathering a group's values in one task.

    Values are counted by group, dealt by ranges of (keys, value), and cumulated within a range; the sizes of a
    group's earlier ranges shift that. Rows with a null key take no part; a group without values has none.
    """
    quoted = [F.col(f"`{k}`") for k in keys]
    counts = df.select(*quoted, value.cast("double").alias("__v")).where(F.col("__v").isNotNull()).groupBy(*quoted, "__v").agg(F.count(F.lit(1)).alias("__c"))
    rows, _ = ranged(counts, [*quoted, F.col("__v")], "values")
    sums = rows.groupBy(*quoted, "__p").agg(F.sum("__c").alias("__n"))
    group = Window.partitionBy(*quoted)
    sums = sums.select(
        *quoted, "__p", F.sum("__n").over(group).alias("__all"),
        F.coalesce(F.sum("__n").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"),
    )
    ends = rows.withColumn("__end", F.sum("__c").over(Window.partitionBy(*quoted, "__p").orderBy("__v")))
    placed = ends.join(sums, [*keys, "__p"])
    end = F.col("__first") + F.col("__end")
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    middle = ((low >= end - F.col("__c")) & (low < end)) | ((high >= end - F.col("__c")) & (high < end))
    # The one or two values around the middle; one that holds both places stands for both.
    return placed.where(middle).groupBy(*quoted).agg(((F.min("__v") + F.max("__v")) / 2).alias(name))
