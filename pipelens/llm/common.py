"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.storage import discard, staged

__all__ = ["connected_components", "discard", "held_out", "staged", "table"]


def held_out(doc_id: str | Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text, modulo 4, is 2. Null ids are held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges(u, v)``; a component's name is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and contracts the edges.
    At least half of the nodes that are left vanish in a round. No link and no label reaches the driver, only counts.
    Tables of a round are deleted when the next one is written.
    """
    edges = staged(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("u").alias("near"))
        )
        hooks = staged(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("top")), "hooks")
        while True:  # pointer jumping
            up = hooks.select(F.col("node").alias("top"), F.col("top").alias("over"))
            jumped = staged(hooks.join(up, "top").select("node", F.col("over").alias("top"), (F.col("over") != F.col("top")).alias("moved")), "hooks")
            discard(hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        if found is None:
            found = staged(hooks.select("node", F.col("top").alias("component")), "components")
        else:
            before = found
            found = staged(
                before.join(hooks.select(F.col("node").alias("component"), "top"), "component", "left").select(
                    "node", F.coalesce("top", "component").alias("component")
                ),
                "components",
            )
            discard(before)
        left = hooks.select(F.col("node").alias("u"), F.col("top").alias("a"))
        right = hooks.select(F.col("node").alias("v"), F.col("top").alias("b"))
        before = edges
        edges = staged(
            before.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "edges",
        )
        discard(before, hooks)
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found
