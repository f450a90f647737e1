"""Connected components by contraction, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import store_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to over any number of links.

    Only nodes with a link to another appear; an empty table gives no rows. Each
    round points every node to its smallest neighbour, follows the pointers to
    their roots, and keeps the distinct links between different roots. Minima
    combine map-side, so a node with very many links is no hot key there.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") < F.col("b")).distinct()
    edges = store_table(edges, "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        near = both.groupBy("node").agg(F.min("to").alias("to"))
        pointer = flatten(store_table(near.select("node", F.least("node", "to").alias("root")), "pointers"))
        if labels is None:
            labels = pointer
        else:
            up = pointer.select(F.col("node").alias("root"), F.col("root").alias("__up"))
            labels = store_table(
                labels.join(up, "root", "left").select("node", F.coalesce("__up", "root").alias("root")), "labels")
        left = pointer.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = pointer.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = store_table(
            edges.join(left, "a").join(right, "b").where(F.col("ra") != F.col("rb"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def flatten(pointer: DataFrame) -> DataFrame:
    """Follow ``root`` pointers, which only ever go to smaller nodes, to their ends by doubling."""
    while True:
        up = pointer.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        further = store_table(
            pointer.join(up, "root").select("node", F.col("__up").alias("root"), (F.col("__up") != F.col("root")).alias("__moved")),
            "pointers")
        pointer = further.select("node", "root")
        if further.where("__moved").isEmpty():
            return pointer
