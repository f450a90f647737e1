"""Rank and running totals over a total order, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import cut_lineage

_PART, _PLACE = "__range_part", "__range_place"


def global_rank(
    df: DataFrame,
    order: list[Column],
    rank: str = "rank",
    total: str | None = None,
    running: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add the 1..N position of every row under ``order`` (a total order).

    ``running`` maps a numeric column to the name of its running sum, ``total``
    names a column with N, ``totals`` maps a running column to the name of its
    overall sum. Rows are range-partitioned on the order, so equal
    leading values spread over tasks, and sorted; the per-partition counts (one
    row per shuffle partition) become offsets. The sorted rows are checkpointed
    with their place in the partition, so a rank takes this one shuffle; only
    running sums need a window over each partition. Runs when called.
    """
    running, totals = running or {}, totals or {}
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id counts rows of a partition in its low 33 bits.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranged = cut_lineage(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumns({_PART: F.spark_partition_id(), _PLACE: place})
    )
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = {f"__sum_{c}": F.sum(c) for c in running}
    per_part = ranged.groupBy(_PART).agg(
        F.count(F.lit(1)).alias("__n"), *[s.alias(name) for name, s in sums.items()]
    )
    offsets = per_part.select(
        _PART,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__range_before"),
        F.sum("__n").over(everything).alias("__range_all"),
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums],
        *[F.sum(f"__sum_{c}").over(everything).alias(name) for c, name in totals.items()],
    )
    inside = Window.partitionBy(_PART).orderBy(_PLACE)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranged.join(F.broadcast(offsets), _PART)
    added = {rank: F.col(_PLACE) + F.col("__range_before")}
    for column, name in running.items():
        added[name] = F.sum(column).over(upto) + F.col(f"__sum_{column}")
    if total:
        added[total] = F.col("__range_all")
    return ranked.withColumns(added).drop(_PART, _PLACE, "__range_before", "__range_all", *sums)
