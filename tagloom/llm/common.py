"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of text handed to Python at once. Texts are read whole, so this bounds a
# worker's memory by that many of the longest texts.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch to ``rows`` when it is larger or unbounded."""
    now = int(spark.conf.get(_BATCH_CONF))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH_CONF, str(rows))


def id_fold(key: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def picked_below(share: float, *cols: Column) -> Column:
    """A repeatable choice of about ``share`` of the rows by a hash of ``cols``."""
    return F.pmod(F.xxhash64(F.lit("pick"), *cols), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Catalyst inlines a projected expression into every place of a lambda that
    names it, so an array that is indexed inside a lambda would be rebuilt for
    each element. Binding it as the variable of a one-element transform keeps
    one evaluation.
    """
    return F.transform(F.array(value), body)[0]
