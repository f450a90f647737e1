"""Session helpers: lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is offered for broadcast only after this many rows have been proven
# to be its upper bound (label maps, thresholds, capped vocabularies).
BROADCAST_ROWS = 1_000_000
BROADCAST_CELLS = 20_000_000
BROADCAST_BYTES = 256 << 20

_FREE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_STORED: list[str] = []  # what scratch_path has handed out and clear_stored may delete


def build_session(app: str = "tagloom", cores: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; invent one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    Used where two later passes must see the very same rows in the very same
    partitions, even after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, cells: str | None = None, max_cells: int = BROADCAST_CELLS
) -> DataFrame:
    """Hint a broadcast when ``df`` is proven to hold at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows; their strings may take
    ``BROADCAST_BYTES``. ``cells`` names an array
    column whose entries are bounded by ``max_cells`` as well. A larger table
    is returned without a hint, so that Spark shuffles both sides (AQE splits
    hot keys). Call it on tables that are cheap to read twice: checkpointed or
    stored.
    """
    if cells is not None and (df.agg(F.sum(F.size(cells))).first()[0] or 0) > max_cells:
        return df
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, and strings of ``BROADCAST_BYTES`` in all."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() == "string"), F.lit(0))
    seen = df.select(width.alias("width")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("width")).first()
    return seen[0] <= max_rows and (seen[1] or 0) <= BROADCAST_BYTES


def bounded_dict(df: DataFrame, key: str, value: str, max_rows: int = BROADCAST_ROWS) -> dict:
    """A small two-column table as a dictionary for row-local lookups in Arrow functions.

    Label maps and vocabularies are capped when they are built; a table beyond
    ``max_rows`` is refused. Runs when called.
    """
    rows = df.select(key, value).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a lookup table may have {max_rows} rows at most")
    return {r[0]: r[1] for r in rows}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan over all cores when it comes in fewer partitions.

    For small or unsplittable inputs (one gz file, one row group) ahead of
    text work; a scan with enough partitions is left alone, so nothing is
    shuffled at scale. Hashing on the keys keeps a re-run task identical; a
    nullable or frequent key needs a second one beside it that tells rows apart.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, kept until ``clear_stored``."""
    ensure_checkpoint_dir(spark)
    _STORED.append(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    return _STORED[-1]


def clear_stored(spark: SparkSession) -> int:
    """Delete every table this process has stored below the checkpoint folder; returns how many.

    Call it when all results that read them have been written.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    deleted = 0
    while _STORED:
        path = hadoop.Path(_STORED.pop())
        deleted += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def store_table(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    For tables that grow with the data and are read again: later passes prune
    columns, see real sizes, and never recompute the upstream work. With ``free``,
    Spark drops the shuffle files of this write when it ends, not when the
    driver's collector comes by.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    was = spark.conf.get(_FREE_CONF, "false")
    try:
        if free:
            spark.conf.set(_FREE_CONF, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(_FREE_CONF, was)
    return spark.read.schema(df.schema).parquet(path)
