"""Sinks. Every writer hands the rows to a Spark data source; none collects them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import cleaning as fx
from tagloom.operators.cleaning import DataCheckError, assert_no_absolute, require_columns, sanitize_path_columns
from tagloom.operators.labels import multi_hot, multi_hot_dense
from tagloom.sources.readers import check_label_map

MERGED = ["subject_id", "hadm_id", "text", "labels"]


def write_csv_json_labels(df: DataFrame, path: str, root: str | None = None) -> None:
    """CSV with the label list as JSON text; path columns are shortened first."""
    require_columns(df, ["labels"])
    if root is not None:
        df = sanitize_path_columns(df, root)
        assert_no_absolute(df)
    is_text = df.schema["labels"].dataType.simpleString() == "string"
    cell = fx.labels_to_json(F.col("labels")) if is_text else fx.label_list_to_json(F.col("labels"))
    df.withColumn("labels", cell).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    """Merged table with a fixed schema, zstd; read back and checked."""
    require_columns(df, MERGED)
    is_text = df.schema["labels"].dataType.simpleString() == "string"
    labels = fx.labels_any_to_list(F.col("labels")) if is_text else F.coalesce(
        F.col("labels").cast("array<string>"), F.array().cast("array<string>"))
    typed = df.select(
        F.col("subject_id").cast("bigint").alias("subject_id"), F.col("hadm_id").cast("bigint").alias("hadm_id"), *extra,
        F.col("text").cast("string").alias("text"), labels.alias("labels"),
    )
    typed.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.schema["labels"].dataType.simpleString() != "array<string>" or not back.filter("labels is null").isEmpty():
        raise DataCheckError("labels did not survive the round trip")


def write_encoded(df: DataFrame, path: str) -> None:
    """subject_id, hadm_id, text, labels_idx (and ``part`` if there is one) to zstd Parquet."""
    columns = ["subject_id", "hadm_id", *[c for c in ["part"] if c in df.columns], "text", "labels_idx"]
    require_columns(df, columns).select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """``{"text", "labels", "hadm_id", "subject_id"}`` per line, and ``part`` where texts come in parts."""
    rows = require_columns(df, MERGED)
    is_text = df.schema["labels"].dataType.simpleString() == "string"
    labels = fx.labels_any_to_list(F.col("labels")) if is_text else F.coalesce("labels", F.array().cast("array<string>"))
    part = ["part"] if "part" in df.columns else []
    rows.select("text", labels.alias("labels"), "hadm_id", "subject_id", *part).write.mode("overwrite").json(path)


def save_label_map(label_map: DataFrame, path: str) -> None:
    """One JSON object code → idx (K entries), verified before and after."""
    check_label_map(label_map)
    entries = F.array_sort(F.collect_list(F.struct("idx", "code")))
    as_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["code"], e["idx"])))
    one = label_map.agg(F.to_json(as_map).alias("value"))
    one.write.mode("overwrite").text(path)
    back = label_map.sparkSession.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("code", "idx"))
    check_label_map(back)


def save_thresholds(spark: SparkSession, tau: float | DataFrame, path: str, kind: str = "global") -> None:
    """``{"kind", "value", "meta"}`` as JSON; a (idx, tau) table becomes a list."""
    if kind not in {"global", "per_label"}:
        raise ValueError(f"unknown threshold kind: {kind}")
    if isinstance(tau, DataFrame):
        packed = F.array_sort(F.collect_list(F.struct("idx", F.col("tau").cast("float").alias("tau"))))
        values = tau.agg(F.transform(packed, lambda e: e["tau"]).alias("value"))
        k = F.size("value")
    else:
        values = spark.range(1).select(F.lit(float(tau)).alias("value"))
        k = F.lit(None).cast("int")
    meta = F.struct(k.alias("K"), F.lit("tuned on val").alias("notes"))
    values.select(F.to_json(F.struct(F.lit(kind).alias("kind"), "value", meta.alias("meta"))).alias("value")).coalesce(1).write.mode(
        "overwrite").text(path)


def append_metrics(row: DataFrame, path: str) -> None:
    """Append one metrics row; ``seq`` orders repeated runs."""
    if "seq" not in row.columns:
        row = row.withColumn("seq", F.unix_micros(F.current_timestamp()))
    row.coalesce(1).write.mode("append").parquet(path)


def write_split_ids(assignment: DataFrame, path: str, key: str = "subject_id") -> None:
    """Sorted ids, one per line, one folder per split."""
    ids = assignment.select("split", key).distinct()
    ordered = ids.repartitionByRange("split", key).sortWithinPartitions("split", key)
    ordered.select("split", F.col(key).cast("string").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_doc_predictions(scored: DataFrame, path: str, n_labels: int, chunks: DataFrame | None = None, key: str = "hadm_id") -> None:
    """Documents with y and p arrays; optionally the chunk → document table."""
    dense = multi_hot_dense(scored, n_labels)
    dense.select(key, "y", F.col("scores").alias("p")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
    if chunks is not None:
        chunks.select("chunk_no", key).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")


def write_multi_hot(encoded: DataFrame, path: str, n_labels: int, dense: bool = False, key: str = "hadm_id") -> None:
    """Label matrix as (key, idx) cells or as dense rows."""
    rows = multi_hot_dense(encoded, n_labels).select(key, "y") if dense else multi_hot(encoded, n_labels, key)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_explanations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
