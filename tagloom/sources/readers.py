"""Tolerant readers for notes, codes, JSON lines, tables and small artefacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import cleaning as fx
from tagloom.operators.cleaning import DataCheckError, enforce_types, read_limit, require_columns
from tagloom.session import spread

# Cell texts that stand for a missing value.
NULL_MARKS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
RECORD_SCHEMA = "subject_id string, hadm_id string, text string, labels array<string>"
DEFAULT_TAU = 0.5


def read_text_csv(
    spark: SparkSession, path: str, columns: list[str], optional: tuple[str, ...] = (), max_rows: int | None = None,
    encoding: str = "UTF-8", skip_long_rows: bool = False, multi_line: bool = True,
) -> DataFrame:
    """CSV by header name, every value as text (so leading zeros and bad ids survive).

    Short rows are null-padded. Over-long rows are truncated to the header, or
    skipped with ``skip_long_rows``. Undecodable bytes are replaced. Column
    names are matched without case and come back in lower case.
    """
    options = dict(header=True, quote='"', escape='"', multiLine=multi_line, encoding=encoding, mode="PERMISSIVE")
    header = spark.read.options(**options).csv(path).columns
    extra = "__extra"
    fields = ", ".join(f"`{name}` string" for name in [*header, extra])
    rows = spark.read.options(**options).schema(fields).csv(path)
    if skip_long_rows:
        rows = rows.filter(F.col(extra).isNull())
    by_name = {name.strip().lower(): name for name in header}
    missing = [c for c in columns if c.lower() not in by_name]
    if missing:
        raise DataCheckError(f"missing required columns: {missing}")
    wanted = [*columns, *[c for c in optional if c.lower() in by_name]]
    value = lambda c: F.col(f"`{by_name[c.lower()]}`")
    picked = rows.select(*[F.when(~value(c).isin(NULL_MARKS), value(c)).alias(c.lower()) for c in wanted])
    return read_limit(picked, max_rows)


def read_notes_csv(spark: SparkSession, path: str, max_rows: int | None = None, encoding: str = "UTF-8", **options) -> DataFrame:
    """subject_id, hadm_id, text and, where the file has it, category.

    A gz file is one partition; the rows are spread before any text work.
    """
    notes = read_text_csv(spark, path, ["subject_id", "hadm_id", "text"], ("category",), max_rows, encoding, **options)
    return spread(notes, "hadm_id", "text")


def read_codes_csv(spark: SparkSession, path: str, max_rows: int | None = None, code_column: str = "icd9_code", **options) -> DataFrame:
    rows = read_text_csv(spark, path, ["hadm_id", code_column], (), max_rows, **options)
    return rows.select("hadm_id", F.col(code_column.lower()).alias("code"))


def _json_lines(spark: SparkSession, path: str, nrows: int | None) -> DataFrame:
    lines = read_limit(spark.read.text(path), nrows)
    return lines.filter(F.length(fx.strip(F.col("value"))) > 0)


def _is_object(line: Column) -> Column:
    return F.startswith(F.coalesce(F.get_json_object(line, "$"), F.lit("")), F.lit("{"))


def read_jsonl(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """JSON lines → subject_id, hadm_id, text, labels; malformed lines skipped.

    Ids become numbers where they are numbers; labels that are no list are empty.
    """
    lines = _json_lines(spark, path, nrows).filter(_is_object(F.col("value")))
    rec = lines.select(F.from_json("value", RECORD_SCHEMA).alias("r"))
    ids = [F.col(f"r.{c}").try_cast("bigint").alias(c) for c in ("subject_id", "hadm_id")]
    empty = F.array().cast("array<string>")
    return rec.select(*ids, F.col("r.text").alias("text"), F.coalesce("r.labels", empty).alias("labels"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of lines ``read_jsonl`` skips."""
    return _json_lines(spark, path, None).agg(F.count_if(~_is_object(F.col("value"))).alias("n_malformed"))


def read_split(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A split file with strict ids and cleaned labels (dots removed).

    Labels may be a list, JSON text or comma text. At least one row must have
    a label.
    """
    lines = _json_lines(spark, path, None).filter(_is_object(F.col("value")))
    key = lambda name: F.get_json_object("value", f"$.{name}")
    rows = lines.select(key("subject_id").alias("subject_id"), key("hadm_id").alias("hadm_id"),
                        F.coalesce(key("text"), F.lit("")).alias("text"), key("labels").alias("__labels"))
    rows = enforce_types(rows, ["subject_id", "hadm_id"]).withColumn("labels", fx.normalize_labels(F.col("__labels"), remove_dots=True))
    if check:
        stats = rows.agg(F.count_if(F.col("subject_id").isNull() | F.col("hadm_id").isNull()), F.count_if(F.size("labels") > 0)).first()
        if stats[0]:
            raise DataCheckError(f"{stats[0]} rows without ids")
        if not stats[1]:
            raise DataCheckError("no row has a label")
    return rows.select("subject_id", "hadm_id", "text", "labels")


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Merged table by format or suffix; CSV labels come back as a list too."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema(
            "subject_id bigint, hadm_id bigint, text string, labels string").csv(path)
        return rows.withColumn("labels", fx.labels_any_to_list(F.col("labels")))
    raise ValueError(f"unsupported format: {fmt}")


def read_min_columns(spark: SparkSession, path: str) -> DataFrame:
    """Ids and label indices only; the scan reads no other column. Null ids are dropped."""
    rows = require_columns(spark.read.parquet(path), ["subject_id", "hadm_id", "labels_idx"])
    rows = rows.select("subject_id", "hadm_id", "labels_idx").dropna(subset=["subject_id", "hadm_id"])
    if rows.schema["labels_idx"].dataType.simpleString() == "string":
        rows = rows.withColumn("labels_idx", fx.coerce_index_cell(F.col("labels_idx")))
    empty = F.array().cast("array<int>")
    ids = [F.col(c).cast("bigint").alias(c) for c in ("subject_id", "hadm_id")]
    return rows.select(*ids, F.coalesce(F.col("labels_idx").cast("array<int>"), empty).alias("labels_idx"))


def load_label_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON object code → idx; indices must be 0..K-1, each once."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("code", "idx"))
    check_label_map(pairs)
    return pairs


def check_label_map(label_map: DataFrame) -> None:
    k = label_map.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("d"), F.countDistinct("code").alias("c"),
        F.min("idx").alias("lo"), F.max("idx").alias("hi"),
    ).first()
    if not (k.n > 0 and k.n == k.d == k.c and k.lo == 0 and k.hi == k.n - 1):
        raise DataCheckError("label map must be non-empty, unique and contiguous from 0")


def load_thresholds(spark: SparkSession, path: str) -> tuple[str, float | DataFrame]:
    """(kind, number or (idx, tau) table); a missing file is the global default."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return "global", DEFAULT_TAU
    row = whole.select(
        F.coalesce(F.get_json_object("value", "$.kind"), F.lit("global")).alias("kind"),
        F.get_json_object("value", "$.value").alias("value"),
    )
    found = row.first()
    if not (found.value or "").startswith("["):
        return found.kind, float(found.value) if found.value else DEFAULT_TAU
    return found.kind, row.select(F.posexplode(F.from_json("value", "array<float>")).alias("idx", "tau"))


def load_metrics_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All metrics tables that exist, columns trimmed and matched by name."""
    out = None
    for path in paths:
        try:
            one = spark.read.parquet(path)
        except AnalysisException:
            continue
        one = one.toDF(*[c.strip() for c in one.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise DataCheckError("none of the metrics tables exists")
    return out


def read_explanations(spark: SparkSession, path: str, schema) -> DataFrame:
    """Nested explanation lines; blank lines skipped, tokens and scores required."""
    rows = spark.read.schema(schema).json(path)
    bad = rows.filter(F.col("tokens").isNull() | F.col("scores").isNull())
    if not bad.isEmpty():
        raise DataCheckError("an explanation lacks tokens or scores")
    return rows
