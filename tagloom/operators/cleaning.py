"""Filters, projections and cleaning steps over note and code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import cleaning as fx
from tagloom.functions import paths as px

MIN_TEXT_CHARS = 50


class DataCheckError(ValueError):
    """A table does not satisfy the contract an operator states."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataCheckError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise DataCheckError(f"no rows left: {what}")
    return df


def filter_category(df: DataFrame, value: str, column: str = "category", check: bool = False) -> DataFrame:
    """Rows whose stripped, lower-cased category equals ``value``.

    Without a category column the input comes back unchanged. ``check`` fails
    when the column is there but no row matches.
    """
    if column not in df.columns:
        return df
    kept = df.filter(F.lower(fx.strip(F.col(column))) == value.strip().lower())
    return require_rows(kept, f"{column} = {value}") if check else kept


def filter_category_exact(df: DataFrame, value: str, column: str = "category", text: str = "text") -> DataFrame:
    """Case-sensitive category filter that also drops null texts."""
    return df.filter((F.col(column) == value) & F.col(text).isNotNull())


def select_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project the required columns and drop rows with any null."""
    return require_columns(df, columns).select(*columns).dropna(subset=columns)


def normalize_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, fx.normalize_text(F.col(column)))


def drop_short(df: DataFrame, min_chars: int = MIN_TEXT_CHARS, column: str = "text") -> DataFrame:
    """Keep texts of at least ``min_chars`` characters."""
    if min_chars < 1:
        raise ValueError("min_chars must be at least 1")
    return df.filter(F.length(column) >= min_chars)


def enforce_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids to BIGINT; a value that is not a whole number fails the job."""

    def to_id(name: str):
        text = fx.strip(F.col(name).cast("string"))
        whole = text.try_cast("bigint")
        bad = F.raise_error(F.concat(F.lit(f"{name} is not an integer: "), text)).cast("bigint")
        return F.when(text.isNull(), F.lit(None).cast("bigint")).when(whole.isNull(), bad).otherwise(whole)

    return df.withColumns({name: to_id(name) for name in columns})


def normalize_code(df: DataFrame, column: str = "code") -> DataFrame:
    return df.withColumn(column, fx.normalize_code(F.col(column)))


def read_limit(df: DataFrame, max_rows: int | None, order: list | None = None) -> DataFrame:
    """First ``max_rows`` rows; null or negative means all of them."""
    if max_rows is None or max_rows < 0:
        return df
    return (df.orderBy(*order) if order else df).limit(max_rows)


def clean_notes(
    df: DataFrame, category: str | None, min_chars: int = MIN_TEXT_CHARS, columns: list[str] | None = None
) -> DataFrame:
    """Filter → project → normalise → drop short → typed ids; no shuffle."""
    columns = columns or ["note_id", "subject_id", "hadm_id", "text"]
    notes = filter_category(df, category) if category is not None else df
    notes = drop_short(normalize_text(select_required(notes, columns)), min_chars)
    return enforce_types(notes, [c for c in columns if c.endswith("_id")])


def clean_codes(df: DataFrame) -> DataFrame:
    codes = normalize_code(select_required(df, ["hadm_id", "code"]))
    return enforce_types(codes, ["hadm_id"])


def sanitize_path_columns(df: DataFrame, root: str) -> DataFrame:
    """Shorten absolute values in string columns whose name suggests paths."""
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    fixed = {c: px.relative_path(F.col(c), root) for c in df.columns if c in strings and px.is_path_column(c)}
    return df.withColumns(fixed) if fixed else df


def absolute_violations(df: DataFrame, payload: str | None = None, payload_rows: int | None = None) -> DataFrame:
    """One row counting absolute-looking values per path column, or in all payloads (a sample on request)."""
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    counts = [
        F.count_if(px.looks_absolute(F.col(c))).alias(c)
        for c in df.columns
        if c in strings and px.is_path_column(c)
    ]
    if payload is None:
        return df.agg(*counts) if counts else df.sparkSession.range(1).select(F.lit(0).alias("none"))
    text = F.lower(fx.strip(F.col(payload).cast("string")))
    head = df if payload_rows is None else df.limit(payload_rows)
    return head.agg(F.count_if(text.rlike("(?s)" + px.ABSOLUTE_PAYLOAD)).alias(payload))


def assert_no_absolute(df: DataFrame, payload: str | None = None, payload_rows: int | None = None) -> None:
    """Fail when absolute paths are left; returns nothing when all is well."""
    checks = [absolute_violations(df)]
    if payload is not None:
        checks.append(absolute_violations(df, payload, payload_rows))
    for check in checks:
        bad = {k: v for k, v in check.first().asDict().items() if v}
        if bad:
            raise DataCheckError(f"absolute paths left in {sorted(bad)}")


def sanitize_json_paths(df: DataFrame, column: str, root: str) -> DataFrame:
    """Shorten absolute strings anywhere inside a nested array/struct/map column."""
    from pyspark.sql import types as T

    def fix(value, dtype):
        if isinstance(dtype, T.StringType):
            return px.relative_path(value, root)
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda v: fix(v, dtype.elementType))
        if isinstance(dtype, T.MapType):
            return F.transform_values(value, lambda _, v: fix(v, dtype.valueType))
        if isinstance(dtype, T.StructType):
            rebuilt = F.struct(*[fix(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(value.isNotNull(), rebuilt)
        return value

    return df.withColumn(column, fix(F.col(column), df.schema[column].dataType))


def invariant_violations(
    df: DataFrame, unique_key: str | None = "hadm_id", text: str = "text", labels: str = "labels"
) -> DataFrame:
    """One row of violation counts for a merged table (all zero = sound).

    The key check counts rows per key first, so a hot key is one partially
    aggregated group and never a list. Later parts of a text carry no labels.
    """
    first_part = F.col("part") == 0 if "part" in df.columns else F.lit(True)
    base = df.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("empty_table"),
        F.count_if(F.coalesce(F.length(text), F.lit(0)) < 1).alias("empty_texts"),
        F.count_if((F.coalesce(F.size(labels), F.lit(0)) < 1) & first_part).alias("empty_label_lists"),
    )
    if unique_key is None:
        return base.withColumn("duplicate_keys", F.lit(0).cast("bigint"))
    dup = df.groupBy(unique_key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
    return base.withColumn("duplicate_keys", dup.scalar())


def check_invariants(df: DataFrame, unique_key: str | None = "hadm_id") -> None:
    """Raise when a merged table breaks its contract."""
    require_columns(df, ["subject_id", "hadm_id", "text", "labels"])
    bad = {k: v for k, v in invariant_violations(df, unique_key).first().asDict().items() if v}
    if bad:
        raise DataCheckError(f"merged table is not sound: {bad}")
