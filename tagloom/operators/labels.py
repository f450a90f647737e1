"""Label frequencies, label space, encoding, counts and divergence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.cleaning import normalize_label_list, strip
from tagloom.operators.cleaning import DataCheckError
from tagloom.operators.rank import global_rank
from tagloom.session import bounded_dict, broadcast_if_small

# Report sizes and defaults of the label-space step.
COVERAGE_GRID = [50, 100, 200, 400, 600, 800, 1000]
MIN_COVERAGE = 0.70
UNKNOWN_REPORT_ROWS = 50
POS_WEIGHT_LOW, POS_WEIGHT_HIGH = 1.0, 12.0
JSD_EPS = 1e-12
SPLITS = ("train", "val", "test")


def _exploded(df: DataFrame, labels: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(labels).alias("code")).filter(F.col("code").isNotNull())


# --- Frequencies and the label space -----------------------------------------


def label_counts_by_code(df: DataFrame, labels: str = "labels", remove_dots: bool = True) -> DataFrame:
    """Rows per code; dots removed on request, empty codes dropped."""
    code = strip(F.col("code"))
    if remove_dots:
        code = F.replace(code, F.lit("."), F.lit(""))
    return (
        _exploded(df, labels).select(code.alias("code")).filter("code <> ''")
        .groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    )


def label_frequency(df: DataFrame, top_k: int | None = None, labels: str = "labels") -> DataFrame:
    """code, n, pct = n / all labels; most frequent first.

    The denominator is a scalar subquery over the same aggregate, whose
    exchange Spark reuses; a top-k report is a take-ordered, not a full sort.
    """
    counts = _exploded(df, labels).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    freq = counts.select("code", "n", (F.col("n") / total).alias("pct")).orderBy(F.desc("n"), "code")
    return freq if top_k is None else freq.limit(top_k)


def train_label_frequency(train: DataFrame, labels: str = "labels") -> DataFrame:
    """Counts on the train split, codes stripped and upper-cased, none empty."""
    code = F.upper(strip(F.col("code")))
    return (
        _exploded(train, labels).select(code.alias("code")).filter("code <> ''")
        .groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    )


def saved_label_frequency(table: DataFrame, code: str = "code", count: str = "count") -> DataFrame:
    """Fallback: a stored frequency table; a count that is no number is 0."""
    n = F.coalesce(strip(F.col(count).cast("string")).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))
    return table.select(F.upper(strip(F.col(code).cast("string"))).alias("code"), n.alias("n")).filter("code <> ''")


def coverage_curve(freq: DataFrame) -> DataFrame:
    """rank, cumulative count and coverage over (n desc, code asc).

    Runs as a distributed rank, so a long tail of equal counts is no problem.
    """
    order = [F.desc("n"), F.asc("code")]
    ranked = global_rank(freq.select("code", "n"), order, running={"n": "cum_n"}, totals={"n": "total_n"})
    share = F.when(F.col("total_n") > 0, F.col("cum_n") / F.col("total_n")).otherwise(F.lit(0.0))
    return ranked.withColumn("coverage", share).drop("total_n")


def select_codes_fixed_k(curve: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be at least 1")
    return curve.filter(F.col("rank") <= k)


def select_codes_target_coverage(curve: DataFrame, target: float, at_least: int | None = None) -> DataFrame:
    """Smallest prefix whose cumulative count reaches ``target`` of the total.

    ``at_least`` raises the size; a target no prefix reaches keeps every code.
    """
    if not 0.0 <= target <= 1.0:
        raise ValueError("target must lie in [0, 1]")
    needed = F.lit(target) * curve.agg(F.max("cum_n")).scalar()
    reached = F.min(F.when(F.col("cum_n") >= needed, F.col("rank")))
    k = curve.agg(F.coalesce(reached, F.max("rank"))).scalar()
    size = F.greatest(k, F.lit(at_least or 1).cast("bigint"))
    return curve.filter(F.col("rank") <= size)


def build_label_map(selected: DataFrame, strict: bool = False, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Selected codes → contiguous idx in frequency order.

    ``strict`` fails when the selected codes cover less than ``min_coverage``.
    """
    if strict:
        reached = selected.agg(F.max("coverage")).first()[0]
        if reached is None or reached < min_coverage:
            raise DataCheckError(f"label coverage {reached} is below {min_coverage}")
    return selected.select("code", (F.col("rank") - 1).cast("int").alias("idx"))


def coverage_grid(curve: DataFrame, k_effective: int, grid: list[int] | None = None) -> DataFrame:
    """Coverage at a few sizes; a size beyond the table uses the whole table."""
    sizes = sorted({*(COVERAGE_GRID if grid is None else grid), k_effective})
    n = curve.agg(F.max("rank")).scalar()
    wanted = curve.sparkSession.createDataFrame([(k,) for k in sizes], "k int")
    at = wanted.select("k", F.least(F.col("k").cast("bigint"), n).alias("rank"))
    return curve.select("rank", "coverage").join(F.broadcast(at), "rank").select("k", F.col("rank").alias("k_used"), "coverage")


# --- Encoding -----------------------------------------------------------------


def lookup_label_idx(df: DataFrame, label_map: DataFrame, key: str, labels: str = "labels") -> DataFrame:
    """key, normalised code, idx (null = unknown), one row per label occurrence.

    Only the key and the labels travel; the label map is broadcast after its
    size has been checked.
    """
    clean = df.select(key, F.explode(normalize_label_list(F.col(labels))).alias("code"))
    return clean.join(broadcast_if_small(label_map), "code", "left").select(key, "code", "idx")


def encode_labels(df: DataFrame, label_map: DataFrame, key: str = "hadm_id", labels: str = "labels") -> DataFrame:
    """Replace labels by sorted distinct known indices; rows without any keep ``[]``.

    The lookup stays inside the row: no key is needed, rows that share one or
    have none keep their own labels, and nothing is shuffled.
    """
    index = bounded_dict(label_map, "code", "idx")

    @F.pandas_udf("array<int>")
    def known(codes: pd.Series) -> pd.Series:
        get = index.get
        return pd.Series([[] if c is None else sorted({i for i in map(get, c) if i is not None}) for c in codes], dtype=object)

    kept = [c for c in df.columns if c != labels]
    return df.select(*kept, known(normalize_label_list(F.col(labels))).alias("labels_idx"))


def unknown_codes_top(looked_up: DataFrame, n: int = UNKNOWN_REPORT_ROWS) -> DataFrame:
    return (
        looked_up.filter("idx is null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "code").limit(n)
    )


def multi_hot(df: DataFrame, n_labels: int, key: str = "hadm_id", idx: str = "labels_idx") -> DataFrame:
    """Sparse 0/1 matrix as (key, idx) rows; an index outside [0, K) raises."""
    cells = df.select(key, F.explode(F.array_distinct(idx)).alias("idx"))
    outside = (F.col("idx") < 0) | (F.col("idx") >= n_labels)
    message = F.concat(F.lit("label index out of range: "), F.col("idx").cast("string"))
    return cells.select(key, F.when(outside, F.raise_error(message).cast("int")).otherwise(F.col("idx")).alias("idx"))


def multi_hot_dense(df: DataFrame, n_labels: int, idx: str = "labels_idx", name: str = "y") -> DataFrame:
    """Row-local dense 0/1 array of length K."""
    slots = F.sequence(F.lit(0), F.lit(n_labels - 1))
    return df.withColumn(name, F.transform(slots, lambda i: F.array_contains(idx, i).cast("tinyint")))


def check_multi_hot(df: DataFrame, idx: str = "labels_idx") -> None:
    if df.filter(F.size(idx) > 0).isEmpty():
        raise DataCheckError("label matrix has no positive cell")


def encoding_stats(encoded: DataFrame, looked_up: DataFrame, n_labels: int, idx: str = "labels_idx") -> DataFrame:
    """N, K, nnz, density, labels per row, share of unknown code occurrences."""
    known, unknown = F.col("nnz"), looked_up.agg(F.count_if(F.col("idx").isNull())).scalar()
    cells = F.col("n_rows") * F.lit(n_labels)
    return (
        encoded.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.size(idx)), F.lit(0)).alias("nnz"))
        .withColumn("n_labels", F.lit(n_labels))
        .withColumn("density", F.when(cells > 0, F.col("nnz") / cells).otherwise(F.lit(0.0)))
        .withColumn("labels_per_row", F.when(F.col("n_rows") > 0, F.col("nnz") / F.col("n_rows")).otherwise(F.lit(0.0)))
        .withColumn("unknown", unknown)
        .withColumn(
            "unknown_rate",
            F.when(known + unknown > 0, unknown / (known + unknown)).otherwise(F.lit(0.0)),
        )
    )


def encoding_samples(encoded: DataFrame, n: int = 3, key: str = "hadm_id", keep: list[str] | None = None) -> DataFrame:
    """Up to ``n`` rows at evenly spaced positions (ids and indices, no text)."""
    keep = keep or ["subject_id", "hadm_id", "labels_idx"]
    ranked = global_rank(encoded.select(*dict.fromkeys([key, *keep])), [F.asc(key)], rank="position", total="__n")
    spaced = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(n).cast("bigint"), F.col("__n")) - 1),
        lambda i: F.floor(i * (F.col("__n") - 1) / F.greatest(F.least(F.lit(n).cast("bigint"), F.col("__n")) - 1, F.lit(1))) + 1,
    )
    return ranked.filter(F.array_contains(spaced, F.col("position"))).select("position", *keep)


# --- Counts, divergence, reports ---------------------------------------------


def subject_label_union(encoded: DataFrame, n_labels: int | None = None, subject: str = "subject_id") -> DataFrame:
    """Sorted union of label indices per subject; subjects without labels stay.

    Pairs are made distinct before the list is built, so a hot subject is
    spread over its labels and its list is bounded by K.
    """
    pairs = encoded.select(subject, F.explode_outer("labels_idx").alias("idx")).distinct()
    if n_labels is not None:
        outside = (F.col("idx") < 0) | (F.col("idx") >= n_labels)
        pairs = pairs.withColumn("idx", F.when(outside, F.raise_error(F.lit("label index out of range")).cast("int")).otherwise(F.col("idx")))
    return pairs.groupBy(subject).agg(F.array_sort(F.collect_list("idx")).alias("labels_idx"))


def label_counts(encoded: DataFrame, label_map: DataFrame, idx: str = "labels_idx") -> DataFrame:
    """Rows per label index, zero for absent labels, out-of-range ignored."""
    counts = encoded.select(F.explode(F.array_distinct(idx)).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return label_map.select("idx").join(counts, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"))


def align_counts(a: DataFrame, b: DataFrame, key: str = "code", count: str = "n") -> DataFrame:
    """Full alignment of two count tables; a missing count is 0."""
    left = a.select(key, F.col(count).alias("__a"))
    right = b.select(key, F.col(count).alias("__b"))
    return left.join(right, key, "full_outer").select(
        key, F.coalesce("__a", F.lit(0)).alias("n_a"), F.coalesce("__b", F.lit(0)).alias("n_b")
    )


def jsd_term(p: Column, q: Column, eps: float = JSD_EPS) -> Column:
    """One label's share of the Jensen-Shannon divergence (natural log)."""
    m = (p + q) / 2
    e = F.lit(eps)
    return (p * F.ln((p + e) / (m + e)) + q * F.ln((q + e) / (m + e))) / 2


def js_divergence(aligned: DataFrame, eps: float = JSD_EPS) -> DataFrame:
    """Divergence of the two aligned count columns, one row."""
    totals = aligned.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"))
    floor = F.lit(eps)
    p = F.col("n_a") / F.greatest(totals.select("a").scalar(), floor)
    q = F.col("n_b") / F.greatest(totals.select("b").scalar(), floor)
    return aligned.agg(F.coalesce(F.sum(jsd_term(p, q, eps)), F.lit(0.0)).alias("jsd"))


def dataset_report(df: DataFrame, text: str = "text", labels: str = "labels") -> DataFrame:
    """Sizes of the merged table, one row."""
    words = F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))
    sized = df.select(
        "subject_id", "hadm_id", F.length(text).alias("chars"), words.alias("words"), F.size(labels).alias("n_labels")
    )
    return sized.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("subject_id").alias("n_subjects"),
        F.countDistinct("hadm_id").alias("n_admissions"),
        F.avg("chars").alias("mean_chars"),
        F.median("chars").alias("median_chars"),
        F.avg("words").alias("mean_words"),
        F.median("words").alias("median_words"),
        F.min("n_labels").alias("min_labels"),
        F.avg("n_labels").alias("mean_labels"),
        F.max("n_labels").alias("max_labels"),
    )


def category_counts(notes: DataFrame, column: str = "category") -> DataFrame:
    return notes.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def codes_per_admission(codes: DataFrame) -> DataFrame:
    """Distinct admissions and codes, mean and median codes per admission."""
    per = codes.groupBy("hadm_id").agg(F.count("code").alias("n"))
    stats = per.agg(
        F.count(F.lit(1)).alias("n_admissions"), F.avg("n").alias("mean_codes"), F.median("n").alias("median_codes")
    )
    distinct = codes.select("code").dropna().distinct().agg(F.count(F.lit(1)))
    return stats.withColumn("n_codes", distinct.scalar())


def labels_per_note_hist(encoded: DataFrame, idx: str = "labels_idx") -> DataFrame:
    """Rows per number of labels, every size from 0 to the maximum."""
    hist = encoded.groupBy(F.size(idx).alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))
    bins = hist.agg(F.max("n_labels").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("n_labels"))
    return bins.join(hist, "n_labels", "left").select("n_labels", F.coalesce("n", F.lit(0)).alias("n"))


def longtail_curve(counts: DataFrame) -> DataFrame:
    """Label counts, largest first, with their rank."""
    return global_rank(counts.select("idx", "n"), [F.desc("n"), F.asc("idx")])


def longtail_stats(encoded: DataFrame, n_labels: int, idx: str = "labels_idx") -> DataFrame:
    cells = F.count(F.lit(1)) * n_labels
    return encoded.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_labels).alias("n_labels"),
        F.when(cells > 0, F.sum(F.size(idx)) / cells).otherwise(F.lit(0.0)).alias("density"),
    )


def pos_weight(
    encoded: DataFrame,
    label_map: DataFrame,
    option: str | list[float] | None = "balanced",
    low: float = POS_WEIGHT_LOW,
    high: float = POS_WEIGHT_HIGH,
) -> DataFrame | None:
    """Per-label positive weight (N − pos) / max(pos, 1), clipped to [low, high]."""
    if option is None or (isinstance(option, str) and option.strip().lower() in {"", "none", "null", "false"}):
        return None
    if not isinstance(option, str):
        given = encoded.sparkSession.createDataFrame(list(enumerate(map(float, option))), "idx int, w double")
        if len(option) != label_map.count():
            raise ValueError("weight vector length differs from the label map")
        return given.select("idx", F.col("w").cast("float").alias("pos_weight"))
    if option.strip().lower() != "balanced":
        raise ValueError(f"unknown weight option: {option}")
    n = encoded.agg(F.count(F.lit(1))).scalar()
    ratio = (n - F.col("n")) / F.greatest(F.col("n"), F.lit(1))
    clipped = F.least(F.greatest(ratio, F.lit(low)), F.lit(high)).cast("float")
    return label_counts(encoded, label_map).select("idx", clipped.alias("pos_weight"))


def split_manifest(encoded: DataFrame, split: str = "split", splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Rows, subjects, admissions and divergence from the whole, per split."""
    sizes = encoded.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("subject_id").alias("n_subjects"),
        F.countDistinct("hadm_id").alias("n_admissions"),
    )
    return sizes.join(split_divergence(encoded, split, splits=splits), split, "left")


def split_divergence(
    rows: DataFrame,
    split: str = "split",
    group: tuple[str, ...] = (),
    splits: tuple[str, ...] = SPLITS,
    eps: float = JSD_EPS,
) -> DataFrame:
    """JSD of every split's label counts against all splits of the same group.

    ``rows`` has ``labels_idx``; after the counts only K × splits rows are left.
    """
    counts = (
        rows.select(*group, split, F.explode("labels_idx").alias("idx")).groupBy(*group, split, "idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = counts.groupBy(*group, "idx").agg(F.sum("n").alias("n_all"))
    cells = whole.withColumn(split, F.explode(F.array(*[F.lit(s) for s in splits])))
    grid = cells.join(counts, [*group, split, "idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*group, split)
    p = F.col("n_all") / F.greatest(F.sum("n_all").over(w), F.lit(eps))
    q = F.col("n") / F.greatest(F.sum("n").over(w), F.lit(eps))
    return grid.withColumn("__t", jsd_term(p, q, eps)).groupBy(*group, split).agg(F.sum("__t").alias("jsd"))


def top_labels_preview(encoded: DataFrame, label_map: DataFrame, top_m: int = 20, split: str = "split",
                       splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Most frequent labels with one count column per split."""
    cells = encoded.select(split, F.explode("labels_idx").alias("idx"))
    per = [F.count_if(F.col(split) == s).alias(s) for s in splits]
    counts = cells.groupBy("idx").agg(F.count(F.lit(1)).alias("n_all"), *per)
    filled = label_map.join(counts, "idx", "left").fillna(0, ["n_all", *splits])
    return filled.select("idx", "code", "n_all", *splits).orderBy(F.desc("n_all"), "idx").limit(top_m)


def mini_density(df: DataFrame, labels: str = "labels", split: str | None = None) -> DataFrame:
    """Mean and median labels per row."""
    aggs = [F.avg(F.size(labels)).alias("mean_labels"), F.median(F.size(labels)).alias("median_labels")]
    return df.groupBy(split).agg(*aggs) if split else df.agg(*aggs)
