"""Thresholds and multi-label metrics.

Scored rows carry ``labels_idx ARRAY<INT>`` (true labels) and
``scores ARRAY<FLOAT>`` of length K, so truth and score never have to be
aligned by position. Per-label work explodes a row once and is counted
map-side: what is shuffled has K × grid rows per task, whatever the number of
documents and however frequent a label is.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.cleaning import DataCheckError

# Threshold grid 0.05, 0.10, ... 0.95 and report defaults.
GRID = [round(0.05 * i, 2) for i in range(1, 20)]
DEFAULT_TAU = 0.5
PRECISION_AT = (8, 15)
MIN_POSITIVES_TUNE = 5
MIN_POSITIVES_EVALUATE = 10

# Labels whose scores are aggregated side by side in one row.
SCORE_BLOCK = 64


def _float(value) -> Column:
    return F.lit(value).cast("float") if not isinstance(value, Column) else value.cast("float")


def _tau_array(taus: DataFrame, missing: float) -> Column:
    """(idx, tau) table as one array whose place i holds label i's threshold (scalar subquery)."""
    every = taus.agg(F.max("idx").alias("last")).select(F.explode(F.sequence(F.lit(0), "last")).alias("idx"))
    full = every.join(taus.select("idx", F.col("tau").cast("float").alias("tau")), "idx", "left")
    packed = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("tau", _float(missing)).alias("tau"))))
    return full.agg(F.transform(packed, lambda e: e["tau"])).scalar()


# --- Validation ---------------------------------------------------------------


def score_violations(scored: DataFrame, n_labels: int) -> DataFrame:
    """One row of violation counts: shape, label range, score finiteness and range."""
    bad_label = F.exists("labels_idx", lambda i: (i < 0) | (i >= n_labels))
    bad_score = F.exists("scores", lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s > 1))
    return scored.agg(
        F.count_if(F.coalesce(F.size("scores"), F.lit(-1)) != n_labels).alias("bad_length"),
        F.count_if(F.coalesce(bad_label, F.lit(True))).alias("bad_labels"),
        F.count_if(F.coalesce(bad_score, F.lit(True))).alias("bad_scores"),
    )


def validate_scores(scored: DataFrame, n_labels: int) -> None:
    bad = {k: v for k, v in score_violations(scored, n_labels).first().asDict().items() if v}
    if bad:
        raise DataCheckError(f"scored rows are not sound: {bad}")


# --- Thresholds ---------------------------------------------------------------


def apply_thresholds(scored: DataFrame, tau: float | DataFrame, name: str = "pred_idx", missing: float = DEFAULT_TAU) -> DataFrame:
    """Predicted label indices: ``score >= tau`` compared as FLOAT.

    ``tau`` is one number or a per-label (idx, tau) table, addressed by idx;
    labels it lacks are held against ``missing``. Row-local.
    """
    if isinstance(tau, DataFrame):
        scored = scored.withColumn("__taus", _tau_array(tau, missing))
        cells = F.transform("scores", lambda s, i: s >= F.coalesce(F.get("__taus", i), _float(missing)))
    else:
        cells = F.transform("scores", lambda s: s >= _float(float(tau)))
    hits = F.filter(F.transform(cells, lambda hit, i: F.when(hit, i)), lambda i: i.isNotNull())
    return scored.withColumn(name, hits).drop("__taus")


def join_thresholds(long_scores: DataFrame, taus: DataFrame, missing: float = DEFAULT_TAU) -> DataFrame:
    """Long-form scores (.., idx, score) with their label's threshold, else ``missing``, and decision."""
    return long_scores.join(taus.select("idx", "tau"), "idx", "left").withColumn("tau", F.coalesce("tau", F.lit(missing))).withColumn(
        "pred", (F.col("score").cast("float") >= F.col("tau").cast("float")).cast("int")
    )


def long_form(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, idx, y, score) with one row per label.

    The outer form avoids an inferred filter that would compute the scores twice.
    """
    exploded = scored.select(*keys, "labels_idx", F.posexplode_outer("scores").alias("idx", "score"))
    flat = exploded.filter(F.col("idx").isNotNull())
    return flat.select(*keys, "idx", F.array_contains("labels_idx", F.col("idx")).cast("int").alias("y"), "score")


# --- Confusion counts and F1 --------------------------------------------------


def confusion_by_label(predicted: DataFrame, label_map: DataFrame, pred: str = "pred_idx") -> DataFrame:
    """TP, FP, FN per label; labels nobody has or gets stay with zeros.

    Only true or predicted labels are exploded, so a row costs its own labels
    and not K cells.
    """
    either = F.array_union("labels_idx", F.col(pred).cast("array<int>"))
    cells = predicted.select("labels_idx", pred, F.explode(either).alias("idx")).select(
        "idx", F.array_contains("labels_idx", F.col("idx")).alias("y"), F.array_contains(pred, F.col("idx")).alias("p")
    )
    counts = cells.groupBy("idx").agg(
        F.count_if(F.col("y") & F.col("p")).alias("tp"),
        F.count_if(~F.col("y") & F.col("p")).alias("fp"),
        F.count_if(F.col("y") & ~F.col("p")).alias("fn"),
    )
    return label_map.select("idx").join(counts, "idx", "left").fillna(0, ["tp", "fp", "fn"])


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 TP / (2 TP + FP + FN), 0 where undefined."""
    denominator = 2 * tp + fp + fn
    return F.when(denominator > 0, 2 * tp / denominator).otherwise(F.lit(0.0))


def f1_micro_macro(confusion: DataFrame) -> DataFrame:
    return confusion.agg(
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"),
    )


# --- Precision at k -----------------------------------------------------------


def _best_hits(most: int) -> Column:
    """1 or 0 for each of the ``most`` best labels: whether it is a true one."""
    ranked = F.sort_array(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, most), lambda e: F.array_contains("labels_idx", e["i"]).cast("int"))


def precision_at_k(scored: DataFrame, ks: tuple[int, ...] = PRECISION_AT) -> DataFrame:
    """Mean over all rows of hits in the min(k, K) best labels, one column per k.

    Ties go to the lower index; rows without labels count as 0. Row-local; the
    scores are sorted once for all k.
    """
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")

    def at(hits: Column, k: int) -> Column:
        return F.aggregate(F.slice(hits, 1, k), F.lit(0), lambda a, x: a + x) / F.least(F.lit(k), F.size("scores"))

    every = F.transform(F.array(_best_hits(max(ks))), lambda hits: F.struct(*[at(hits, k).alias(f"p{k}") for k in ks]))[0]
    return scored.select(every.alias("__at")).agg(*[F.avg(f"__at.p{k}").alias(f"p_at_{k}") for k in ks])


# --- Tuning -------------------------------------------------------------------


def grid_confusion(scored: DataFrame, label_map: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """(idx, g, tau, tp, fp, fn) for every label and every grid value.

    Each score falls into the bin "number of grid values ≤ score"; the binned
    counts (K × grid × 2 rows) are then spread to all smaller grid values.
    One pass over the scores, whatever the grid.
    """
    grid = GRID if grid is None else sorted(grid)
    long = long_form(scored)
    bin_of = reduce(add, [(F.col("score") >= _float(g)).cast("int") for g in grid])
    binned = long.groupBy("idx", bin_of.alias("bin"), "y").agg(F.count(F.lit(1)).alias("n"))
    positives = binned.groupBy("idx").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"))
    reached = (
        binned.filter("bin > 0").select("idx", "y", "n", F.explode(F.sequence(F.lit(1), F.col("bin"))).alias("g"))
        .groupBy("idx", "g")
        .agg(
            F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("fp"),
        )
    )
    points = F.array(*[F.struct(F.lit(i + 1).alias("g"), _float(g).alias("tau")) for i, g in enumerate(grid)])
    cells = label_map.select("idx", F.explode(points).alias("p")).select("idx", "p.g", "p.tau")
    full = cells.join(reached, ["idx", "g"], "left").join(positives, "idx", "left").fillna(0, ["tp", "fp", "pos"])
    return full.select("idx", "g", "tau", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"))


def global_threshold_scores(points: DataFrame) -> DataFrame:
    """micro and macro F1 per grid value."""
    return points.groupBy("g", "tau").agg(
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"),
    )


def tune_global_threshold(
    scored: DataFrame, label_map: DataFrame, grid: list[float] | None = None, digits: int = 12
) -> DataFrame:
    """Grid value with the best (micro, macro); the first best one wins.

    The macro average is compared after rounding to ``digits``, so that the
    order in which partitions are summed cannot decide a tie.
    """
    scores = global_threshold_scores(grid_confusion(scored, label_map, grid))
    return scores.orderBy(F.desc(F.round("micro_f1", digits)), F.desc(F.round("macro_f1", digits)), "g").limit(1).select(
        "tau", "micro_f1", "macro_f1"
    )


def tune_label_thresholds(
    scored: DataFrame,
    label_map: DataFrame,
    base_tau: float = DEFAULT_TAU,
    min_pos: int = MIN_POSITIVES_TUNE,
    grid: list[float] | None = None,
) -> DataFrame:
    """(idx, tau): best F1 per label; labels with few positives keep ``base_tau``."""
    points = grid_confusion(scored, label_map, grid).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    best = points.groupBy("idx").agg(
        F.max_by("tau", F.struct("f1", -F.col("g"))).alias("tau"), F.first(F.col("tp") + F.col("fn")).alias("pos")
    )
    return best.select("idx", F.when(F.col("pos") < min_pos, _float(base_tau)).otherwise(F.col("tau")).alias("tau"))


# --- Evaluation ---------------------------------------------------------------


def evaluate_probs(
    scored: DataFrame, label_map: DataFrame, tau: float | DataFrame = DEFAULT_TAU, ks: tuple[int, ...] = PRECISION_AT
) -> DataFrame:
    """micro/macro F1 at ``tau`` and precision at each k, one row."""
    f1s = f1_micro_macro(confusion_by_label(apply_thresholds(scored, tau), label_map))
    precision = precision_at_k(scored, ks)
    for k in ks:
        f1s = f1s.withColumn(f"p_at_{k}", precision.select(f"p_at_{k}").scalar())
    return f1s


# --- Chunk scores -------------------------------------------------------------


def aggregate_chunk_scores(chunks: DataFrame, key: str = "hadm_id", how: str = "max", width: int = SCORE_BLOCK) -> DataFrame:
    """Document scores from chunk scores, per label max or mean.

    Lists are cut into blocks of ``width`` labels whose places are aggregated
    side by side and map-side: what is shuffled has one row per document, block
    and task, however many chunks a document has, and no row per label. Null
    scores do not count; a shorter list has no say on the labels it lacks;
    documents whose lists are all empty or null are left out.
    """
    if how not in {"max", "mean"}:
        raise ValueError(f"unknown aggregation: {how}")

    def combine(place: str) -> Column:
        return F.max(place) if how == "max" else F.avg(F.col(place).cast("double")).cast("float")

    numbers = F.sequence(F.lit(0), F.floor((F.size("scores") - 1) / F.lit(width)).cast("int"))
    blocks = F.transform(numbers, lambda b: F.struct(b.alias("block"), F.slice("scores", b * width + 1, width).alias("part")))
    cut = chunks.filter(F.size("scores") > 0).select(key, F.explode(blocks).alias("__b")).select(
        key, F.col("__b.block").alias("__block"), F.col("__b.part").alias("__part"))
    places = [f"__s{i}" for i in range(width)]
    flat = cut.select(key, "__block", F.size("__part").alias("__n"), *[F.get("__part", F.lit(i)).alias(p) for i, p in enumerate(places)])
    combined = flat.groupBy(key, "__block").agg(F.max("__n").alias("__n"), *[combine(p).alias(p) for p in places])
    part = F.slice(F.array(*places), F.lit(1), F.col("__n"))
    packed = F.array_sort(F.collect_list(F.struct("__block", part.alias("part"))))
    return combined.groupBy(key).agg(F.flatten(F.transform(packed, lambda e: e["part"])).alias("scores"))


def broadcast_doc_labels(chunks: DataFrame, docs: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Chunk rows with the labels of their document."""
    return chunks.join(docs.select(key, "labels_idx"), key)


# --- Metrics tables -----------------------------------------------------------


def last_run_per_name(
    metrics: DataFrame, split: str, names: list[str] | None = None, order: str = "seq", check: bool = False
) -> DataFrame:
    """Last appended row per run of one split, in the requested order of names."""
    picked = metrics.filter(F.col("split") == split)
    if names is not None:
        picked = picked.filter(F.col("run_name").isin(names))
    rest = [c for c in metrics.columns if c != "run_name"]
    last = picked.groupBy("run_name").agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row")).select("run_name", "__row.*")
    if names is None:
        return last.orderBy("run_name")
    if check:
        found = {r[0] for r in last.select("run_name").collect()}
        if found != set(names):
            raise DataCheckError(f"runs without metrics: {sorted(set(names) - found)}")
    return last.orderBy(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("run_name")))


def case_type(y: Column, p: Column) -> Column:
    return (
        F.when((y == 1) & (p == 1), "TP").when((y == 0) & (p == 1), "FP").when((y == 1) & (p == 0), "FN").otherwise("TN")
    )
