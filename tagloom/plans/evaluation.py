"""Threshold policies and evaluation, as one composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import metrics
from tagloom.session import cut_lineage, store_table
from tagloom.sources.readers import load_thresholds
from tagloom.sources.writers import append_metrics, save_thresholds, write_doc_predictions

# Policies and splits the evaluation knows.
POLICIES = ("fixed", "global_val", "per_label_val", "use_saved")
EVALUATED_SPLITS = ("val", "test")


def evaluate_and_save(
    scored: DataFrame,
    label_map: DataFrame,
    run_name: str,
    split: str,
    thresholds_path: str,
    metrics_path: str | None = None,
    policy: str = "fixed",
    tau: float = metrics.DEFAULT_TAU,
    min_pos: int = metrics.MIN_POSITIVES_EVALUATE,
    ks: tuple[int, int] = metrics.PRECISION_AT,
) -> DataFrame:
    """Pick thresholds by policy, evaluate, append the metrics row, return it.

    Tuning happens on val only and is saved; test reads what was saved; any
    other pairing falls back to the fixed threshold and says so.
    """
    split, policy = split.strip().lower(), policy.strip().lower()
    if split not in EVALUATED_SPLITS or policy not in POLICIES:
        raise ValueError(f"cannot evaluate split {split!r} with policy {policy!r}")
    spark = scored.sparkSession
    k = label_map.count()
    metrics.validate_scores(scored, k)
    used: float | DataFrame = float(tau)
    kind, notes = "fixed", f"t={tau:.2f}"
    if split == "val" and policy in {"global_val", "per_label_val"}:
        base = float(metrics.tune_global_threshold(scored, label_map).first()["tau"])
        if policy == "global_val":
            used, kind, notes = base, "global", f"t={base:.2f}"
        else:
            used = cut_lineage(metrics.tune_label_thresholds(scored, label_map, base, min_pos))
            kind, notes = "per_label", f"base={base:.2f} tuned=1D"
        save_thresholds(spark, used, thresholds_path, kind)
    elif split == "test" and policy == "use_saved":
        kind, used = load_thresholds(spark, thresholds_path)
        notes = "loaded"
    elif policy != "fixed":
        notes += " [fallback]"
    result = metrics.evaluate_probs(scored, label_map, used, ks)
    row = result.select(
        F.lit(run_name).alias("run_name"), F.lit(split).alias("split"), F.lit(scored.count()).alias("N"), F.lit(k).alias("K"),
        "micro_f1", "macro_f1", *[F.col(f"p_at_{n}") for n in ks],
        F.lit(kind).alias("thr_kind"), F.lit(policy).alias("thr_policy"), F.lit(notes).alias("thr_notes"),
    )
    row = cut_lineage(row)
    if metrics_path is not None:
        append_metrics(row, metrics_path)
    return row


def evaluate_chunked(
    chunk_scores: DataFrame, docs: DataFrame, label_map: DataFrame, run_name: str, split: str, thresholds_path: str,
    metrics_path: str | None = None, predictions_path: str | None = None, how: str = "max", policy: str = "fixed",
    key: str = "hadm_id", **options,
) -> DataFrame:
    """Chunk scores → document scores → evaluation; test uses saved thresholds."""
    scored = metrics.aggregate_chunk_scores(chunk_scores, key, how).join(docs.select(key, "labels_idx"), key)
    scored = store_table(scored)
    if predictions_path is not None:
        write_doc_predictions(scored, predictions_path, label_map.count(), chunk_scores, key)
    policy = "use_saved" if split == "test" else policy
    return evaluate_and_save(scored, label_map, run_name, split, thresholds_path, metrics_path, policy, **options)
