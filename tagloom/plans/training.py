"""Fit the linear model on the train split, evaluate val, then test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators import features, model
from tagloom.plans.dataset import prepare_split
from tagloom.plans.evaluation import evaluate_and_save
from tagloom.session import store_table


def train_linear(
    splits: dict[str, DataFrame],
    label_map: DataFrame,
    path: str,
    run_name: str = "tfidf_lr",
    config: features.TfidfConfig = features.TfidfConfig(),
    policy: str = "per_label_val",
    key: str = "hadm_id",
    min_pos: int = 10,
    **fit_options,
) -> dict[str, DataFrame]:
    """``splits`` hold key, text, labels_idx. Returns a metrics row per evaluated split."""
    tfidf, vectors = features.fit_transform_splits(splits, key, config)
    joined = {name: store_table(v.join(splits[name].select(key, "labels_idx"), key)) for name, v in vectors.items()}
    fitted = model.fit_ovr_logreg(joined["train"], label_map, tfidf.n_features, **fit_options)
    features.save_features(tfidf, f"{path}/{run_name}/features")
    model.save_model(fitted, f"{path}/{run_name}/model")
    out = {}
    for name in ("val", "test"):
        if name not in joined:
            continue
        scored = store_table(fitted.predict(joined[name], key).join(joined[name].select(key, "labels_idx"), key))
        chosen = policy if name == "val" else ("fixed" if policy == "fixed" else "use_saved")
        out[name] = evaluate_and_save(
            scored, label_map, run_name, name, f"{path}/{run_name}/thresholds", f"{path}/metrics", chosen, min_pos=min_pos
        )
    return out


def load_run(spark: SparkSession, path: str, run_name: str) -> tuple[features.TfidfModel, model.OvrModel]:
    return features.load_features(spark, f"{path}/{run_name}/features"), model.load_model(spark, f"{path}/{run_name}/model")


def train_from_files(spark: SparkSession, paths: dict[str, str], label_map: DataFrame, out: str, **options) -> dict[str, DataFrame]:
    """The same from split files."""
    return train_linear({name: prepare_split(spark, p, label_map) for name, p in paths.items()}, label_map, out, **options)
