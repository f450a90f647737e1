"""Explain predictions as one distributed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tagloom.operators import explain, features, metrics, model, split
from tagloom.session import cut_lineage, store_table


def explain_split(
    docs: DataFrame, label_map: DataFrame, tfidf: features.TfidfModel, linear: model.OvrModel, tau: float | DataFrame,
    seed=42, n_docs: int | None = None, n_labels: int = explain.LABELS_PER_DOC, key: str = "hadm_id",
    chunk_scores: DataFrame | None = None,
) -> DataFrame:
    """Sample → features → scores → thresholds → candidates → attributions → records.

    ``docs`` has subject_id, the key, text and labels_idx; all of them are
    explained unless ``n_docs`` asks for a seeded sample.
    """
    sample = cut_lineage(split.sample_examples(docs, n_docs, seed, key) if n_docs is not None else docs)
    vectors = store_table(tfidf.transform(sample, key))
    scored = linear.predict(vectors, key).join(sample.select(key, "subject_id", "labels_idx"), key)
    predicted = metrics.apply_thresholds(scored, tau)
    found = cut_lineage(explain.explain_candidates(predicted, ["subject_id", key], n_labels))
    tokens = explain.token_lists(explain.token_attribution(vectors, linear, found, key), tfidf, key)
    best = explain.best_chunk(chunk_scores, found, key) if chunk_scores is not None else None
    return explain.explanation_records(found, tokens, label_map, key, best)
