"""Per-prediction explanations: candidates, best chunk, token attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.cleaning import DataCheckError
from tagloom.operators.features import TfidfModel, long_features
from tagloom.operators.model import OvrModel

# Report sizes and marker tokens of explanations.
LABELS_PER_DOC, EXAMPLES = 3, 50
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]")
CASES = ("TP", "FP", "FN")


def explain_candidates(predicted: DataFrame, keys: list[str], n: int = LABELS_PER_DOC, pred: str = "pred_idx") -> DataFrame:
    """(keys, idx, case_type, score, rank): a row's best TP, FP and FN labels.

    Row-local: best score first, ties by TP, FP, FN, then index.
    """
    y = lambda i: F.array_contains("labels_idx", i)
    p = lambda i: F.array_contains(pred, i)
    case = lambda i: F.when(y(i) & p(i), 0).when(p(i), 1).otherwise(2)
    entries = F.transform(
        F.array_union("labels_idx", F.col(pred).cast("array<int>")),
        lambda i: F.struct((-F.get("scores", i)).alias("neg"), case(i).alias("case"), i.alias("idx")),
    )
    best = predicted.select(*keys, F.posexplode(F.slice(F.array_sort(entries), 1, n)).alias("pos", "e"))
    names = F.array(*[F.lit(c) for c in CASES])
    return best.select(
        *keys, "e.idx", F.get(names, F.col("e.case")).alias("case_type"), (-F.col("e.neg")).alias("score"), (F.col("pos") + 1).alias("rank")
    )


def best_chunk(chunks: DataFrame, targets: DataFrame, key: str = "hadm_id", chunk: str = "chunk_no") -> DataFrame:
    """Chunk with the highest score for each (document, label); first on ties.

    ``max_by`` combines map-side, so a document of very many chunks is no hot spot.
    """
    met = chunks.join(targets.select(key, "idx"), key).select(key, "idx", chunk, F.get("scores", F.col("idx")).alias("__s"))
    best = F.max_by(F.struct(F.col(chunk).alias("best_chunk"), F.col("__s").alias("chunk_score")), F.struct("__s", -F.col(chunk)))
    return met.groupBy(key, "idx").agg(best.alias("__b")).select(key, "idx", "__b.*")


def token_attribution(features: DataFrame, model: OvrModel, targets: DataFrame, key: str) -> DataFrame:
    """(key, idx, feature_id, attribution): |weight × value| for a target label.

    For a linear model and a zero baseline, integrated gradients equal weight
    times feature value, so the attribution is a join.
    """
    pairs = targets.select(key, "idx")
    wanted = long_features(features, key).join(pairs, key)
    return wanted.join(model.weights, ["idx", "feature_id"]).select(
        key, "idx", "feature_id", F.abs(F.col("weight") * F.col("value").cast("double")).alias("attribution")
    )


def token_lists(attributions: DataFrame, tfidf: TfidfModel, key: str) -> DataFrame:
    """(key, idx, tokens, scores): the terms of a document in feature order."""
    named = attributions.join(tfidf.vocab.select("feature_id", "term"), "feature_id")
    packed = F.array_sort(F.collect_list(F.struct("feature_id", "term", "attribution")))
    lists = named.groupBy(key, "idx").agg(packed.alias("__l"))
    return lists.select(
        key, "idx", F.transform("__l", lambda e: e["term"]).alias("tokens"), F.transform("__l", lambda e: e["attribution"]).alias("scores")
    )


def top_tokens(df: DataFrame, k: int, tokens: str = "tokens", scores: str = "scores", specials: tuple[str, ...] = SPECIAL_TOKENS,
               name: str = "top") -> DataFrame:
    """Add the k best (token, score) pairs, special tokens left out; earlier token on ties.

    A row whose lists differ in length fails. ``k`` beyond the list is clipped.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    same = F.size(tokens) == F.size(scores)
    checked = F.when(same, F.col(tokens)).otherwise(F.raise_error(F.lit("tokens and scores differ in length")).cast("array<string>"))
    zipped = F.arrays_zip(checked.alias("token"), F.col(scores).alias("score"))
    special = F.array(*[F.lit(s) for s in specials])
    plain = F.filter(zipped, lambda e: ~F.array_contains(special, e["token"]))
    ranked = F.array_sort(F.transform(plain, lambda e, i: F.struct((-e["score"]).alias("neg"), i.alias("pos"), e["token"].alias("token"))))
    best = F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["token"].alias("token"), (-e["neg"]).alias("score")))
    return df.withColumn(name, best)


def filter_explanations(
    df: DataFrame, example_id: str | None = None, doc: int | None = None, code: str | None = None,
    case: str | None = None, check: bool = False,
) -> DataFrame:
    """By example id, else by document; then by code and case type."""
    if example_id is not None:
        df = df.filter(F.col("example_id") == example_id)
    elif doc is not None:
        df = df.filter(F.col("meta.hadm_id") == doc)
    if code is not None:
        df = df.filter(F.col("meta.code") == code)
    if case is not None:
        df = df.filter(F.col("meta.case_type") == case)
    if check and df.isEmpty():
        raise DataCheckError("no explanation is left after filtering")
    return df


def choose_explanation(df: DataFrame, strategy: str = "first") -> DataFrame:
    """One row: the first by example id, or the one with the highest label probability."""
    if strategy == "first":
        return df.orderBy("example_id").limit(1)
    if strategy == "max_prob":
        return df.orderBy(F.desc("meta.pred_prob"), "example_id").limit(1)
    raise ValueError(f"unknown strategy: {strategy}")


def explanation_records(
    candidates: DataFrame, token_rows: DataFrame, label_map: DataFrame, key: str = "hadm_id", chunks: DataFrame | None = None
) -> DataFrame:
    """Nested explanation rows; the example id is ``subject_admission_label``."""
    rows = candidates.join(label_map, "idx").join(token_rows, [key, "idx"])
    if chunks is not None:
        rows = rows.join(chunks, [key, "idx"], "left")
    else:
        rows = rows.withColumns({"best_chunk": F.lit(None).cast("int"), "chunk_score": F.lit(None).cast("float")})
    meta = F.struct(
        "subject_id", F.col(key).alias("hadm_id"), "case_type", "code",
        (F.col("case_type") != "FP").cast("int").alias("y_true"), (F.col("case_type") != "FN").cast("int").alias("y_pred"),
        F.col("score").alias("pred_prob"), F.col("best_chunk").alias("best_chunk"), F.col("chunk_score").alias("chunk_prob"),
    )
    return rows.select(
        F.concat_ws("_", "subject_id", key, "idx").alias("example_id"), F.col("idx").alias("target_idx"),
        "tokens", "scores", meta.alias("meta"),
    )
