"""One-vs-rest linear models and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators import ovr
from tagloom.session import scratch_path, store_table

# Defaults of the linear model.
INVERSE_REGULARISATION, MAX_ITERATIONS = 2.0, 400
# Features × labels that a scoring task holds at a time (128 MB).
DENSE_CELLS = 16_000_000
WEIGHT_SCHEMA = "idx int, feature_id int, weight double"
INTERCEPT_SCHEMA = "idx int, intercept double, constant double"


@dataclass(frozen=True)
class OvrModel:
    """weights (idx, feature_id, weight); intercepts (idx, intercept, constant).

    ``constant`` is the probability of a label that had one class only.
    """

    weights: DataFrame = field(repr=False)
    intercepts: DataFrame = field(repr=False)
    n_features: int = 0

    def predict(self, features: DataFrame, key: str) -> DataFrame:
        return predict_ovr(self, features, key)


def fit_ovr_logreg(
    features: DataFrame,
    label_map: DataFrame,
    n_features: int,
    c: float = INVERSE_REGULARISATION,
    max_iter: int = MAX_ITERATIONS,
    balanced: bool = False,
    tol: float = 1e-4,
    cells: int = ovr.FIT_CELLS,
) -> OvrModel:
    """One independent L2 logistic regression per label, fitted in blocks of labels.

    ``features`` has ``labels_idx``, ``feature_ids`` and ``feature_values``. Every
    pass over the documents serves all labels of a block, ``cells`` features ×
    labels wide; see ``ovr``. A label is done when no entry of its gradient
    exceeds ``tol``. Finished weights go to the shared folder block by block.
    """
    spark = features.sparkSession
    problem, found = _problem(features, c, balanced)
    labels = sorted(r[0] for r in label_map.select("idx").collect())
    ends = [(idx, 0.0, float(found.get(idx, 0) > 0), 0.0) for idx in labels if found.get(idx, 0) in (0, problem.n)]
    store = scratch_path(spark, "ovr")
    waiting: list[pd.DataFrame] = []
    files = 0

    def write() -> None:
        nonlocal files
        rows = spark.createDataFrame(pd.concat(waiting), WEIGHT_SCHEMA)
        rows.coalesce(1).write.parquet(f"{store}/part={files}")
        waiting.clear()
        files += 1

    steep = [idx for idx in labels if found.get(idx, 0) not in (0, problem.n)]
    for idx, weights, gradient in ovr.minimise(problem, n_features, steep, tol, max_iter, cells):
        used = np.flatnonzero(weights[:-1])
        waiting.append(pd.DataFrame({"idx": np.int32(idx), "feature_id": used.astype("int32"), "weight": weights[used]}))
        ends.append((idx, float(weights[-1]), None, gradient))
        if sum(map(len, waiting)) >= cells:
            write()
    if waiting:
        write()
    table = spark.read.schema(WEIGHT_SCHEMA).parquet(store).select("idx", "feature_id", "weight") if files else spark.createDataFrame([], WEIGHT_SCHEMA)
    return OvrModel(table, spark.createDataFrame([e[:3] for e in ends], INTERCEPT_SCHEMA), n_features)


def _problem(features: DataFrame, c: float, balanced: bool) -> tuple[ovr.Problem, dict[int, int]]:
    """The stored problem and the number of documents of every label."""
    own = features.withColumn("labels_idx", F.array_distinct("labels_idx"))
    blocks = ovr.sparse_blocks(own)
    n = blocks.agg(F.sum("n")).first()[0] or 0
    if n == 0:
        raise ValueError("cannot fit on an empty training set")
    found = dict(own.select(F.explode("labels_idx").alias("idx")).groupBy("idx").count().collect())
    share = {idx: (n / (2.0 * (n - p)), n / (2.0 * p)) for idx, p in found.items() if 0 < p < n} if balanced else {}
    return ovr.Problem(blocks, n, 1.0 / (c * n), share), found


def gradient_norms(model: OvrModel, features: DataFrame, c: float = INVERSE_REGULARISATION, balanced: bool = False) -> DataFrame:
    """(idx, docs, positives, constant, gradient): how far each label is from its optimum.

    The largest gradient entry at the model's weights over ``features``; null for
    constant labels. A label block a pass.
    """
    problem, found = _problem(features, c, balanced)
    ends = model.intercepts.orderBy("idx").toPandas()
    out = [(int(r.idx), problem.n, found.get(r.idx, 0), r.constant, None) for r in ends[ends["constant"].notna()].itertuples()]
    for part, matrix in _label_blocks(model, ends[ends["constant"].isna()], ovr.FIT_CELLS):
        _, gradient = problem.at(np.vstack([matrix, part["intercept"].to_numpy(float)]), part["idx"].to_numpy())
        worst = np.abs(gradient).max(axis=0)
        out += [(int(i), problem.n, found.get(i, 0), None, float(g)) for i, g in zip(part["idx"], worst, strict=True)]
    return features.sparkSession.createDataFrame(out, "idx int, docs long, positives long, constant double, gradient double")


def _label_blocks(model: OvrModel, ends: pd.DataFrame, cells: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows of ``ends``, features × labels matrix) for as many labels at once as ``cells`` allow."""
    width = max(1, cells // max(model.n_features, 1))
    for low in range(0, len(ends), width):
        part = ends.iloc[low : low + width]
        place = {idx: at for at, idx in enumerate(part["idx"])}
        rows = model.weights.where(F.col("idx").isin([int(i) for i in place])).toPandas()
        matrix = np.zeros((model.n_features, len(part)))
        np.add.at(matrix, (rows["feature_id"].to_numpy(), rows["idx"].map(place).to_numpy(dtype=np.int64)), rows["weight"].to_numpy())
        yield part, matrix


def predict_ovr(model: OvrModel, features: DataFrame, key: str, name: str = "scores", cells: int | None = None) -> DataFrame:
    """(key, scores ARRAY<FLOAT>): probability of every label.

    The model is cut into blocks of labels of at most ``cells`` (``DENSE_CELLS``)
    features × labels. A task holds one block and multiplies an Arrow batch of
    sparse rows with it. One block is a narrow pass. With more, each block is a
    pass of its own that stores one array per document, and the arrays of a row
    are put together at the end; non-zeros never meet labels as rows. Repeated
    keys keep their own rows.
    """
    ends = model.intercepts.orderBy("idx").toPandas()
    width = max(1, (cells or DENSE_CELLS) // max(model.n_features, 1))
    if len(ends) <= width:
        for part, matrix in _label_blocks(model, ends, cells or DENSE_CELLS):
            return features.select(key, _scorer(features.sparkSession, part, matrix)("feature_ids", "feature_values").alias(name))
        return features.select(key, F.array().cast("array<float>").alias(name))
    # The row number is stored with the rows, so that all blocks see the same one.
    rows = store_table(features.select(key, "feature_ids", "feature_values").withColumn("__row", F.monotonically_increasing_id()), "to-score")
    parts = []
    for number, (part, matrix) in enumerate(_label_blocks(model, ends, cells or DENSE_CELLS)):
        score = _scorer(features.sparkSession, part, matrix)("feature_ids", "feature_values").alias("part")
        parts.append(store_table(rows.select("__row", F.lit(number).alias("number"), score), "scored-block"))
    together = parts[0]
    for block in parts[1:]:
        together = together.unionByName(block)
    listed = F.array_sort(F.collect_list(F.struct("number", "part")))
    scores = together.groupBy("__row").agg(F.flatten(F.transform(listed, lambda e: e["part"])).alias(name))
    return rows.select("__row", key).join(scores, "__row").select(key, name)


def _scorer(spark: SparkSession, ends: pd.DataFrame, matrix: np.ndarray):
    bias, constant = ends["intercept"].to_numpy(dtype=float), ends["constant"].to_numpy(dtype=float)
    sent = spark.sparkContext.broadcast((matrix, bias, constant))

    @F.pandas_udf("array<float>")
    def score(ids: pd.Series, values: pd.Series) -> pd.Series:
        weights, intercepts, fixed = sent.value
        p = ovr.sigmoid(ovr.SparseRows.of(ids, values).times(weights) + intercepts)
        return pd.Series(list(np.where(np.isnan(fixed), p, fixed).astype("float32")), dtype=object)

    return score


def save_model(model: OvrModel, path: str) -> None:
    model.weights.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/weights")
    model.intercepts.withColumn("n_features", F.lit(model.n_features)).write.mode("overwrite").parquet(f"{path}/intercepts")


def load_model(spark: SparkSession, path: str) -> OvrModel:
    ends = spark.read.parquet(f"{path}/intercepts")
    return OvrModel(
        spark.read.schema(WEIGHT_SCHEMA).parquet(f"{path}/weights"),
        ends.select("idx", "intercept", "constant"), ends.first()["n_features"],
    )


Scorer = Callable[[pd.DataFrame], np.ndarray]


def score_batches(
    df: DataFrame, make_scorer: Callable[[], Scorer], keys: list[str], inputs: list[str], name: str = "scores"
) -> DataFrame:
    """Apply any user model to Arrow batches of documents or chunks.

    ``make_scorer`` runs once per task and returns a function from the input
    columns to an (n, K) probability array. The keys travel with the scores.
    """
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            p = np.asarray(scorer(batch[inputs]), dtype="float32")
            if p.ndim != 2 or len(p) != len(batch):
                raise ValueError(f"scorer returned shape {p.shape} for {len(batch)} rows")
            yield batch[keys].assign(**{name: list(p)})

    return df.select(*dict.fromkeys(keys + inputs)).mapInPandas(run, schema)


