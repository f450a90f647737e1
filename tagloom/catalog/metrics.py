"""Queries over thresholds, confusion counts, F1, precision at k and chunk scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.catalog import labels as base
from tagloom.catalog.fixtures import sql
from tagloom.catalog.labels import joined
from tagloom.functions.hashing import unit_hash
from tagloom.operators import metrics, model, text

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _codes(mapping: DataFrame):
    packed = F.array_sort(F.collect_list(F.struct("idx", "code")))
    return mapping.agg(F.transform(packed, lambda e: e["code"])).scalar()


def scored(spark: SparkSession, d: str, mapping: DataFrame) -> DataFrame:
    """Every merged admission with a hash-based score per label."""
    rows = base.encoded(spark, d, mapping).withColumn("__codes", _codes(mapping))

    def score(code, i):
        y = F.array_contains("labels_idx", i).cast("int")
        return (F.lit(0.6) * unit_hash(F.col("hadm_id"), code) + F.lit(0.4) * y).cast("float")

    return rows.select("subject_id", "hadm_id", "labels_idx", F.transform("__codes", score).alias("scores"))


# Words of a chunk, and words that neighbouring chunks share.
CHUNK_WORDS, CHUNK_OVERLAP = 128, 16
_STEP = CHUNK_WORDS - CHUNK_OVERLAP


def _hash_scorer(codes: list[str]):
    """A scorer of whole chunk texts: a number per text and code, taken from their md5."""

    def make():
        from hashlib import md5

        def one(text: str) -> list[float]:
            mark = md5(text.encode()).hexdigest()
            return [int(md5(f"{mark}:{code}".encode()).hexdigest()[:8], 16) / 4294967296.0 for code in codes]

        return lambda batch: np.array([one(text) for text in batch["chunk"]], dtype="float64").reshape(len(batch), len(codes))

    return make


def chunk_scores(spark: SparkSession, d: str, mapping: DataFrame) -> DataFrame:
    """Every merged text, whole, cut into overlapping chunks of words, and each chunk scored for all labels.

    The texts are those stored with the label map (``texts=True``).
    """
    codes = [r["code"] for r in mapping.orderBy("idx").collect()]
    words = base.rows_of(mapping).select("hadm_id", F.split("text", " ").alias("ids"))
    cut = text.chunk_sequences(words, max_len=CHUNK_WORDS, overlap=CHUNK_OVERLAP, pad="")
    chunks = cut.select("hadm_id", "chunk_no", F.rtrim(F.concat_ws(" ", "ids")).alias("chunk"))
    return model.score_batches(chunks, _hash_scorer(codes), ["hadm_id", "chunk_no"], ["chunk"])


def _h(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


SCORES = ("scores", f"""SELECT e.subject_id, e.hadm_id, m.idx, CASE WHEN list_contains(e.labels_idx, m.idx) THEN 1 ELSE 0 END AS y,
    CAST(CAST(0.6 AS DOUBLE) * {_h('e.hadm_id', 'm.code')} + CAST(0.4 AS DOUBLE) * CASE WHEN list_contains(e.labels_idx, m.idx) THEN 1 ELSE 0 END
    AS FLOAT) AS score FROM enc e, label_map m""")
CHUNKS = ("chunk_scores", f"""SELECT c.hadm_id, c.chunk_no, m.idx, CAST({_h('c.mark', 'm.code')} AS FLOAT) AS score FROM label_map m, (
    SELECT hadm_id, CAST(n AS INTEGER) AS chunk_no, md5(rtrim(array_to_string(list_slice(w, n * {_STEP} + 1, n * {_STEP} + {CHUNK_WORDS}), ' '), ' ')) AS mark
    FROM (SELECT hadm_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - {CHUNK_WORDS}, 0) / CAST({_STEP} AS DOUBLE)) AS BIGINT) + 1)) AS n
        FROM (SELECT hadm_id, string_split(text, ' ') AS w FROM merged))) c""")
GRID = ("grid", "SELECT i AS g, CAST(CAST(0.05 AS DOUBLE) * i AS FLOAT) AS tau FROM (SELECT CAST(unnest(range(1, 20)) AS INTEGER) AS i)")
# Each score is placed on the grid once; a grid value then sums what lies at or above it.
BINS = ("bins", """SELECT idx, y, len(list_filter((SELECT list(tau ORDER BY g) FROM grid), lambda t: t <= score)) AS bin, count(*) AS n
    FROM scores GROUP BY ALL""")
CONF = ("conf", """SELECT b.idx, g.g, g.tau, CAST(sum(CASE WHEN bin >= g.g AND y = 1 THEN n ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN bin >= g.g AND y = 0 THEN n ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN bin < g.g AND y = 1 THEN n ELSE 0 END) AS BIGINT) AS fn FROM bins b, grid g GROUP BY ALL""")
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END"
CONF1 = ("conf1", """SELECT idx, CAST(sum(CASE WHEN score >= CAST(0.5 AS FLOAT) AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN score >= CAST(0.5 AS FLOAT) AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN score < CAST(0.5 AS FLOAT) AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM scores GROUP BY idx""")
_MICRO = "2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE)"
BEST = ("best", f"""SELECT tau FROM (SELECT g, tau, {_MICRO} AS mi, avg({_F1}) AS ma FROM conf GROUP BY g, tau)
    ORDER BY mi DESC, round(ma, 12) DESC, g LIMIT 1""")
TAUS = ("taus", f"""SELECT idx, CASE WHEN pos < 50 THEN CAST(0.5 AS FLOAT) ELSE tau END AS tau FROM (
    SELECT idx, tau, tp + fn AS pos, row_number() OVER (PARTITION BY idx ORDER BY {_F1} DESC, g) AS rn FROM conf) WHERE rn = 1""")
PATK = """(SELECT round(avg(hits / CAST(least({k}, 25) AS DOUBLE)), 9) FROM (SELECT hadm_id, sum(y) AS hits FROM (
    SELECT hadm_id, y, row_number() OVER (PARTITION BY hadm_id ORDER BY score DESC, idx) AS rn FROM scores) WHERE rn <= {k} GROUP BY hadm_id))"""
MIN_POS = 50


def tuned(spark, d, mapping, rows):
    return metrics.tune_label_thresholds(rows, mapping, min_pos=MIN_POS)


@query("validate_scores", sql("""SELECT CAST(0 AS BIGINT) AS bad_length, count_if(idx < 0) AS bad_labels,
    count_if(score < 0 OR score > 1 OR isnan(score)) AS bad_scores FROM scores""", SCORES))
def q_validate_scores(spark, d):
    mapping = base.label_map(spark, d)
    return metrics.score_violations(scored(spark, d, mapping), mapping.count())


@query("apply_thresholds", sql("""SELECT hadm_id, coalesce(string_agg(CASE WHEN score >= CAST(0.5 AS FLOAT) THEN CAST(idx AS VARCHAR) END, ',' ORDER BY idx), '') AS pred_idx
    FROM scores GROUP BY hadm_id""", SCORES))
def q_apply_thresholds(spark, d):
    mapping = base.label_map(spark, d)
    return metrics.apply_thresholds(scored(spark, d, mapping), 0.5).select("hadm_id", joined("pred_idx"))


@query("apply_thresholds_per_label", sql("""SELECT hadm_id, coalesce(string_agg(CASE WHEN score >= tau THEN CAST(idx AS VARCHAR) END, ',' ORDER BY idx), '') AS pred_idx
    FROM scores JOIN taus USING (idx) GROUP BY hadm_id""", SCORES, GRID, BINS, CONF, TAUS))
def q_apply_thresholds_per_label(spark, d):
    mapping = base.label_map(spark, d)
    rows = scored(spark, d, mapping)
    return metrics.apply_thresholds(rows, tuned(spark, d, mapping, rows)).select("hadm_id", joined("pred_idx"))


@query("join_thresholds", sql("""SELECT hadm_id, idx, CASE WHEN score >= tau THEN 1 ELSE 0 END AS pred FROM scores JOIN taus USING (idx)""",
    SCORES, GRID, BINS, CONF, TAUS))
def q_join_thresholds(spark, d):
    mapping = base.label_map(spark, d)
    rows = scored(spark, d, mapping)
    joined_rows = metrics.join_thresholds(metrics.long_form(rows, "hadm_id"), tuned(spark, d, mapping, rows))
    return joined_rows.select("hadm_id", "idx", "pred")


@query("confusion_by_label", sql("SELECT idx, tp, fp, fn FROM conf1", SCORES, CONF1))
def q_confusion_by_label(spark, d):
    mapping = base.label_map(spark, d)
    return metrics.confusion_by_label(metrics.apply_thresholds(scored(spark, d, mapping), 0.5), mapping)


@query("f1_micro_macro", sql(f"SELECT round({_MICRO}, 9) AS micro_f1, round(avg({_F1}), 9) AS macro_f1 FROM conf1", SCORES, CONF1))
def q_f1_micro_macro(spark, d):
    mapping = base.label_map(spark, d)
    confusion = metrics.confusion_by_label(metrics.apply_thresholds(scored(spark, d, mapping), 0.5), mapping)
    return metrics.f1_micro_macro(confusion).select(F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"))


@query("precision_at_k", sql(f"SELECT {PATK.format(k=5)} AS p_at_5, {PATK.format(k=8)} AS p_at_8, {PATK.format(k=15)} AS p_at_15", SCORES))
def q_precision_at_k(spark, d):
    mapping = base.label_map(spark, d)
    rows = metrics.precision_at_k(scored(spark, d, mapping), (5, 8, 15))
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


@query("tune_global_threshold", sql(f"""SELECT round(CAST(tau AS DOUBLE), 6) AS tau, round(mi, 9) AS micro_f1, round(ma, 9) AS macro_f1 FROM (
    SELECT g, tau, {_MICRO} AS mi, avg({_F1}) AS ma FROM conf GROUP BY g, tau) ORDER BY mi DESC, round(ma, 12) DESC, g LIMIT 1""", SCORES, GRID, BINS, CONF))
def q_tune_global_threshold(spark, d):
    mapping = base.label_map(spark, d)
    best = metrics.tune_global_threshold(scored(spark, d, mapping), mapping)
    return best.select(F.round(F.col("tau").cast("double"), 6).alias("tau"), F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"))


@query("threshold_grid", sql("SELECT idx, g, tp, fp, fn FROM conf", SCORES, GRID, BINS, CONF))
def q_threshold_grid(spark, d):
    mapping = base.label_map(spark, d)
    return metrics.grid_confusion(scored(spark, d, mapping), mapping).select("idx", "g", "tp", "fp", "fn")


@query("tune_label_thresholds", sql("SELECT idx, round(CAST(tau AS DOUBLE), 6) AS tau FROM taus", SCORES, GRID, BINS, CONF, TAUS))
def q_tune_label_thresholds(spark, d):
    mapping = base.label_map(spark, d)
    taus = tuned(spark, d, mapping, scored(spark, d, mapping))
    return taus.select("idx", F.round(F.col("tau").cast("double"), 6).alias("tau"))


@query("evaluate_probs", sql(f"""SELECT round({_MICRO}, 9) AS micro_f1, round(avg({_F1}), 9) AS macro_f1,
    {PATK.format(k=8)} AS p_at_8, {PATK.format(k=15)} AS p_at_15 FROM conf1""", SCORES, CONF1))
def q_evaluate_probs(spark, d):
    mapping = base.label_map(spark, d)
    rows = metrics.evaluate_probs(scored(spark, d, mapping), mapping)
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


@query("aggregate_chunk_scores", sql("""SELECT hadm_id, string_agg(CAST(CAST(floor(CAST(s AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY idx) AS scores
    FROM (SELECT hadm_id, idx, max(score) AS s FROM chunk_scores GROUP BY ALL) GROUP BY hadm_id""", CHUNKS))
def q_aggregate_chunk_scores(spark, d):
    docs = metrics.aggregate_chunk_scores(chunk_scores(spark, d, base.label_map(spark, d, texts=True)))
    cells = F.transform("scores", lambda s: F.floor(s.cast("double") * 10000).cast("string"))
    return docs.select("hadm_id", F.concat_ws(",", cells).alias("scores"))


@query("aggregate_chunk_scores_mean", sql("""SELECT hadm_id, idx, round(CAST(CAST(avg(CAST(score AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS score FROM chunk_scores GROUP BY ALL""", CHUNKS))
def q_aggregate_chunk_scores_mean(spark, d):
    docs = metrics.aggregate_chunk_scores(chunk_scores(spark, d, base.label_map(spark, d, texts=True)), how="mean")
    flat = docs.select("hadm_id", F.posexplode("scores").alias("idx", "score"))
    return flat.select("hadm_id", "idx", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("broadcast_doc_labels", sql("""SELECT c.hadm_id, c.chunk_no, array_to_string(e.labels_idx, ',') AS labels_idx
    FROM (SELECT DISTINCT hadm_id, chunk_no FROM chunk_scores) c JOIN enc e USING (hadm_id)""", CHUNKS))
def q_broadcast_doc_labels(spark, d):
    mapping = base.label_map(spark, d, texts=True)
    rows = metrics.broadcast_doc_labels(chunk_scores(spark, d, mapping), base.encoded(spark, d, mapping))
    return rows.select("hadm_id", "chunk_no", joined("labels_idx"))


@query("case_type", sql("""SELECT hadm_id, idx, CASE WHEN y = 1 AND p THEN 'TP' WHEN p THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS case_type
    FROM (SELECT *, score >= CAST(0.5 AS FLOAT) AS p FROM scores)""", SCORES))
def q_case_type(spark, d):
    rows = metrics.long_form(scored(spark, d, base.label_map(spark, d)), "hadm_id")
    pred = (F.col("score") >= F.lit(0.5).cast("float")).cast("int")
    return rows.select("hadm_id", "idx", metrics.case_type(F.col("y"), pred).alias("case_type"))


@query("last_run_per_name", """SELECT event_type AS run_name, event_id AS seq, round(value, 6) AS micro_f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_last_run_per_name(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_type").alias("run_name"), F.lit("test").alias("split"), F.col("event_id").alias("seq"), F.round("value", 6).alias("micro_f1")
    )
    return metrics.last_run_per_name(events, "test").select("run_name", "seq", "micro_f1")
