"""Queries that write a derived table, read it back and are checked on the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog import features as feat
from tagloom.catalog import fixtures as fx
from tagloom.catalog import labels as base
from tagloom.catalog import metrics as met
from tagloom.catalog import model as mod
from tagloom.catalog import splits as spl
from tagloom.catalog.fixtures import CATEGORY, sql
from tagloom.catalog.labels import JOIN, joined
from tagloom.operators import features, labels, metrics, split
from tagloom.plans import dataset, evaluation, explaining, training
from tagloom.session import scratch_path, store_table
from tagloom.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _md5(col="text"):
    return F.md5(F.col(col).cast("binary")).alias("text_md5")


_MERGED = sql(f"SELECT subject_id, hadm_id, md5(text) AS text_md5, {JOIN.format('labels')} FROM merged")


def _show(df):
    return df.select("subject_id", "hadm_id", _md5(), joined("labels"))


def _notes_csv(spark, d, **options):
    path = scratch_path(spark, "notes")
    rows = fx.notes(spark, d).select(F.col("note_id").alias("ROW_ID"), *[F.col(c).alias(c.upper()) for c in ("subject_id", "hadm_id", "category", "text")])
    rows.write.options(header=True, quote='"', escape='"', compression="gzip").csv(path)
    return readers.read_notes_csv(spark, path, **options)


@query("read_notes_csv", sql("SELECT CAST(subject_id AS VARCHAR) AS subject_id, CAST(hadm_id AS VARCHAR) AS hadm_id, category, md5(text) AS text_md5 FROM notes"))
def q_read_notes_csv(spark, d):
    return _notes_csv(spark, d).select("subject_id", "hadm_id", "category", _md5())


@query("read_codes_csv", sql("SELECT CAST(hadm_id AS VARCHAR) AS hadm_id, '00' || code AS code, count(*) AS n FROM codes GROUP BY ALL"))
def q_read_codes_csv(spark, d):
    path = scratch_path(spark, "codes")
    rows = fx.codes(spark, d).select("hadm_id", F.concat(F.lit("00"), F.col("code")).alias("ICD9_CODE"))
    rows.write.options(header=True, compression="gzip").csv(path)
    return readers.read_codes_csv(spark, path).groupBy("hadm_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("read_jsonl", _MERGED)
def q_read_jsonl(spark, d):
    path = scratch_path(spark, "merged-jsonl")
    writers.write_jsonl(base.merged(spark, d), path)
    return _show(readers.read_jsonl(spark, path))


@query("read_split", sql("SELECT subject_id, hadm_id, md5(text) AS text_md5, array_to_string(list_transform(labels, lambda c: replace(c, '.', '')), ',') AS labels FROM merged"))
def q_read_split(spark, d):
    path = scratch_path(spark, "split-jsonl")
    writers.write_jsonl(base.merged(spark, d), path)
    return _show(readers.read_split(spark, path))


@query("read_table_csv", _MERGED)
def q_read_table_csv(spark, d):
    path = scratch_path(spark, "merged-csv")
    writers.write_csv_json_labels(base.merged(spark, d), path)
    return _show(readers.read_table(spark, path, "csv"))


@query("read_table", _MERGED)
def q_read_table(spark, d):
    path = scratch_path(spark, "merged") + ".parquet"
    writers.write_parquet(base.merged(spark, d), path)
    return _show(readers.read_table(spark, path))


@query("read_min_columns", sql(f"SELECT subject_id, hadm_id, {JOIN.format('labels_idx')} FROM enc"))
def q_read_min_columns(spark, d):
    path = scratch_path(spark, "encoded")
    writers.write_encoded(labels.encode_labels(base.merged(spark, d), base.label_map(spark, d)), path)
    return readers.read_min_columns(spark, path).select("subject_id", "hadm_id", joined("labels_idx"))


@query("load_label_map", sql("SELECT code, idx FROM label_map"))
def q_load_label_map(spark, d):
    path = scratch_path(spark, "label-map")
    writers.save_label_map(base.label_map(spark, d), path)
    return readers.load_label_map(spark, path)


@query("load_thresholds", sql("SELECT 'per_label' AS kind, idx, round(CAST(tau AS DOUBLE), 6) AS tau FROM taus", met.SCORES, met.GRID, met.BINS, met.CONF, met.TAUS))
def q_load_thresholds(spark, d):
    path = scratch_path(spark, "thresholds")
    mapping = base.label_map(spark, d)
    writers.save_thresholds(spark, met.tuned(spark, d, mapping, met.scored(spark, d, mapping)), path, "per_label")
    kind, taus = readers.load_thresholds(spark, path)
    return taus.select(F.lit(kind).alias("kind"), "idx", F.round(F.col("tau").cast("double"), 6).alias("tau"))


@query("load_metrics_union", """SELECT event_type AS run_name, count(*) AS n, round(avg(value), 6) AS mean_value,
    count_if(event_type = 'click') AS n_props FROM events GROUP BY event_type""")
def q_load_metrics_union(spark, d):
    events = fx.table(spark, d, "events").select(F.col("event_type").alias("run_name"), "value", "props")
    paths = [scratch_path(spark, "metrics") for _ in range(3)]
    events.filter("run_name = 'click'").write.parquet(paths[0])
    events.filter("run_name <> 'click'").drop("props").write.parquet(paths[1])
    rows = readers.load_metrics_union(spark, paths)  # the third path does not exist
    return rows.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.count("props").alias("n_props")
    )


@query("write_split_ids", sql("SELECT split, subject_id FROM ssplit", *spl._STEPS))
def q_write_split_ids(spark, d):
    path = scratch_path(spark, "ids")
    writers.write_split_ids(spl.subject_split(spark, d), path)
    back = spark.read.text(path)
    return back.select("split", F.col("value").cast("bigint").alias("subject_id"))


@query("write_multi_hot", sql("SELECT hadm_id, unnest(labels_idx) AS idx FROM enc"))
def q_write_multi_hot(spark, d):
    path = scratch_path(spark, "multi-hot")
    mapping = base.label_map(spark, d)
    writers.write_multi_hot(base.encoded(spark, d, mapping), path, mapping.count())
    return spark.read.parquet(path)


@query("write_doc_predictions", sql("""SELECT hadm_id, CAST(sum(y) AS BIGINT) AS n_true, round(CAST(max(score) AS DOUBLE), 6) AS best
    FROM scores GROUP BY hadm_id""", met.SCORES))
def q_write_doc_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    mapping = base.label_map(spark, d)
    writers.write_doc_predictions(met.scored(spark, d, mapping), path, mapping.count())
    total = F.aggregate("y", F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    docs = spark.read.parquet(f"{path}/docs")
    return docs.select("hadm_id", total.alias("n_true"), F.round(F.array_max("p").cast("double"), 6).alias("best"))


@query("read_explanations", sql("SELECT example_id, code, case_type, best_chunk, pred_prob FROM recs", *mod._REC))
def q_read_explanations(spark, d):
    path = scratch_path(spark, "explanations")
    rows = mod.records(spark, d)
    writers.write_explanations(rows, path)
    return mod._flat(readers.read_explanations(spark, path, rows.schema))


@query("load_features", sql("SELECT CAST(pos AS INTEGER) AS feature_id, term, df, n, round(idf, 9) AS idf FROM wvoc", *feat._WORD))
def q_load_features(spark, d):
    path = scratch_path(spark, "features")
    features.save_features(features.fit_tfidf(feat.docs(spark, d), feat._only("word")), path)
    vocab = features.load_features(spark, path).vocab
    return vocab.select("feature_id", "term", "df", "n", F.round("idf", 9).alias("idf"))


# --- Whole plans --------------------------------------------------------------


@query("prepare_dataset", sql(f"SELECT subject_id, hadm_id, md5(text) AS text_md5, {JOIN.format('labels')} FROM merged_en"))
def q_prepare_dataset(spark, d):
    config = dataset.DatasetConfig(category=CATEGORY, policy="longest")
    return _show(dataset.prepare_dataset(fx.notes(spark, d), fx.codes(spark, d), scratch_path(spark, "dataset"), config))


@query("prepare_split", sql(f"SELECT subject_id, hadm_id, md5(text) AS text_md5, {JOIN.format('labels_idx')} FROM enc JOIN merged USING (subject_id, hadm_id)"))
def q_prepare_split(spark, d):
    path = scratch_path(spark, "split-jsonl")
    rows = store_table(base.merged(spark, d))
    writers.write_jsonl(rows, path)
    mapping, _ = dataset.label_space(rows)
    return dataset.prepare_split(spark, path, mapping).select("subject_id", "hadm_id", _md5(), joined("labels_idx"))


@query("evaluate_and_save", sql(f"""SELECT split, thr_kind, thr_policy, thr_notes, "N", "K", micro_f1, macro_f1, p_at_8, p_at_15 FROM (
    SELECT 'val' AS split, 'global' AS thr_kind, 'global_val' AS thr_policy, 't=' || printf('%.2f', (SELECT CAST(tau AS DOUBLE) FROM best)) AS thr_notes UNION ALL
    SELECT 'test', 'global', 'use_saved', 'loaded') CROSS JOIN (SELECT (SELECT count(*) FROM merged) AS "N", (SELECT count(*) FROM label_map) AS "K",
    round({met._MICRO}, 9) AS micro_f1, round(avg({met._F1}), 9) AS macro_f1, {met.PATK.format(k=8)} AS p_at_8, {met.PATK.format(k=15)} AS p_at_15
    FROM conf WHERE tau = (SELECT tau FROM best))""", met.SCORES, met.GRID, met.BINS, met.CONF, met.BEST))
def q_evaluate_and_save(spark, d):
    mapping = base.label_map(spark, d)
    rows = store_table(met.scored(spark, d, mapping))
    thresholds, table = scratch_path(spark, "thresholds"), scratch_path(spark, "metrics")
    evaluation.evaluate_and_save(rows, mapping, "hash", "val", thresholds, table, "global_val")
    evaluation.evaluate_and_save(rows, mapping, "hash", "test", thresholds, table, "use_saved")
    back = readers.load_metrics_union(spark, [table])
    return back.select("split", "thr_kind", "thr_policy", "thr_notes", F.col("N").cast("bigint").alias("N"), F.col("K").cast("bigint").alias("K"),
                       *[F.round(c, 9).alias(c) for c in ("micro_f1", "macro_f1", "p_at_8", "p_at_15")])


# Per-label thresholds: labels with too few positives keep the best global one.
_LABEL_MIN = 80
_PTAUS = ("ptaus", f"""SELECT idx, CASE WHEN pos < {_LABEL_MIN} THEN (SELECT tau FROM best) ELSE tau END AS tau FROM (
    SELECT idx, tau, tp + fn AS pos, row_number() OVER (PARTITION BY idx ORDER BY {met._F1} DESC, g) AS rn FROM conf) WHERE rn = 1""")
_PCONF = ("pconf", """SELECT 'per_label' AS kind, c.idx, c.tp, c.fp, c.fn FROM conf c JOIN ptaus p ON p.idx = c.idx AND p.tau = c.tau
    UNION ALL SELECT 'fixed', idx, tp, fp, fn FROM conf1""")


@query("evaluate_per_label", sql(f"""SELECT r.*, f.micro_f1, f.macro_f1, {met.PATK.format(k=8)} AS p_at_8 FROM (
    SELECT 'val' AS split, 'per_label' AS thr_kind, 'per_label_val' AS thr_policy, 'base=' || printf('%.2f', (SELECT CAST(tau AS DOUBLE) FROM best)) || ' tuned=1D' AS thr_notes
    UNION ALL SELECT 'test', 'per_label', 'use_saved', 'loaded' UNION ALL SELECT 'test', 'fixed', 'per_label_val', 't=0.50 [fallback]') r
    JOIN (SELECT kind, round({met._MICRO}, 9) AS micro_f1, round(avg({met._F1}), 9) AS macro_f1 FROM pconf GROUP BY kind) f ON f.kind = r.thr_kind""",
    met.SCORES, met.GRID, met.BINS, met.CONF, met.BEST, met.CONF1, _PTAUS, _PCONF))
def q_evaluate_per_label(spark, d):
    """Thresholds per label tuned on val, saved, read for test; tuning on test falls back to the fixed one."""
    mapping = base.label_map(spark, d)
    rows = store_table(met.scored(spark, d, mapping))
    thresholds, table = scratch_path(spark, "thresholds"), scratch_path(spark, "metrics")
    for split, policy in (("val", "per_label_val"), ("test", "use_saved"), ("test", "per_label_val")):
        evaluation.evaluate_and_save(rows, mapping, "hash", split, thresholds, table, policy, min_pos=_LABEL_MIN)
    back = readers.load_metrics_union(spark, [table])
    return back.select("split", "thr_kind", "thr_policy", "thr_notes", *[F.round(c, 9).alias(c) for c in ("micro_f1", "macro_f1", "p_at_8")])


_MAXED = ("scores", """SELECT hadm_id, idx, CASE WHEN list_contains(labels_idx, idx) THEN 1 ELSE 0 END AS y, s AS score FROM (
    SELECT hadm_id, idx, max(score) AS s FROM chunk_scores GROUP BY ALL) JOIN enc USING (hadm_id)""")


@query("evaluate_chunked", sql(f"""SELECT round({met._MICRO}, 9) AS micro_f1, round(avg({met._F1}), 9) AS macro_f1,
    {met.PATK.format(k=8)} AS p_at_8, {met.PATK.format(k=15)} AS p_at_15 FROM conf1""", met.CHUNKS, _MAXED, met.CONF1))
def q_evaluate_chunked(spark, d):
    mapping = base.label_map(spark, d, texts=True)
    docs = base.encoded(spark, d, mapping)
    row = evaluation.evaluate_chunked(met.chunk_scores(spark, d, mapping), docs, mapping, "hash", "val", scratch_path(spark, "thresholds"))
    return row.select(*[F.round(c, 9).alias(c) for c in ("micro_f1", "macro_f1", "p_at_8", "p_at_15")])


def _training_splits(spark, d):
    merged = store_table(base.merged(spark, d))
    mapping, _ = dataset.label_space(merged)
    encoded = store_table(labels.encode_labels(merged, mapping))
    placed = store_table(split.assign_splits(encoded, split.split_subject_stratified(encoded, spl.SEED)))
    return mapping, {name: placed.filter(F.col("split") == name) for name in labels.SPLITS}


@query("train_linear_pipeline")
def q_train_linear(spark, d):
    mapping, parts = _training_splits(spark, d)
    rows = training.train_linear(parts, mapping, scratch_path(spark, "run"), config=feat._only("word"), max_iter=30)
    return rows["val"].unionByName(rows["test"])


@query("explain_split")
def q_explain_split(spark, d):
    mapping, parts = _training_splits(spark, d)
    path = scratch_path(spark, "run")
    training.train_linear(parts, mapping, path, config=feat._only("word"), max_iter=30, policy="fixed")
    tfidf, linear = training.load_run(spark, path, "tfidf_lr")
    return explaining.explain_split(parts["test"], mapping, tfidf, linear, metrics.DEFAULT_TAU)
