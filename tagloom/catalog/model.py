"""Queries over linear models, batch scoring and explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagloom.catalog import features as feat
from tagloom.catalog import fixtures as fx
from tagloom.catalog import labels as base
from tagloom.catalog import metrics as met
from tagloom.catalog.fixtures import sql
from tagloom.functions.hashing import unit_hash
from tagloom.operators import explain, features, labels, merge, metrics, model
from tagloom.session import cut_lineage, scratch_path, store_table

TOLERANCE = 1e-4  # largest gradient entry of a fitted label

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# A linear model whose weights are hashes of (term, brand), for exact checks.
BRANDS = ("brands", "SELECT brand, CAST(row_number() OVER (ORDER BY brand) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT p_brand AS brand FROM part)")
WLONG = ("wlong", f"""SELECT b.idx, CAST(v.pos AS INTEGER) AS feature_id, v.term, {met._h('v.term', 'b.brand')} - 0.5 AS weight FROM wvoc v, brands b""")
MARGIN = ("margin", f"""SELECT d.doc_id, b.idx, {met._h("'bias'", 'b.brand')} - 0.5 + coalesce(s.z, 0) AS z FROM documents d CROSS JOIN brands b
    LEFT JOIN (SELECT t.doc_id, w.idx, sum(CAST(CAST(t.value AS FLOAT) AS DOUBLE) * w.weight) AS z FROM wtf t JOIN wlong w USING (feature_id) GROUP BY ALL) s
        ON s.doc_id = d.doc_id AND s.idx = b.idx""")
_STEPS = (*feat._WORD, feat.WTF, BRANDS, WLONG, MARGIN)


def _brands(spark, d):
    names = fx.table(spark, d, "part").select("p_brand").distinct()
    packed = names.agg(F.array_sort(F.collect_list("p_brand")).alias("b"))
    return cut_lineage(packed.select(F.posexplode("b").alias("idx", "brand")))


def hashed(spark, d):
    """(TF-IDF model, features of all documents, hash-weighted linear model)."""
    docs = feat.docs(spark, d)
    tfidf = features.fit_tfidf(docs, feat._only("word"))
    rows = tfidf.transform(docs, "doc_id")
    brands = _brands(spark, d)
    names = brands.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "brand"))), lambda e: e["brand"])).scalar()
    weights = tfidf.vocab.select("feature_id", "term", F.posexplode(names).alias("idx", "brand")).select(
        "idx", "feature_id", (unit_hash(F.col("term"), F.col("brand")) - 0.5).alias("weight")
    )
    ends = brands.select(
        "idx", (unit_hash(F.lit("bias"), F.col("brand")) - 0.5).alias("intercept"), F.lit(None).cast("double").alias("constant")
    )
    return tfidf, rows, model.OvrModel(weights, ends, tfidf.n_features)


@query("predict_ovr", sql("SELECT doc_id, idx, round(CAST(CAST(1 / (1 + exp(-z)) AS FLOAT) AS DOUBLE), 5) AS score FROM margin", *_STEPS))
def q_predict_ovr(spark, d):
    _, rows, linear = hashed(spark, d)
    flat = linear.predict(rows, "doc_id").select("doc_id", F.posexplode("scores").alias("idx", "score"))
    return flat.select("doc_id", "idx", F.round(F.col("score").cast("double"), 5).alias("score"))


def _targets(spark, d, linear):
    """A label for every document, each label for as many."""
    n = linear.intercepts.count()
    return fx.table(spark, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(n)).cast("int").alias("idx"))


@query("token_attribution", sql("""SELECT t.doc_id, w.idx, w.feature_id, round(abs(CAST(CAST(t.value AS FLOAT) AS DOUBLE) * w.weight), 7) AS attribution
    FROM wtf t JOIN wlong w USING (feature_id) WHERE w.idx = t.doc_id % (SELECT count(*) FROM brands)""", *_STEPS))
def q_token_attribution(spark, d):
    _, rows, linear = hashed(spark, d)
    targets = _targets(spark, d, linear)
    found = explain.token_attribution(rows, linear, targets, "doc_id")
    return found.withColumn("attribution", F.round("attribution", 7))


@query("top_tokens", sql("""SELECT doc_id, string_agg(term, '|' ORDER BY a DESC, feature_id) AS top FROM (SELECT t.doc_id, w.term, w.feature_id, a,
    row_number() OVER (PARTITION BY t.doc_id ORDER BY a DESC, w.feature_id) AS rn FROM (SELECT t.doc_id, w.term, w.feature_id,
    abs(CAST(CAST(t.value AS FLOAT) AS DOUBLE) * w.weight) AS a FROM wtf t JOIN wlong w USING (feature_id) WHERE w.idx = t.doc_id % (SELECT count(*) FROM brands) AND w.term NOT IN ('the', 'and')) t
    JOIN wlong w ON w.idx = t.doc_id % (SELECT count(*) FROM brands) AND w.feature_id = t.feature_id) WHERE rn <= 10 GROUP BY doc_id""", *_STEPS))
def q_top_tokens(spark, d):
    tfidf, rows, linear = hashed(spark, d)
    targets = _targets(spark, d, linear)
    lists = explain.token_lists(explain.token_attribution(rows, linear, targets, "doc_id"), tfidf, "doc_id")
    best = explain.top_tokens(lists, 10, specials=("the", "and"))
    return best.select("doc_id", F.concat_ws("|", F.transform("top", lambda e: e["token"])).alias("top"))


def training_rows(spark, d, mapping):
    """Word features and label indices of the merged admissions, stored with the label map (``texts=True``)."""
    merged = base.rows_of(mapping)
    encoded = labels.encode_labels(merged.select("hadm_id", "labels"), mapping)
    tfidf = features.fit_tfidf(merged, feat._only("word"))
    return tfidf, tfidf.transform(merged, "hadm_id").join(encoded, "hadm_id")


@query("fit_ovr_logreg", sql("""SELECT idx, docs, positives, CASE positives WHEN 0 THEN CAST(0 AS DOUBLE) WHEN docs THEN CAST(1 AS DOUBLE) END AS constant,
    CASE WHEN positives NOT IN (0, docs) THEN true END AS optimal FROM (SELECT m.idx, (SELECT count(*) FROM merged) AS docs, count(e.idx) AS positives
    FROM label_map m LEFT JOIN (SELECT unnest(labels_idx) AS idx FROM enc) e USING (idx) GROUP BY m.idx)"""))
def q_fit_ovr_logreg(spark, d):
    """Class counts, constant labels, and whether no gradient entry of a label exceeds the tolerance."""
    mapping = base.label_map(spark, d, texts=True)
    tfidf, rows = training_rows(spark, d, mapping)
    rows = store_table(rows)
    fitted = model.fit_ovr_logreg(rows, mapping, tfidf.n_features, tol=TOLERANCE)
    found = model.gradient_norms(fitted, rows)
    return found.select("idx", "docs", "positives", "constant", (F.col("gradient") <= 1.001 * TOLERANCE).alias("optimal"))


_SCORED = sql("SELECT doc_id, idx, round(CAST(CAST(1 / (1 + exp(-z)) AS FLOAT) AS DOUBLE), 5) AS score FROM margin", *_STEPS)


def _flat_scores(scored):
    flat = scored.select("doc_id", F.posexplode("scores").alias("idx", "score"))
    return flat.select("doc_id", "idx", F.round(F.col("score").cast("double"), 5).alias("score"))


@query("predict_ovr_blocks", _SCORED)
def q_predict_ovr_blocks(spark, d):
    """The same scores from a model that is cut into blocks of four labels."""
    _, rows, linear = hashed(spark, d)
    return _flat_scores(model.predict_ovr(linear, rows, "doc_id", cells=4 * linear.n_features))


@query("load_model", _SCORED)
def q_load_model(spark, d):
    """The scores of a model that has been saved and loaded."""
    _, rows, linear = hashed(spark, d)
    path = scratch_path(spark, "saved-model")
    model.save_model(linear, path)
    return _flat_scores(model.load_model(spark, path).predict(rows, "doc_id"))


@query("score_batches", """SELECT doc_id, round(CAST(CAST(least(length(text) / CAST(20000 AS DOUBLE), 1) AS FLOAT) AS DOUBLE), 5) AS long,
    round(CAST(CAST(least(len(string_split(text, ' ')) / CAST(4000 AS DOUBLE), 1) AS FLOAT) AS DOUBLE), 5) AS wordy FROM documents""")
def q_score_batches(spark, d):
    def make_scorer():
        def score(batch):
            chars = batch["text"].str.len() / 20000.0
            words = (batch["text"].str.count(" ") + 1) / 4000.0
            return np.minimum(np.stack([chars, words], axis=1), 1.0)

        return score

    out = model.score_batches(fx.table(spark, d, "documents"), make_scorer, ["doc_id"], ["text"])
    return out.select("doc_id", *[F.round(F.col("scores")[i].cast("double"), 5).alias(n) for i, n in enumerate(("long", "wordy"))])


# --- Candidates and records ---------------------------------------------------

CAND = ("cand", """SELECT subject_id, hadm_id, idx, case_type, score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY score DESC, c, idx) AS rn FROM (
    SELECT *, CASE WHEN y = 1 AND p THEN 'TP' WHEN p THEN 'FP' ELSE 'FN' END AS case_type, CASE WHEN y = 1 AND p THEN 0 WHEN p THEN 1 ELSE 2 END AS c
    FROM (SELECT *, score >= CAST(0.5 AS FLOAT) AS p FROM scores) WHERE y = 1 OR p)) WHERE rn <= 3""")
BESTC = ("bestc", """SELECT hadm_id, idx, chunk_no AS best_chunk, s AS chunk_score FROM (SELECT c.hadm_id, c.idx, c.chunk_no, c.score AS s,
    row_number() OVER (PARTITION BY c.hadm_id, c.idx ORDER BY c.score DESC, c.chunk_no) AS rn FROM chunk_scores c JOIN cand USING (hadm_id, idx)) WHERE rn = 1""")


def candidates(spark, d, mapping):
    predicted = metrics.apply_thresholds(met.scored(spark, d, mapping), 0.5)
    return explain.explain_candidates(predicted, ["subject_id", "hadm_id"])


@query("explain_candidates", sql("SELECT subject_id, hadm_id, idx, case_type, round(CAST(score AS DOUBLE), 6) AS score, rank FROM cand", met.SCORES, CAND))
def q_explain_candidates(spark, d):
    rows = candidates(spark, d, base.label_map(spark, d))
    return rows.withColumns({"score": F.round(F.col("score").cast("double"), 6), "rank": F.col("rank").cast("bigint")})


@query("best_chunk", sql("SELECT hadm_id, idx, best_chunk, round(CAST(chunk_score AS DOUBLE), 6) AS chunk_score FROM bestc", met.SCORES, met.CHUNKS, CAND, BESTC))
def q_best_chunk(spark, d):
    mapping = base.label_map(spark, d, texts=True)
    best = explain.best_chunk(met.chunk_scores(spark, d, mapping), candidates(spark, d, mapping))
    return best.withColumn("chunk_score", F.round(F.col("chunk_score").cast("double"), 6))


def records(spark, d):
    mapping = base.label_map(spark, d, texts=True)
    found = cut_lineage(candidates(spark, d, mapping))
    tokens = found.select("hadm_id", "idx", F.array(F.lit("[CLS]"), "case_type").alias("tokens"),
                          F.array(F.lit(0.0), F.col("score").cast("double")).alias("scores"))
    chunks = explain.best_chunk(met.chunk_scores(spark, d, mapping), found)
    return explain.explanation_records(found, tokens, mapping, chunks=chunks)


RECS = ("recs", """SELECT c.subject_id || '_' || c.hadm_id || '_' || c.idx AS example_id, m.code, c.case_type, b.best_chunk,
    round(CAST(c.score AS DOUBLE), 6) AS pred_prob, c.score FROM cand c JOIN label_map m USING (idx) JOIN bestc b USING (hadm_id, idx)""")
_REC = (met.SCORES, met.CHUNKS, CAND, BESTC, RECS)


def _flat(df):
    return df.select("example_id", "meta.code", "meta.case_type", "meta.best_chunk", F.round(F.col("meta.pred_prob").cast("double"), 6).alias("pred_prob"))


@query("explanation_records", sql("SELECT example_id, code, case_type, best_chunk, pred_prob FROM recs", *_REC))
def q_explanation_records(spark, d):
    return _flat(records(spark, d))


@query("filter_explanations", sql("SELECT example_id, code, case_type, best_chunk, pred_prob FROM recs WHERE code = 'BRAND#7' AND case_type = 'FP'", *_REC))
def q_filter_explanations(spark, d):
    return _flat(explain.filter_explanations(records(spark, d), code="BRAND#7", case="FP"))


@query("choose_explanation", sql("SELECT example_id, code, case_type, best_chunk, pred_prob FROM recs ORDER BY score DESC, example_id LIMIT 1", *_REC))
def q_choose_explanation(spark, d):
    return _flat(explain.choose_explanation(records(spark, d), "max_prob"))
