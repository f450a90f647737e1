import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.operators import explain, features, model, ovr
from tagloom.operators.cleaning import DataCheckError
from tagloom.plans import explaining, training
from tagloom.session import scratch_path

MAP = [("A", 0), ("B", 1), ("ALL", 2), ("NONE", 3)]


@pytest.fixture(scope="module")
def trained(spark):
    """Documents about two topics; label 2 is on every document, label 3 on none."""
    words = {0: "heart chest pain cardiac", 1: "fever infection cough lung"}
    data = []
    for i in range(60):
        topics = [t for t in (0, 1) if (i + t) % 3]
        data.append((i, i // 2, " ".join(words[t] for t in topics) + f" visit{i % 5}", topics + [2]))
    docs = spark.createDataFrame(data, "hadm_id long, subject_id long, text string, labels_idx array<int>")
    mapping = spark.createDataFrame(MAP, "code string, idx int")
    tfidf, out = features.fit_transform_splits({"train": docs}, "hadm_id", features.TfidfConfig(mode="word"))
    rows = out["train"].join(docs.select("hadm_id", "labels_idx"), "hadm_id").cache()
    return docs, mapping, tfidf, rows, model.fit_ovr_logreg(rows, mapping, tfidf.n_features)


def test_fit_finds_the_optimum_and_constant_labels(trained):
    docs, mapping, tfidf, rows, fitted = trained
    ends = {r["idx"]: r for r in fitted.intercepts.collect()}
    assert ends[2]["constant"] == 1.0 and ends[3]["constant"] == 0.0 and ends[0]["constant"] is None
    data = rows.collect()
    n, d = len(data), tfidf.n_features
    x = np.zeros((n, d))
    for k, r in enumerate(data):
        x[k, r["feature_ids"]] = r["feature_values"]
    for label in (0, 1):
        w = np.zeros(d)
        for r in fitted.weights.filter(F.col("idx") == label).collect():
            w[r["feature_id"]] = r["weight"]
        y = np.array([label in r["labels_idx"] for r in data], dtype=float)
        p = 1 / (1 + np.exp(-(x @ w + ends[label]["intercept"])))
        gradient = x.T @ (p - y) / n + w / (model.INVERSE_REGULARISATION * n)
        assert np.abs(gradient).max() < 1.01e-4 and abs((p - y).mean()) < 1.01e-4
    scores = {r["hadm_id"]: r["scores"] for r in fitted.predict(rows, "hadm_id").collect()}
    assert all(len(s) == 4 and s[2] == 1.0 and s[3] == 0.0 for s in scores.values())
    label = 0
    for k, r in enumerate(data):
        w = {q["feature_id"]: q["weight"] for q in fitted.weights.filter("idx = 0").collect()} if k == 0 else w  # noqa: F821
        z = ends[0]["intercept"] + sum(v * w.get(i, 0) for i, v in zip(r["feature_ids"], r["feature_values"]))
        assert scores[r["hadm_id"]][0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_predict_empty_and_in_label_blocks(trained):
    _, _, _, rows, fitted = trained
    assert fitted.predict(rows.limit(0), "hadm_id").count() == 0
    twice = rows.unionByName(rows.limit(3))
    want = sorted((r["hadm_id"], list(r["scores"])) for r in fitted.predict(twice, "hadm_id").collect())
    for cells in (1, 3 * fitted.n_features):
        got = sorted((r["hadm_id"], list(r["scores"])) for r in model.predict_ovr(fitted, twice, "hadm_id", cells=cells).collect())
        assert got == want
    assert model.predict_ovr(fitted, rows.limit(0), "hadm_id", cells=1).count() == 0


@pytest.mark.parametrize("balanced", [False, True])
def test_blocks_of_labels_find_the_same_optimum(trained, spark, balanced):
    """Columns that are taken over by waiting labels end where all labels at once do."""
    docs, _, tfidf, rows, _ = trained
    mapping = spark.createDataFrame([(str(i), i) for i in range(6)], "code string, idx int")
    more = rows.withColumn("labels_idx", F.concat("labels_idx", F.array((F.col("hadm_id") % 3 + 3).cast("int")), F.array(F.lit(0)))).withColumn(
        "labels_idx", F.when(F.col("hadm_id") % 7 < 3, F.col("labels_idx")).otherwise(F.array_remove("labels_idx", 0)))
    fits = [model.fit_ovr_logreg(more, mapping, tfidf.n_features, balanced=balanced, tol=1e-6, cells=cells)
            for cells in (10**6, 2 * (tfidf.n_features + 1))]
    table = [{(r.idx, r.feature_id): r.weight for r in f.weights.collect()} for f in fits]
    assert {k for k, _ in table[0]} == {k for k, _ in table[1]} == {0, 1, 3, 4, 5}
    assert max(abs(w - table[1].get(k, 0.0)) for k, w in table[0].items()) < 1e-3
    for fitted in fits:
        norms = model.gradient_norms(fitted, more, balanced=balanced).collect()
        assert {r.idx for r in norms} == set(range(6)) and all(r.gradient <= 1.01e-6 for r in norms if r.constant is None)
        assert {r.idx: r.constant for r in norms if r.constant is not None} == {2: 1.0}


def test_sparse_products_in_parts(monkeypatch):
    monkeypatch.setattr(ovr, "WORK_CELLS", 20)
    pick = np.random.default_rng(1)
    dense = pick.normal(size=(30, 9)) * (pick.random((30, 9)) < 0.4)
    dense[[0, 7, 8, 29]] = 0
    ids = [np.flatnonzero(r) for r in dense]
    rows = ovr.SparseRows.of(pd.Series(ids), pd.Series([r[i] for r, i in zip(dense, ids, strict=True)]))
    right, out = pick.normal(size=(30, 4)), np.zeros((9, 4))
    assert np.allclose(rows.times(pick.normal(size=(9, 4)) * 0 + 1), dense @ np.ones((9, 4)))
    rows.add_transposed(right, out)
    assert np.allclose(out, dense.T @ right)


def test_save_and_load(spark, trained):
    _, _, _, rows, fitted = trained
    path = scratch_path(spark, "model")
    model.save_model(fitted, path)
    loaded = model.load_model(spark, path)
    pick = lambda m: sorted((r["hadm_id"], r["scores"][0]) for r in m.predict(rows, "hadm_id").collect())
    assert [round(s, 6) for _, s in pick(loaded)] == [round(s, 6) for _, s in pick(fitted)]


def test_score_batches_checks_shape(rows):
    df = rows([(1, 0.2), (2, 0.4)], "id long, v double")

    def make():
        return lambda batch: np.stack([batch["v"], 1 - batch["v"]], axis=1)

    got = {r["id"]: [round(s, 4) for s in r["scores"]] for r in model.score_batches(df, make, ["id"], ["v"]).collect()}
    assert got == {1: [0.2, 0.8], 2: [0.4, 0.6]}
    with pytest.raises(PySparkException):
        model.score_batches(df, lambda: lambda batch: np.zeros(len(batch)), ["id"], ["v"]).collect()


def test_candidates_order_and_cases(rows):
    df = rows([(1, [0, 1, 3], [0, 2], [0.9, 0.4, 0.9, 0.4]), (2, [], [], [0.1] * 4)], "hadm_id long, labels_idx array<int>, pred_idx array<int>, scores array<float>")
    got = [(r["idx"], r["case_type"], r["rank"]) for r in explain.explain_candidates(df, ["hadm_id"]).orderBy("rank").collect()]
    assert got == [(0, "TP", 1), (2, "FP", 2), (1, "FN", 3)]


def test_best_chunk_takes_first_on_ties(rows):
    chunks = rows([(1, 0, [0.5]), (1, 1, [0.7]), (1, 2, [0.7])], "hadm_id long, chunk_no int, scores array<float>")
    row = explain.best_chunk(chunks, rows([(1, 0)], "hadm_id long, idx int")).first()
    assert row["best_chunk"] == 1 and row["chunk_score"] == pytest.approx(0.7)


def test_top_tokens(rows):
    df = rows([(["[CLS]", "a", "b", "c"], [9.0, 0.1, 0.5, 0.5])], "tokens array<string>, scores array<double>")
    top = lambda k: [(e["token"], e["score"]) for e in explain.top_tokens(df, k).first()["top"]]
    assert top(2) == [("b", 0.5), ("c", 0.5)] and len(top(99)) == 3
    with pytest.raises(ValueError):
        explain.top_tokens(df, 0)
    bad = rows([(["a"], [0.1, 0.2])], "tokens array<string>, scores array<double>")
    with pytest.raises(PySparkException):
        explain.top_tokens(bad, 1).collect()


def test_explain_split_end_to_end(trained):
    docs, mapping, tfidf, _, fitted = trained
    got = explaining.explain_split(docs, mapping, tfidf, fitted, 0.5, n_docs=10)
    rows = got.collect()
    assert rows and {r["meta"]["case_type"] for r in rows} <= {"TP", "FP", "FN"}
    for r in rows:
        assert r["example_id"] == f"{r['meta']['subject_id']}_{r['meta']['hadm_id']}_{r['target_idx']}"
        assert len(r["tokens"]) == len(r["scores"]) and min(r["scores"]) >= 0
    best = explain.choose_explanation(got, "max_prob").first()
    assert best["meta"]["pred_prob"] == max(r["meta"]["pred_prob"] for r in rows)
    assert explain.filter_explanations(got, example_id=best["example_id"], doc=-1).count() == 1
    with pytest.raises(DataCheckError):
        explain.filter_explanations(got, code="ZZ", check=True)
    with pytest.raises(ValueError):
        explain.choose_explanation(got, "nope")


def test_training_plan(spark, trained):
    docs, mapping, *_ = trained
    path = scratch_path(spark, "run")
    rows = training.train_linear({"train": docs, "val": docs, "test": docs}, mapping, path, config=features.TfidfConfig(mode="word"), min_pos=1)
    test = rows["test"].first()
    assert test["thr_kind"] == "per_label" and test["thr_notes"] == "loaded" and test["micro_f1"] > 0.95
    assert spark.read.parquet(f"{path}/metrics").count() == 2
    tfidf, fitted = training.load_run(spark, path, "tfidf_lr")
    assert tfidf.n_features == fitted.n_features


def test_blocks_carry_the_order_of_their_features(rows):
    """Passes over the documents read the order instead of sorting; any order of parts gives the same sums."""
    df = rows([([0], [3, 1, 7], [1.0, 2.0, 3.0]), ([], [], []), ([1], [1, 3], [4.0, 5.0])], "labels_idx array<int>, feature_ids array<int>, feature_values array<float>")
    got = []
    for block in ovr.sparse_blocks(df.coalesce(1)).collect():
        known = ovr.SparseRows(np.frombuffer(block.starts, np.int64), np.frombuffer(block.ids, np.int32),
                               np.frombuffer(block.vals, np.float32).astype(float), np.frombuffer(block.by_id, np.int32))
        assert (np.diff(known.ids[known.by_id]) >= 0).all()
        out = np.zeros((8, 2))
        known.add_transposed(np.ones((block.n, 2)), out)
        got.append(out)
    assert sum(got)[:, 0].tolist() == [0, 6, 0, 6, 0, 0, 0, 3]
