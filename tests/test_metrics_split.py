import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import metrics, split
from tagloom.operators.cleaning import DataCheckError
from tagloom.plans import evaluation
from tagloom.session import scratch_path

SCORED = "hadm_id long, labels_idx array<int>, scores array<float>"
MAP = [("A", 0), ("B", 1), ("C", 2)]
DATA = [(1, [0], [0.9, 0.5, 0.1]), (2, [0, 1], [0.4, 0.95, 0.1]), (3, [], [0.2, 0.6, 0.05])]


@pytest.fixture
def scored(rows):
    return rows(DATA, SCORED)


@pytest.fixture
def mapping(rows):
    return rows(MAP, "code string, idx int")


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_confusion_keeps_zero_support_labels(scored, mapping):
    predicted = metrics.apply_thresholds(scored, 0.5)
    assert [r["pred_idx"] for r in predicted.orderBy("hadm_id").collect()] == [[0, 1], [1], [1]]
    confusion = metrics.confusion_by_label(predicted, mapping)
    assert tuples(confusion) == [(0, 1, 0, 1), (1, 1, 2, 0), (2, 0, 0, 0)]
    row = metrics.f1_micro_macro(confusion).first()
    assert row["micro_f1"] == pytest.approx(4 / 7)
    assert row["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_per_label_thresholds_compare_as_float(rows, mapping):
    df = rows([(1, [0], [0.05, 0.15, 0.35])], SCORED)
    taus = rows([(0, 0.05), (1, 0.15), (2, 0.35)], "idx int, tau double")
    assert metrics.apply_thresholds(df, taus).first()["pred_idx"] == [0, 1, 2]
    assert [r["pred"] for r in metrics.join_thresholds(metrics.long_form(df, "hadm_id"), taus).collect()] == [1, 1, 1]


def test_precision_counts_unlabelled_rows_and_clips_k(rows):
    df = rows([(1, [0], [0.5, 0.5, 0.5]), (2, [], [0.1, 0.2, 0.3])], SCORED)
    row = metrics.precision_at_k(df, (1, 2, 99)).first()
    assert row["p_at_1"] == 0.5 and row["p_at_2"] == 0.25 and row["p_at_99"] == pytest.approx(1 / 6)
    with pytest.raises(ValueError):
        metrics.precision_at_k(df, (0,))


def brute(data, k, grid):
    """tp, fp, fn per (label, tau) straight from the definition."""
    import numpy as np

    out = {}
    for i in range(k):
        for g, tau in enumerate(grid, 1):
            t = np.float32(tau)
            p = [np.float32(s[i]) >= t for _, _, s in data]
            y = [i in labels for _, labels, _ in data]
            out[i, g] = (sum(a and b for a, b in zip(p, y)), sum(a and not b for a, b in zip(p, y)), sum(b and not a for a, b in zip(p, y)))
    return out


def test_grid_confusion_matches_brute_force(rows, mapping):
    import random

    rnd = random.Random(3)
    data = [(i, [j for j in range(3) if rnd.random() < 0.3], [round(rnd.choice([rnd.random(), 0.05 * rnd.randint(0, 20)]), 4) for _ in range(3)]) for i in range(60)]
    df = rows(data, SCORED)
    got = {(r["idx"], r["g"]): (r["tp"], r["fp"], r["fn"]) for r in metrics.grid_confusion(df, mapping).collect()}
    assert got == brute(data, 3, metrics.GRID)
    taus = {r["idx"]: r["tau"] for r in metrics.tune_label_thresholds(df, mapping, min_pos=1).collect()}
    f1 = lambda c: 2 * c[0] / (2 * c[0] + c[1] + c[2]) if sum(c) else 0.0
    for i in range(3):
        best = max(range(1, 20), key=lambda g: (f1(got[i, g]), -g))
        assert taus[i] == pytest.approx(metrics.GRID[best - 1])


def test_rare_labels_keep_base_and_first_best_wins(scored, mapping):
    taus = {r["idx"]: round(r["tau"], 4) for r in metrics.tune_label_thresholds(scored, mapping, base_tau=0.33, min_pos=2).collect()}
    assert taus[1] == 0.33 and taus[2] == 0.33 and taus[0] == 0.25
    best = metrics.tune_global_threshold(scored, mapping).first()
    assert best["tau"] == pytest.approx(0.25) or best["micro_f1"] > 0


def test_validate_scores(scored, rows):
    metrics.validate_scores(scored, 3)
    for bad in [(1, [3], [0.1, 0.1, 0.1]), (1, [], [0.1, 1.2, 0.1]), (1, [], [float("nan")] * 3), (1, [], [0.1]), (1, [], None)]:
        with pytest.raises(DataCheckError):
            metrics.validate_scores(rows([bad], SCORED), 3)


def test_chunks(rows):
    chunks = rows([(1, 0, [0.1, 0.9]), (1, 1, [0.3, 0.2]), (2, 0, [0.5, 0.5])], "hadm_id long, chunk_no int, scores array<float>")
    best = {r["hadm_id"]: [round(x, 4) for x in r["scores"]] for r in metrics.aggregate_chunk_scores(chunks).collect()}
    assert best == {1: [0.3, 0.9], 2: [0.5, 0.5]}
    mean = {r["hadm_id"]: [round(x, 4) for x in r["scores"]] for r in metrics.aggregate_chunk_scores(chunks, how="mean").collect()}
    assert mean[1] == [0.2, 0.55]
    with pytest.raises(ValueError):
        metrics.aggregate_chunk_scores(chunks, how="sum")


def test_chunk_scores_in_blocks_of_labels(rows):
    import random

    rng = random.Random(7)
    data = [(doc, n, [rng.choice([None, rng.random()]) for _ in range(rng.choice([0, 5, 8, 13]))]) for doc in range(6) for n in range(4)]
    data += [(90, 0, []), (90, 1, None), (91, 0, [None, 0.5])]
    chunks = rows(data, "hadm_id long, chunk_no int, scores array<float>")
    for how, combine in (("max", max), ("mean", lambda found: sum(found) / len(found))):
        expected = {}
        for doc in {d for d, _, s in data if s}:
            lists = [s for d, _, s in data if d == doc and s]
            cells = [[s[i] for s in lists if i < len(s) and s[i] is not None] for i in range(max(map(len, lists)))]
            expected[doc] = [round(combine(c), 5) if c else None for c in cells]
        got = {
            r["hadm_id"]: [None if x is None else round(x, 5) for x in r["scores"]]
            for r in metrics.aggregate_chunk_scores(chunks, how=how, width=4).collect()
        }
        assert got.keys() == expected.keys()
        for doc, cells in expected.items():
            assert got[doc] == pytest.approx(cells, abs=2e-5)


def test_chunk_scores_shuffle_no_row_per_label(rows):
    plan = metrics.aggregate_chunk_scores(rows([(1, 0, [0.1] * 200)], "hadm_id long, chunk_no int, scores array<float>"))
    assert plan.first()["scores"] == pytest.approx([0.1] * 200)
    assert "posexplode" not in plan._jdf.queryExecution().toString()


def test_last_run_per_name(rows):
    df = rows([("a", "test", 1, 0.1), ("a", "test", 2, 0.2), ("b", "test", 1, 0.3), ("a", "val", 9, 0.9)], "run_name string, split string, seq int, micro_f1 double")
    got = metrics.last_run_per_name(df, "test", ["b", "a"]).collect()
    assert [(r["run_name"], r["micro_f1"]) for r in got] == [("b", 0.3), ("a", 0.2)]
    with pytest.raises(DataCheckError):
        metrics.last_run_per_name(df, "test", ["a", "zz"], check=True)


def test_policies(spark, scored, mapping):
    saved, table = scratch_path(spark, "thr"), scratch_path(spark, "met")
    run = lambda split, policy: evaluation.evaluate_and_save(scored, mapping, "r", split, saved, table, policy, min_pos=1, ks=(1, 2)).first()
    assert run("test", "use_saved").thr_notes == "loaded"  # nothing saved yet: global 0.5
    assert run("test", "global_val").thr_notes == "t=0.50 [fallback]"
    assert run("val", "global_val").thr_kind == "global"
    assert run(" VAL ", "per_label_val").thr_kind == "per_label"
    after = run("test", "use_saved")
    assert after.thr_kind == "per_label" and after.N == 3 and after.K == 3
    assert spark.read.parquet(table).count() == 5
    with pytest.raises(ValueError):
        run("train", "fixed")


# --- Splits -------------------------------------------------------------------


def units(spark, n=400):
    labels = F.array_distinct(F.array((F.col("id") % 7).cast("int"), (F.col("id") % 3 + 7).cast("int")))
    return spark.range(n).select(
        (F.col("id") % 150).alias("subject_id"), F.col("id").alias("hadm_id"),
        F.when(F.col("id") % 11 == 0, F.array().cast("array<int>")).otherwise(labels).alias("labels_idx"),
    )


def test_random_split_sizes(spark):
    sizes = dict(split.split_subject_random(units(spark), 5, 0.2, 0.1).groupBy("split").count().collect())
    assert sizes == {"train": 105, "val": 30, "test": 15}
    tiny = dict(split.split_subject_random(units(spark).filter("subject_id < 3"), 5).groupBy("split").count().collect())
    assert tiny == {"train": 1, "val": 1, "test": 1}
    with pytest.raises(ValueError):
        split.split_subject_random(units(spark), 5, 0.6, 0.5)


@pytest.mark.parametrize("make,key", [(split.split_subject_stratified, "subject_id"), (split.split_rows_stratified, "hadm_id")])
def test_stratified_split_is_a_partition_and_reproducible(spark, make, key):
    df = units(spark)
    got = make(df, 7)
    n = df.select(key).distinct().count()
    assert got.count() == n and got.select(key).distinct().count() == n
    sizes = dict(got.groupBy("split").count().collect())
    assert abs(sizes["test"] - 0.15 * n) <= 1 and abs(sizes["val"] - 0.15 * n) <= 1
    assert tuples(got) == tuples(make(df.repartition(13), 7))
    assert tuples(got) != tuples(make(df, 8))


def test_hot_stratum_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("hadm_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1))).alias("labels_idx"))
    got = split.split_rows_stratified(df, 1).join(df, "hadm_id").groupBy("split", F.col("labels_idx")[0].alias("l")).count().collect()
    share = {(r["split"], r["l"]): r["count"] for r in got}
    assert abs(share["test", 0] - 300) <= 1 and abs(share["test", 1] - 150) <= 1


def test_mini_splits(spark):
    df = units(spark).withColumn("split", F.lit("train")).withColumn("labels", F.transform("labels_idx", lambda i: i.cast("string")))
    mini = split.make_mini_splits(df, 1, {"train": 20})
    assert mini.select("subject_id").distinct().count() == 20
    full = df.join(mini.select("subject_id").distinct(), "subject_id", "left_semi")
    assert full.count() == mini.count()


def test_thresholds_are_addressed_by_label(rows):
    scored = rows([(1, [0.9, 0.6, 0.6, 0.2])], "hadm_id long, scores array<float>")
    taus = rows([(0, 0.95), (2, 0.5)], "idx int, tau double")
    assert metrics.apply_thresholds(scored, taus).first()["pred_idx"] == [1, 2]
    long = rows([(1, 0, 0.9), (1, 3, 0.6)], "hadm_id long, idx int, score float")
    assert {r["idx"]: r["pred"] for r in metrics.join_thresholds(long, taus).collect()} == {0: 0, 3: 1}


def test_small_splits_are_not_empty(rows):
    for n in (3, 4, 5, 7):
        df = rows([(i, [i % 2]) for i in range(n)], "hadm_id long, labels_idx array<int>")
        names = [r["split"] for r in split.split_rows_stratified(df, 1).collect()]
        assert len(names) == n and set(names) == {"train", "val", "test"}


def test_quota_split_keeps_label_shares(spark):
    """Every unit once, the same again, and no label farther from its share than the systematic split's worst one."""
    pick = random.Random(8)
    weights = [1 / (i + 1) for i in range(40)]
    data = [(i, [] if i % 50 == 0 else pick.choices(range(40), weights, k=pick.randint(1, 6))) for i in range(1500)] + [(9000, None), (9001, [39, 39])]
    df = spark.createDataFrame(data, "hadm_id long, labels_idx array<int>").repartition(5)
    even = split.quota_split(df, "hadm_id", 3).cache()
    again = split.split_rows_iterative(df.coalesce(1), 3)
    assert sorted((r["hadm_id"], r["split"]) for r in even.collect()) == sorted((r["hadm_id"], r["split"]) for r in again.collect())
    assert sorted(r["hadm_id"] for r in even.collect()) == sorted(i for i, _ in data)
    assert all(abs(r["count"] / 1502 - (0.7 if r["split"] == "train" else 0.15)) < 0.02 for r in even.groupBy("split").count().collect())

    def off(assigned):
        return {(r["idx"], r["split"]): abs(r["n"] - r["desired"]) for r in split.label_balance(assigned).collect()}

    mine, other = off(even), off(df.join(split.split_rows_stratified(df, 3), "hadm_id"))
    assert len(mine) == 120 and max(mine.values()) < max(other.values()) and sum(mine.values()) < sum(other.values())


def test_quota_split_of_little(spark):
    schema = "hadm_id long, labels_idx array<int>"
    assert split.split_rows_iterative(spark.createDataFrame([], schema), 1).count() == 0
    assert split.split_rows_iterative(spark.createDataFrame([(1, [])], schema), 1).count() == 1
