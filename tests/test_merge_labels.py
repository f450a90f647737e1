import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.operators import labels, merge
from tagloom.operators.cleaning import DataCheckError
from tagloom.operators.rank import global_rank

NOTE = "note_id long, subject_id long, hadm_id long, text string"


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_keep_longest_breaks_ties_by_note(rows):
    df = rows([(2, 1, 9, "bbb"), (1, 1, 9, "aaa"), (3, 1, 9, "c"), (4, 2, 8, "x")], NOTE)
    assert tuples(merge.dedupe_keep_longest(df)) == [(1, 1, 9, "aaa"), (4, 2, 8, "x")]


def test_concat_groups_by_subject_and_admission_in_note_order(rows):
    df = rows([(2, 1, 9, "b"), (1, 1, 9, "a"), (3, 2, 9, "c")], NOTE)
    assert tuples(merge.dedupe_concat(df)) == [(1, 9, 0, "a\n\nb", 2), (2, 9, 0, "c", 1)]
    assert tuples(merge.dedupe_concat(df, sep="'|\\"))[0][3] == "a'|\\b"


def test_concat_keeps_oversized_groups_whole_in_parts(rows):
    data = [(i, 1, 9, f"t{i}") for i in range(0, 9000, 1000)] + [(1, 2, 8, "small")]
    parts = tuples(merge.dedupe_concat(rows(data, NOTE), sep="|", max_cell_chars=20))
    assert [p[2] for p in parts if p[1] == 9] == [0, 1, 2]
    assert all(len(p[3]) <= 20 + len("|t8000") for p in parts)
    assert "|".join(p[3] for p in parts if p[1] == 9) == "|".join(f"t{i}" for i in range(0, 9000, 1000))
    assert (2, 8, 0, "small", 1) in parts


def test_concat_numbers_parts_without_gaps_and_counts_labels_once(rows, monkeypatch):
    data = [(i, 1, 9, "x" * n) for i, n in enumerate([30, 30, 3, 100, 3, 3])] + [(7, 1, 8, "small")]
    parts = tuples(merge.dedupe_concat(rows(data, NOTE), sep="|", max_cell_chars=40))
    assert [p[2] for p in parts if p[1] == 9] == list(range(len(parts) - 1)) and len(parts) > 3
    assert "|".join(p[3] for p in parts if p[1] == 9) == "|".join("x" * n for n in [30, 30, 3, 100, 3, 3])
    monkeypatch.setattr(merge.dedupe_concat, "__defaults__", ("|", "note_id", 40))
    merged = merge.merge_notes_labels(rows(data, NOTE), rows([(9, ["A"]), (8, ["A"])], "hadm_id long, labels array<string>"))
    assert merged.selectExpr("explode(labels)").count() == 2 and merged.count() == len(parts)


def test_aggregate_and_merge(rows):
    codes = rows([(9, "B"), (9, "A"), (9, "B"), (7, "Z")], "hadm_id long, code string")
    grouped = merge.aggregate_labels(codes)
    assert tuples(grouped) == [(7, ["Z"]), (9, ["A", "B"])]
    notes = rows([(1, 1, 9, "aaa"), (2, 2, 8, "x")], NOTE)
    assert tuples(merge.merge_notes_labels(notes, grouped, "longest")) == [(1, 9, "aaa", ["A", "B"])]
    with pytest.raises(DataCheckError):
        merge.merge_notes_labels(notes.filter("hadm_id = 8"), grouped, "longest", check=True)
    raw = merge.expand_code_counts(merge.merge_raw(notes, codes))
    assert [r["labels"] for r in raw.collect()] == [["A", "B", "B"]]


def test_hot_admission_is_grouped_whole(spark):
    n = 30_000
    codes = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("hadm_id"), (F.col("id") % 97).cast("string").alias("code")
    )
    hot = merge.aggregate_labels(codes).filter("hadm_id = 0").first()
    assert len(hot["labels"]) == 97


def test_sampling_and_overlaps(rows):
    df = rows([(i, "train" if i % 2 else "val") for i in range(20)], "subject_id long, split string")
    five = merge.sample_keys(df, "subject_id", 5, 1)
    assert five.count() == 5 and tuples(five) == tuples(merge.sample_keys(df.repartition(7), "subject_id", 5, 1))
    assert tuples(five) != tuples(merge.sample_keys(df, "subject_id", 5, 2))
    assert merge.sample_keys(df, "subject_id", 99, 1).count() == 20
    merge.check_disjoint(df, ["subject_id"])
    with pytest.raises(ValueError):
        merge.check_disjoint(df.union(rows([(1, "test")], df.schema)), ["subject_id"])
    with pytest.raises(DataCheckError):
        merge.intersect_sample_keys(df, df.filter("subject_id > 99"), 3, 1, key="subject_id", check=True)


FREQ = [("A", 50), ("B", 30), ("C", 10), ("D", 5), ("E", 5)]


@pytest.mark.parametrize("target,at_least,size", [
    (0.5, None, 1), (0.51, None, 2), (0.8, None, 2), (0.0, None, 1), (1.0, None, 5), (0.5, 3, 3), (0.5, 99, 5),
])
def test_target_coverage(rows, target, at_least, size):
    curve = labels.coverage_curve(rows(FREQ, "code string, n long"))
    assert labels.select_codes_target_coverage(curve, target, at_least).count() == size


def test_curve_and_map(rows):
    curve = labels.coverage_curve(rows(FREQ, "code string, n long"))
    got = curve.orderBy("rank").collect()
    assert [r["code"] for r in got] == ["A", "B", "C", "D", "E"]
    assert [r["cum_n"] for r in got] == [50, 80, 90, 95, 100] and got[-1]["coverage"] == 1.0
    chosen = labels.select_codes_fixed_k(curve, 2)
    assert tuples(labels.build_label_map(chosen)) == [("A", 0), ("B", 1)]
    with pytest.raises(DataCheckError):
        labels.build_label_map(labels.select_codes_fixed_k(curve, 1), strict=True)
    grid = labels.coverage_grid(curve, 2, [1, 50])
    assert tuples(grid) == [(1, 1, 0.5), (2, 2, 0.8), (50, 5, 1.0)]


def test_saved_frequency_coerces_counts(rows):
    df = rows([(" a ", "3"), ("b", "x"), ("c", None), ("d", "4.0")], "code string, count string")
    assert tuples(labels.saved_label_frequency(df)) == [("A", 3), ("B", 0), ("C", 0), ("D", 4)]


def test_label_frequency_total_is_before_top_k(rows):
    df = rows([(["A", "B"],), (["A", None],), (["C"],)], "labels array<string>")
    assert [tuple(r) for r in labels.label_frequency(df, 1).collect()] == [("A", 2, 0.5)]


MAP = [("A", 0), ("B", 1), ("C", 2)]
ROWS = [(1, 10, ["a ", "B", "B", "X"]), (1, 11, []), (2, 12, ["X", "Y"]), (3, 13, None)]
ROW_SCHEMA = "subject_id long, hadm_id long, labels array<string>"


def test_encoding_keeps_unlabelled_rows(rows):
    df, mapping = rows(ROWS, ROW_SCHEMA), rows(MAP, "code string, idx int")
    enc = labels.encode_labels(df, mapping)
    assert tuples(enc.select("hadm_id", "labels_idx")) == [(10, [0, 1]), (11, []), (12, []), (13, [])]
    looked = labels.lookup_label_idx(df, mapping, "hadm_id")
    assert [tuple(r) for r in labels.unknown_codes_top(looked).collect()] == [("X", 2), ("Y", 1)]
    stats = labels.encoding_stats(enc, looked, 3).first()
    assert (stats.n_rows, stats.nnz, stats.unknown) == (4, 2, 3)
    assert stats.density == pytest.approx(2 / 12) and stats.unknown_rate == pytest.approx(3 / 5)
    assert tuples(labels.multi_hot(enc, 3)) == [(10, 0), (10, 1)]
    with pytest.raises(PySparkException):
        labels.multi_hot(enc, 1).collect()
    assert labels.multi_hot_dense(enc, 3).filter("hadm_id = 10").first()["y"] == [1, 1, 0]
    with pytest.raises(DataCheckError):
        labels.check_multi_hot(enc.filter("hadm_id <> 10"))
    assert [r["position"] for r in labels.encoding_samples(enc).orderBy("position").collect()] == [1, 2, 4]
    assert tuples(labels.label_counts(enc, mapping)) == [(0, 1), (1, 1), (2, 0)]
    assert tuples(labels.subject_label_union(enc)) == [(1, [0, 1]), (2, []), (3, [])]
    assert tuples(labels.labels_per_note_hist(enc)) == [(0, 3), (1, 0), (2, 1)]


def test_pos_weight_is_clipped(rows):
    enc = rows([(i, [0] if i else [0, 1]) for i in range(20)], "hadm_id long, labels_idx array<int>")
    weights = labels.pos_weight(enc, rows(MAP, "code string, idx int"))
    assert tuples(weights) == [(0, 1.0), (1, 12.0), (2, 12.0)]
    assert labels.pos_weight(enc, None, None) is None and labels.pos_weight(enc, None, " None ") is None
    with pytest.raises(ValueError):
        labels.pos_weight(enc, rows(MAP, "code string, idx int"), [1.0])


def jsd(a, b):
    p, q = [x / max(sum(a), 1e-12) for x in a], [x / max(sum(b), 1e-12) for x in b]
    m = [(x + y) / 2 for x, y in zip(p, q)]
    kl = lambda u: sum(x * math.log((x + 1e-12) / (y + 1e-12)) for x, y in zip(u, m))
    return (kl(p) + kl(q)) / 2


counts = st.lists(st.integers(0, 50), min_size=4, max_size=4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts, counts)
def test_js_divergence_matches_definition(rows, a, b):
    table = rows(list(zip("abcd", a, b)), "code string, n_a long, n_b long")
    got = labels.js_divergence(table).first()["jsd"]
    assert got == pytest.approx(jsd(a, b), abs=1e-9)
    assert -1e-9 <= got <= math.log(2) + 1e-9


def test_align_counts_fills_both_sides(rows):
    a = rows([("A", 1)], "code string, n long")
    b = rows([("B", 2)], "code string, n long")
    assert tuples(labels.align_counts(a, b)) == [("A", 1, 0), ("B", 0, 2)]


def test_global_rank_and_running_sum_over_ties(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    ranked = global_rank(df, [F.desc("g"), F.asc("id")], running={"id": "cum"}, total="n").orderBy("rank").collect()
    want = sorted(((i % 3, i) for i in range(5000)), key=lambda t: (-t[0], t[1]))
    assert [(r["g"], r["id"]) for r in ranked] == want
    assert [r["rank"] for r in ranked] == list(range(1, 5001)) and ranked[0]["n"] == 5000
    running, sums = 0, []
    for _, i in want:
        running += i
        sums.append(running)
    assert [r["cum"] for r in ranked] == sums


def test_write_splits_keeps_every_split_name(spark, rows, tmp_path):
    from tagloom.operators.cleaning import DataCheckError
    from tagloom.plans.dataset import write_splits
    from tagloom.sources.readers import read_split

    data = rows([(s, 10 + s, f"text {s}", ["A"]) for s in range(4)], "subject_id long, hadm_id long, text string, labels array<string>")
    assigned = rows([(0, "train"), (1, "val"), (2, "holdout"), (3, "train")], "subject_id long, split string")
    placed = write_splits(data, assigned, str(tmp_path))
    assert placed.count() == 4
    assert [r.hadm_id for r in read_split(spark, f"{tmp_path}/holdout.jsonl").collect()] == [12]
    assert sorted(r.hadm_id for r in read_split(spark, f"{tmp_path}/train.jsonl").collect()) == [10, 13]
    with pytest.raises(DataCheckError):
        write_splits(data, rows([(0, None)], "subject_id long, split string"), str(tmp_path))


def test_longest_note_is_chosen_without_moving_texts_that_nobody_reads(rows):
    df = rows([(9, 1, 7, "abc"), (8, 2, 7, "abc"), (1, 3, 7, "ab"), (4, None, 5, "x")], "note_id long, subject_id long, hadm_id long, text string")
    ids = merge.dedupe_keep_longest(df).select("hadm_id", "subject_id")
    assert sorted(map(tuple, ids.collect()), key=repr) == [(5, None), (7, 2)]
    aggregates = [n for n in ids._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in n]
    assert aggregates and not any("text, text#" in n for n in aggregates)
