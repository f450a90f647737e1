import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.operators import cleaning
from tagloom.operators.cleaning import DataCheckError
from tagloom.plans import dataset
from tagloom.sources import readers, writers
from tagloom.streaming.stateless import clean_notes_stream

NOTES = (
    b"ROW_ID,SUBJECT_ID,HADM_ID,CATEGORY,TEXT\n"
    b'1,10,100,Discharge summary,"line one\nsaid ""hi"", ok"\n'
    b"2,11,101,Nursing,bad \xff byte\n"
    b"3,12\n"
    b"4,13,103,Nursing,long,extra,cells\n"
    b"5,,104,NA,x\n"
    b"6,1x,105,Nursing,y\n"
)


@pytest.fixture
def notes_gz(tmp_path):
    path = tmp_path / "notes.csv.gz"
    path.write_bytes(gzip.compress(NOTES))
    return str(path)


def test_notes_csv_tolerance(spark, notes_gz):
    rows = {r["subject_id"]: r for r in readers.read_notes_csv(spark, notes_gz).collect()}
    assert rows["10"]["text"] == 'line one\nsaid "hi", ok'
    assert rows["11"]["text"] == "bad � byte"
    assert rows["12"]["text"] is None and rows["12"]["hadm_id"] is None
    assert rows["13"]["text"] == "long"
    assert rows[None]["category"] is None
    assert len(rows) == 6
    strict = readers.read_notes_csv(spark, notes_gz, skip_long_rows=True)
    assert strict.filter("subject_id = '13'").isEmpty() and strict.count() == 5
    assert readers.read_notes_csv(spark, notes_gz, max_rows=2).count() == 2
    assert readers.read_notes_csv(spark, notes_gz, max_rows=-1).count() == 6
    with pytest.raises(PySparkException):
        cleaning.enforce_types(strict.select("subject_id"), ["subject_id"]).collect()


def test_notes_without_category_and_missing_columns(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("hadm_id,Text,subject_id\n1,a,2\n")
    df = readers.read_notes_csv(spark, str(path))
    assert df.columns == ["subject_id", "hadm_id", "text"] and df.first()["text"] == "a"
    with pytest.raises(DataCheckError):
        readers.read_codes_csv(spark, str(path))


def test_codes_keep_leading_zeros(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("ROW_ID,HADM_ID,ICD9_CODE\n1,5,0042\n2,5,\n")
    assert [r["code"] for r in readers.read_codes_csv(spark, str(path)).collect()] == ["0042", None]


def test_jsonl_tolerance(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    lines = [
        json.dumps({"text": "a", "labels": ["x.1", " y "], "hadm_id": 1, "subject_id": 2}),
        "not json", "[1, 2]", "",
        json.dumps({"text": "b", "labels": "p, q.2", "hadm_id": "3", "subject_id": 4}),
        json.dumps({"text": "c", "labels": '["z"]', "hadm_id": 5, "subject_id": 6}),
        json.dumps({"text": "d", "hadm_id": 7, "subject_id": 8}),
    ]
    path.write_text("\n".join(lines))
    loose = {r["hadm_id"]: r["labels"] for r in readers.read_jsonl(spark, str(path)).collect()}
    assert loose == {1: ["x.1", " y "], 3: [], 5: [], 7: []}
    assert readers.malformed_lines(spark, str(path)).first()["n_malformed"] == 2
    strict = {r["hadm_id"]: r["labels"] for r in readers.read_split(spark, str(path)).collect()}
    assert strict == {1: ["X1", "Y"], 3: ["P", "Q2"], 5: ["Z"], 7: []}
    assert readers.read_jsonl(spark, str(path), nrows=2).count() == 1
    bare = tmp_path / "b.jsonl"
    bare.write_text(lines[-1])
    with pytest.raises(DataCheckError):
        readers.read_split(spark, str(bare))


MERGED = "subject_id long, hadm_id long, text string, labels array<string>"


def test_table_round_trips(spark, rows, tmp_path):
    df = rows([(1, 2, 'a "q", b\nc', ["x", "é,y"]), (3, 4, "t", []), (5, 6, "u", None)], MERGED)
    want = [(1, ["x", "é,y"]), (3, []), (5, [])]
    show = lambda d: sorted((r["subject_id"], r["labels"]) for r in d.collect())
    writers.write_csv_json_labels(df, f"{tmp_path}/t.csv", root="/root")
    back = readers.read_table(spark, f"{tmp_path}/t.csv")
    assert show(back) == want and back.filter("subject_id = 1").first()["text"] == 'a "q", b\nc'
    writers.write_parquet(df, f"{tmp_path}/t.parquet")
    assert show(readers.read_table(spark, f"{tmp_path}/t.parquet")) == want
    writers.write_jsonl(df, f"{tmp_path}/t.jsonl")
    assert show(readers.read_jsonl(spark, f"{tmp_path}/t.jsonl")) == want
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{tmp_path}/t.orc")
    text_labels = df.withColumn("labels", F.lit('["k"]'))
    writers.write_parquet(text_labels, f"{tmp_path}/u.parquet")
    assert readers.read_table(spark, f"{tmp_path}/u.parquet").first()["labels"] == ["k"]


def test_min_columns_prunes_and_coerces(spark, rows, tmp_path):
    df = rows([(1, 2, "t", "[3, 1]"), (None, 5, "u", "[1]"), (7, 8, "v", None)], "subject_id long, hadm_id long, text string, labels_idx string")
    df.write.parquet(f"{tmp_path}/e")
    got = readers.read_min_columns(spark, f"{tmp_path}/e")
    assert sorted((r["subject_id"], r["labels_idx"]) for r in got.collect()) == [(1, [3, 1]), (7, [])]
    assert "text" not in got._jdf.queryExecution().executedPlan().toString()


def test_label_map_round_trip_and_checks(spark, rows, tmp_path):
    good = rows([("B", 1), ('A"x', 0)], "code string, idx int")
    writers.save_label_map(good, f"{tmp_path}/m")
    assert sorted(map(tuple, readers.load_label_map(spark, f"{tmp_path}/m").collect())) == [('A"x', 0), ("B", 1)]
    (tmp_path / "plain.json").write_text('{\n "a": 0,\n "b": 1\n}')
    assert readers.load_label_map(spark, f"{tmp_path}/plain.json").count() == 2
    for bad in ([("A", 0), ("B", 2)], [("A", 0), ("B", 0)], [("A", 1)], [("A", 0), ("A", 1)]):
        with pytest.raises(DataCheckError):
            writers.save_label_map(rows(bad, "code string, idx int"), f"{tmp_path}/bad")


def test_thresholds_round_trip(spark, rows, tmp_path):
    assert readers.load_thresholds(spark, f"{tmp_path}/none") == ("global", 0.5)
    writers.save_thresholds(spark, 0.35, f"{tmp_path}/g")
    assert readers.load_thresholds(spark, f"{tmp_path}/g") == ("global", 0.35)
    writers.save_thresholds(spark, rows([(1, 0.2), (0, 0.1)], "idx int, tau double"), f"{tmp_path}/v", "per_label")
    kind, taus = readers.load_thresholds(spark, f"{tmp_path}/v")
    assert kind == "per_label" and [round(r["tau"], 3) for r in taus.orderBy("idx").collect()] == [0.1, 0.2]
    with pytest.raises(ValueError):
        writers.save_thresholds(spark, 0.5, f"{tmp_path}/x", "other")


def test_metrics_union(spark, rows, tmp_path):
    for i in range(2):
        writers.append_metrics(rows([("a", 0.1 * i)], "run_name string, `micro_f1 ` double"), f"{tmp_path}/m")
    got = readers.load_metrics_union(spark, [f"{tmp_path}/m", f"{tmp_path}/missing"])
    assert got.count() == 2 and "micro_f1" in got.columns
    with pytest.raises(DataCheckError):
        readers.load_metrics_union(spark, [f"{tmp_path}/missing"])


def test_split_ids_are_sorted(spark, rows, tmp_path):
    df = rows([(10, "val"), (9, "val"), (9, "val"), (1, "train")], "subject_id long, split string")
    writers.write_split_ids(df, f"{tmp_path}/ids")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/ids/split=val").collect()] == ["9", "10"]


def test_explanations_need_tokens(spark, tmp_path):
    schema = "tokens array<string>, scores array<double>"
    (tmp_path / "ok.jsonl").write_text('{"tokens": ["a"], "scores": [1.0]}\n\n')
    assert readers.read_explanations(spark, f"{tmp_path}/ok.jsonl", schema).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"tokens": ["a"]}\n')
    with pytest.raises(DataCheckError):
        readers.read_explanations(spark, f"{tmp_path}/bad.jsonl", schema)


def test_prepare_dataset_with_concat(spark, rows, tmp_path):
    notes = rows([(1, 1, 9, "D", "a" * 60), (2, 1, 9, "d ", "b" * 60), (3, 2, 8, "D", "short")],
                 "note_id long, subject_id long, hadm_id long, category string, text string")
    codes = rows([("9", " x1"), ("9", "X1"), ("8", "z")], "hadm_id string, code string")
    out = dataset.prepare_dataset(notes, codes, f"{tmp_path}/d", dataset.DatasetConfig(category="D")).collect()
    assert [(r["hadm_id"], r["labels"], len(r["text"])) for r in out] == [(9, ["X1"], 122)]


def test_cleaning_runs_on_a_stream(spark, rows, tmp_path):
    schema = "note_id long, subject_id long, hadm_id long, category string, text string"
    rows([(1, 1, 9, "D", "a" * 60), (2, 1, 9, "n", "b" * 60)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    clean_notes_stream(stream, "d", f"{tmp_path}/out", f"{tmp_path}/chk").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_splits_and_their_id_lists_come_from_one_evaluation_of_the_assignment(rows, tmp_path):
    """An assignment that is costly or differs from run to run is evaluated once for both."""

    @F.udf("string")
    def drawn(_):
        import os

        return "train" if os.urandom(1)[0] % 2 else "test"

    data = rows([(i, 100 + i, f"text {i}", ["A"]) for i in range(40)], "subject_id long, hadm_id long, text string, labels array<string>")
    assignment = data.select("subject_id").withColumn("split", drawn.asNondeterministic()("subject_id"))
    placed = dataset.write_splits(data, assignment, str(tmp_path))
    want = {(r["subject_id"], r["split"]) for r in placed.collect()}
    ids = data.sparkSession.read.text(f"{tmp_path}/ids")
    assert {(int(r["value"]), r["split"]) for r in ids.collect()} == want and len(want) == 40
