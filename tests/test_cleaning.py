import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.functions import cleaning as fx
from tagloom.functions import paths as px
from tagloom.operators import cleaning


def one(df, column="v"):
    return [r[column] for r in df.collect()]


def test_filter_category_strips_lowers_and_survives_missing_column(rows):
    df = rows([(1, " Discharge Summary\t"), (2, "nursing"), (3, None)], "id int, category string")
    assert one(cleaning.filter_category(df, "discharge summary"), "id") == [1]
    plain = df.drop("category")
    assert cleaning.filter_category(plain, "x") is plain
    with pytest.raises(cleaning.DataCheckError):
        cleaning.filter_category(df, "radiology", check=True)


def test_filter_category_exact_is_case_sensitive(rows):
    df = rows([("A", "t"), ("a", "t"), ("A", None)], "category string, text string")
    assert cleaning.filter_category_exact(df, "A").count() == 1


def test_select_required_drops_nulls_and_reports_missing(rows):
    df = rows([(1, "a"), (None, "b"), (2, None)], "hadm_id int, code string")
    assert cleaning.select_required(df, ["hadm_id", "code"]).count() == 1
    with pytest.raises(cleaning.DataCheckError):
        cleaning.select_required(df, ["nope"])


@pytest.mark.parametrize("raw,want", [
    ("a\r\nb\rc", "a\nb\nc"),
    ("a \t  b", "a b"),
    ("\n\t a b \u00a0\u2003\n", "a b"),
    ("\x1c\x1fa\x1d", "a"),
    ("a\n\nb", "a\n\nb"),
    (" \n ", ""),
    ("a" + " " * 5000 + "b" + "\n" * 5000, "a b"),
])
def test_normalize_text(rows, raw, want):
    df = rows([(raw,)], "text string")
    assert one(cleaning.normalize_text(df), "text") == [want]


def test_drop_short_counts_characters_not_bytes(rows):
    df = rows([("é" * 50,), ("e" * 49,)], "text string")
    assert cleaning.drop_short(df, 50).count() == 1
    with pytest.raises(ValueError):
        cleaning.drop_short(df, 0)


def test_enforce_types_fails_on_bad_id(rows):
    ok = rows([(" 12 ",), (None,)], "hadm_id string")
    assert one(cleaning.enforce_types(ok, ["hadm_id"]), "hadm_id") == [12, None]
    with pytest.raises(PySparkException):
        cleaning.enforce_types(rows([("12x",)], "hadm_id string"), ["hadm_id"]).collect()


def test_normalize_code_keeps_leading_zeros(rows):
    df = rows([(" 0042\n",), ("v30.01\u00a0",)], "code string")
    assert one(cleaning.normalize_code(df), "code") == ["0042", "V30.01"]


@pytest.mark.parametrize("cell,want", [
    (None, []), ("", []), ("  ", []),
    ('["250.00", " v30 ", ""]', ["25000", "V30"]),
    ("[401, 2]", ["401", "2"]),
    ("a, b.1,,", ["A", "B1"]),
    ("[broken", ["[BROKEN"]),
    ("[broken]", ["[BROKEN]"]),
    ("4019", ["4019"]),
])
def test_normalize_labels_text(rows, cell, want):
    df = rows([(cell,)], "c string").select(fx.normalize_labels(F.col("c"), remove_dots=True).alias("v"))
    assert one(df) == [want]


def test_normalize_labels_switches(rows):
    df = rows([(' ["a.b", ""] ',), ("a,b",)], "c string")
    off = dict(uppercase=False, parse_json_list=False, split_commas=False)
    assert one(df.select(fx.normalize_labels(F.col("c"), **off).alias("v"))) == [['["a.b", ""]'], ["a,b"]]
    keep = fx.normalize_labels(F.col("c"), drop_empty=False, uppercase=False)
    assert one(df.select(keep.alias("v"))) == [["a.b", ""], ["a", "b"]]


def test_label_list_forms(rows):
    lists = rows([(["a ", None, "b.c"],), (None,)], "l array<string>")
    assert one(lists.select(fx.normalize_label_list(F.col("l")).alias("v"))) == [["A", "B.C"], []]
    assert one(lists.select(fx.label_list_to_json(F.col("l")).alias("v")))[1] == "[]"
    text = rows([('["a"]',), ("a",), (None,), (" [x] ",)], "c string")
    assert one(text.select(fx.labels_any_to_list(F.col("c")).alias("v"))) == [["a"], ["a"], [], [" [x] "]]
    assert one(text.select(fx.labels_to_json(F.col("c")).alias("v"))) == ['["a"]', '["a"]', "[]", '["[x]"]']


def test_coerce_index_cell(rows):
    good = rows([("[1, 2]",), ("",), (None,), (" [3] ",)], "c string")
    assert one(good.select(fx.coerce_index_cell(F.col("c")).alias("v"))) == [[1, 2], [], [], [3]]
    for bad in ("[-1]", "[x]", "7"):
        with pytest.raises(PySparkException):
            rows([(bad,)], "c string").select(fx.coerce_index_cell(F.col("c")).alias("v")).collect()


@pytest.mark.parametrize("value,absolute", [
    ("/data/x", True), ("C:\\x", True), ("s3:/b", True), ("\\\\share\\x", True), ("https://x", False), ("data/x", False), (None, False),
])
def test_looks_absolute(rows, value, absolute):
    df = rows([(value,)], "c string").select(px.looks_absolute(F.col("c")).alias("v"))
    assert one(df) == [absolute]


def test_sanitize_and_assert_paths(rows):
    df = rows([("/root/a/b.txt", "/keep", ["/x/y.z", "n"]), ("/else/c.txt", "k", None)], "FilePath string, note string, refs array<string>")
    out = cleaning.sanitize_path_columns(df, "/root")
    assert [tuple(r)[:2] for r in out.collect()] == [("a/b.txt", "/keep"), ("c.txt", "k")]
    cleaning.assert_no_absolute(out)
    with pytest.raises(cleaning.DataCheckError):
        cleaning.assert_no_absolute(df)
    with pytest.raises(cleaning.DataCheckError):
        cleaning.assert_no_absolute(out, payload="note")
    assert one(cleaning.sanitize_json_paths(df, "refs", "/root"), "refs") == [["y.z", "n"], None]


def test_invariants(rows):
    good = rows([(1, 1, "t", ["A"])], "subject_id long, hadm_id long, text string, labels array<string>")
    cleaning.check_invariants(good)
    with pytest.raises(cleaning.DataCheckError, match="duplicate_keys"):
        cleaning.check_invariants(good.union(good))
    cleaning.check_invariants(good.union(good), unique_key=None)
    with pytest.raises(cleaning.DataCheckError, match="empty_table"):
        cleaning.check_invariants(good.limit(0))


def test_payload_check_reads_all_rows(rows):
    df = rows([("plain",)] * 60 + [("/home/someone/file.txt",)], "note string")
    with pytest.raises(cleaning.DataCheckError):
        cleaning.assert_no_absolute(df, payload="note")
    cleaning.assert_no_absolute(df.limit(10), payload="note", payload_rows=10)
