import math
import random
import re
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tagloom.catalog.features import _rows, q_tfidf_char
from tagloom.functions import text as fx
from tagloom.operators import features, grams, text
from tagloom.session import scratch_path


def toks(rows, value, **kw):
    return text.tokenize(rows([(value,)], "text string"), **kw).first()["tokens"]


@pytest.mark.parametrize("raw,want", [
    (None, []), ("", []), ("!!! --- …", []),
    ("Hello, World!", ["hello", "world"]),
    ("beta-blocker (x2) 12 mg 5", ["beta-blocker", "x2", "<NUM>", "mg", "5"]),
    ("a1b22c", ["<NUM>"]), ("<NUM>", ["num"]),
    ("ﬁne １２ ٣٤ naïve", ["fine", "<NUM>", "<NUM>", "naïve"]),
    ("“quoted” ‘x’ $5.00", ["quoted", "x", "<NUM>"]),
    ("a\x00b\u200bc\u00a0d\ne", ["a", "b", "c", "d", "e"]),
    ("e\u0301a", ["éa"]), ("a...b ...c... _d_", ["a...b", "c", "d"]),
])
def test_tokenize(rows, raw, want):
    assert toks(rows, raw) == want


def test_tokenize_without_number_marker(rows):
    assert toks(rows, "x 2024", anonymize_numbers=False) == ["x", "2024"]


def test_gates_cover_every_character():
    """A text that skips the Python function must not need it."""
    as_python = lambda p: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", p))
    nfkc, fold = as_python(fx._NEEDS_NFKC), as_python(fx._NEEDS_FOLD)
    table = str.maketrans(fx._FOLD_FROM, fx._FOLD_TO)
    for cp in range(0x110000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        assert nfkc.search(c) or unicodedata.normalize("NFKC", c) == c
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        assert fold.search(c.translate(table)) or plain == c.translate(table)


@pytest.mark.parametrize("raw,want", [("Éclair", "Eclair"), ("ﬁ e\u0301 ß ø", "fi e ß ø"), ("日本ガ", "日本カ"), (None, None)])
def test_strip_accents(rows, raw, want):
    assert rows([(raw,)], "t string").select(fx.strip_accents(F.col("t")).alias("v")).first()["v"] == want


def test_vocab_encode_decode(rows):
    df = rows([(1, ["b", "a", "b", "<NUM>", "a", "c"]), (2, []), (3, ["zz"])], "id long, tokens array<string>")
    vocab = text.build_vocab(df, max_size=1000)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3, "<NUM>": 4}
    ids = text.encode_tokens(df, vocab, "id")
    assert {r["id"]: r["ids"] for r in ids.collect()} == {1: [3, 2, 3, 4, 2, 1], 2: [1], 3: [1]}
    clipped = text.encode_tokens(df, vocab, "id", max_len=2)
    assert {r["id"]: r["ids"] for r in clipped.collect()}[1] == [3, 2]
    odd = rows([(1, [3, 2, 99, -1])], "id long, ids array<int>")
    assert text.decode_tokens(odd, vocab).first()["tokens"] == ["b", "a", "<UNK>", "<UNK>"]
    with pytest.raises(ValueError):
        text.build_vocab(df, max_size=10)


def test_vocab_cap(rows):
    df = rows([([f"t{i:05d}" for i in range(1500)] * 2,)], "tokens array<string>")
    vocab = text.build_vocab(df, max_size=1000)
    got = {r["token"]: r["id"] for r in vocab.collect()}
    assert len(got) == 1000 and got["<NUM>"] == 999 and got["t00000"] == 2 and got["t00996"] == 998 and "t00997" not in got


def chunks_of(seq, width, step):
    out = [seq[:width]]
    start = step
    while start + width - step < len(seq):
        out.append(seq[start:start + width])
        start += step
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 10, 11, 23])
def test_chunks(rows, n):
    seq = list(range(1, n + 1))
    df = rows([(1, seq)], "id long, ids array<int>")
    got = text.chunk_sequences(df, max_len=8, overlap=2, n_special=2).orderBy("chunk_no").collect()
    want = chunks_of(seq, 6, 4)
    assert [[i for i, m in zip(r["ids"], r["mask"]) if m] for r in got] == want
    assert all(len(r["ids"]) == len(r["mask"]) == 6 for r in got)
    one = text.truncate_pad(df, max_len=6).first()
    assert one["ids"] == (seq + [0] * 6)[:6] and sum(one["mask"]) == min(n, 6)


def test_chunk_overlap_is_checked(rows):
    with pytest.raises(ValueError):
        text.chunk_sequences(rows([([1],)], "ids array<int>"), max_len=4, overlap=4)


SMOKE = [(1, "Patient has chest pain"), (2, "chest pain and fever"), (3, "fever, no  pain 😀x"), (4, "")]


def python_grams(t, lo, hi):
    t = re.sub(r"\s\s+", " ", t.lower())
    return [t[i:i + n] for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]


def reference_tfidf(docs, grams, min_df):
    per = [{g: gs.count(g) for g in gs} for gs in map(grams, docs)]
    df = {}
    for d in per:
        for g in d:
            df[g] = df.get(g, 0) + 1
    vocab = {g: i for i, g in enumerate(sorted((g for g in df if df[g] >= min_df), key=lambda g: g.encode()))}
    out = []
    for d in per:
        w = {vocab[g]: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, c in d.items() if g in vocab}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.append({i: v / norm for i, v in w.items()})
    return vocab, out


@pytest.mark.parametrize("mode,grams", [
    ("char", lambda t: python_grams(t, 3, 5)),
    ("word", lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall(r"\w\w+", t.lower()))),
])
def test_tfidf_matches_definition(rows, mode, grams):
    df = rows(SMOKE, "id long, text string")
    model = features.fit_tfidf(df, features.TfidfConfig(mode=mode))
    vocab, want = reference_tfidf([t for _, t in SMOKE], grams, 2)
    assert {r["term"]: r["feature_id"] for r in model.vocab.collect()} == vocab
    got = {r["id"]: dict(zip(r["feature_ids"], r["feature_values"])) for r in model.transform(df, "id").collect()}
    for (key, _), expected in zip(SMOKE, want):
        assert got[key] == pytest.approx(expected, abs=1e-6)


def test_char_query_keeps_every_gram(spark, rows):
    """More grams of two documents than the caps of the other queries leave."""
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdefghij", k=1500)) for _ in range(4)]
    docs = [(i, "en", text) for i, text in enumerate([*texts, texts[0][::-1], texts[1], "", "zq"])]
    path = scratch_path(spark, "tables")
    rows(docs, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    vocab, want = reference_tfidf([t for *_, t in docs], lambda t: python_grams(t, 3, 5), 2)
    assert len(vocab) > 3000
    got = {(r["doc_id"], r["feature_id"]): r["value"] for r in q_tfidf_char(spark, path).collect()}
    assert got.keys() == {(key, i) for (key, *_), found in zip(docs, want) for i in found}
    assert got == pytest.approx({(key, i): v for (key, *_), found in zip(docs, want) for i, v in found.items()}, abs=6e-6)


def test_combined_blocks_and_round_trip(spark, rows):
    df = rows(SMOKE, "id long, text string")
    model, out = features.fit_transform_splits({"train": df, "val": df.limit(0)}, "id")
    assert out["val"].count() == 0
    n_words = model.vocab.filter("block = 0").count()
    row = {r["id"]: r for r in out["train"].collect()}
    for key in (1, 2, 3):
        for inside in (lambda i: i < n_words, lambda i: i >= n_words):
            norm = sum(v * v for i, v in zip(row[key]["feature_ids"], row[key]["feature_values"]) if inside(i))
            assert norm == pytest.approx(1, abs=1e-5)
    assert row[4]["feature_ids"] == []
    path = scratch_path(spark, "tfidf")
    features.save_features(model, path)
    loaded = features.load_features(spark, path)
    assert loaded.config == model.config and loaded.n_features == model.n_features
    again = {r["id"]: r["feature_values"] for r in loaded.transform(df, "id").collect()}
    assert again == {k: r["feature_values"] for k, r in row.items()}
    vector = features.to_vectors(out["train"], model.n_features).filter("id = 2").first()["features"]
    assert isinstance(vector, SparseVector) and vector.size == model.n_features and list(vector.indices) == row[2]["feature_ids"]


def test_tfidf_edges(rows):
    df = rows(SMOKE, "id long, text string")
    with pytest.raises(ValueError):
        features.fit_tfidf(df.limit(0))
    with pytest.raises(ValueError):
        features.TfidfConfig(mode="nope")
    none = features.fit_tfidf(df, features.TfidfConfig(mode="none"))
    assert none.n_features == 0 and none.transform(df, "id").filter("size(feature_ids) > 0").count() == 0
    share = features.fit_tfidf(df, features.TfidfConfig(mode="word", min_df=0.75))
    assert [r["term"] for r in share.vocab.collect()] == ["pain"]


def test_encoding_keeps_rows_with_repeated_and_null_keys(rows):
    from tagloom.operators import labels

    mapping = rows([("A", 0), ("B", 1)], "code string, idx int")
    df = rows([(1, ["A"]), (1, ["B", "B"]), (None, ["B"]), (2, None), (3, ["Z"])], "hadm_id long, labels array<string>")
    got = labels.encode_labels(df, mapping)
    assert sorted(map(repr, ((r[0], r[1]) for r in got.collect()))) == sorted(map(repr, [(1, [0]), (1, [1]), (None, [1]), (2, []), (3, [])]))
    vocab = rows([("<PAD>", 0), ("<UNK>", 1), ("a", 2), ("b", 3)], "token string, id int")
    ids = text.encode_tokens(rows([(1, ["a", "b"]), (1, ["z"]), (None, [])], "id long, tokens array<string>"), vocab, "id")
    assert sorted(map(repr, ((r[0], r[1]) for r in ids.collect()))) == sorted(map(repr, [(1, [2, 3]), (1, [1]), (None, [1])]))
    assert "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [62, 9])
def test_gram_counts_by_brute_force(monkeypatch, bits):
    """With narrow numbers every size is ranked before the next item is added."""
    monkeypatch.setattr(grams, "NUMBER_BITS", bits)
    texts = ["abab\0\0", "", "😀é😀é😀", "a", "ba ab\0"]
    got = {}
    for counts in grams.counted(grams.Items.characters(texts), 1, 5, ""):
        for g, term in enumerate(counts.terms):
            for i in range(counts.firsts[g], counts.firsts[g + 1]):
                got[term, int(counts.rows[i])] = int(counts.times[i])
    want = Counter((t[i : i + n], r) for r, t in enumerate(texts) for n in range(1, 6) for i in range(len(t) - n + 1))
    assert got == dict(want)


def test_characters_are_folded_as_in_columns(rows):
    """Every code point that is no surrogate, between letters and beside blanks; marks, ligatures, runs at the ends."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}" for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    texts += ["", " ", "  ", "\n\t", "a  b", " \u0301 ", "\u0301", "e\u0301\u0323ﬃ½  \u2003x ", "\x1c\x1d", "ﷺ", "가각"]
    df = rows(list(enumerate(texts)), "id int, t string").select("id", fx.collapse_blanks(fx.strip_accents(F.col("t"))).alias("t"))
    want = [r["t"] for r in df.orderBy("id").collect()]
    for some in (slice(None), slice(-11, None), slice(-11, -10), slice(-7, -6)):
        items = grams.Items.characters(texts[some]).without_marks().with_single_blanks()
        got = ["".join(items.names[i] for i in items.ids[low:high]) for low, high in zip(items.starts, items.starts[1:])]
        assert got == want[some]


def test_grams_are_found_among_known_ones():
    known = ["abc", "ab", "é😀", "abcde", "zzz", "c"]
    lookup = grams.Lookup.of(grams.Items.characters(known), np.arange(10, 16))
    for texts in (["abcde", "", "é😀abx", "zz"], ["qq"]):
        for counts in grams.counted(grams.Items.characters(texts), 1, 6, ""):
            assert lookup.find(counts).tolist() == [known.index(t) + 10 if t in known else -1 for t in counts.terms]
            assert counts.strings().to_pylist() == counts.terms
    none = grams.Lookup.of(grams.Items.characters([]), np.arange(0))
    assert [none.find(c).tolist() for c in grams.counted(grams.Items.characters(["ab"]), 1, 2, "")] == [[-1, -1], [-1]]
    words = grams.Lookup.of(grams.Items.words(["no pain", "pain", "a b c"]), np.arange(3))
    found = {t: i for c in grams.counted(grams.Items.words(["pain no pain"]), 1, 2, " ") for t, i in zip(c.terms, words.find(c).tolist())}
    assert found == {"pain": 1, "no": -1, "pain no": -1, "no pain": 0}


@pytest.mark.parametrize("bits", [62, 8])
def test_pairs_are_added_up(monkeypatch, bits):
    monkeypatch.setattr(grams, "NUMBER_BITS", bits)
    lists = [np.array(x) for x in ([1, 0, 1], [0, 0])], [np.array(x) for x in ([4, 2, 4], [2, 9])], [np.array(x) for x in ([1, 5, 2], [7, 1])]
    assert [x.tolist() for x in grams.added(*lists, 10)] == [[0, 0, 1], [2, 9, 4], [12, 1, 3]]


def test_digits_are_rounded_as_by_round(rows):
    """Halves of the last digit that a float holds exactly go up; lists without values give no rows."""
    values = [float(np.float32(v)) for v in (1 / 64, 3 / 64, 0.5, 1.0, 1e-9, 0.000005, 0.123455, 0.99999, 0.9999999, *np.random.default_rng(3).random(3000))]
    df = rows([(1, list(range(len(values))), values), (2, [], []), (3, None, None), (4, [1], None)], "doc_id long, feature_ids array<int>, feature_values array<float>")
    pairs = df.select("doc_id", F.explode(F.arrays_zip("feature_ids", "feature_values")).alias("e"))
    want = pairs.select("doc_id", "e.feature_ids", F.round(F.col("e.feature_values").cast("double"), 5)).filter("feature_ids IS NOT NULL")
    assert sorted(map(tuple, _rows(df).collect())) == sorted(map(tuple, want.filter("doc_id = 1").collect()))


@pytest.mark.parametrize("items", [5, 1_000_000])
def test_tfidf_counts_texts_of_a_key_together(rows, monkeypatch, items):
    """In one plan without a row per gram: texts of a key, null too, make one document however batches are cut."""
    monkeypatch.setattr(grams, "BATCH_ITEMS", items)
    texts = [(1, "chest pain"), (None, "pain"), (1, "pain and fever"), (2, None), (None, "fever chest"), (3, "zz")]
    fitted = features.fit_tfidf(rows(SMOKE, "id long, text string"), features.TfidfConfig())
    df = rows(texts, "id long, text string").coalesce(1)
    quick, joined = fitted.transform(df, "id"), features._transform_joined(fitted, df, "id", "text")
    pick = lambda out: {r["id"]: dict(zip(r["feature_ids"], r["feature_values"], strict=True)) for r in out.collect()}
    got, want = pick(quick), pick(joined)
    assert quick.count() == 4 and got.keys() == want.keys() == {1, 2, 3, None} and got[2] == {} and got[1]
    for k, values in want.items():
        assert got[k] == pytest.approx(values, abs=1e-6)
    plan = quick._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan


def test_tokens_are_replaced_in_arrow_columns(rows):
    """Sliced lists, null lists and null items; a million repeated tokens take no Python objects."""
    lists = pa.array([["x"], ["a", "b", None], None, [], ["zz", "a"]]).slice(1)
    got = text._replaced(lists, pa.array(["a", "b"]), pa.array([7, 8], pa.int32()), 1)
    assert got.to_pylist() == [[7, 8, 1], None, [], [1, 7]] and got.type.value_type == pa.int32()
    back = text._replaced(got, pa.array([7, 8], pa.int64()), pa.array(["a", "b"]), "<UNK>")
    assert back.to_pylist() == [["a", "b", "<UNK>"], None, [], ["<UNK>", "a"]]
    tokens = pa.array(["a", "b", "c", "some-longer-token"] * 250_000)
    many = pa.ListArray.from_arrays(pa.array([0, 600_000, 1_000_000], pa.int32()), tokens)
    tracemalloc.start()
    ids = text._replaced(many, pa.array(["a", "b", "some-longer-token"]), pa.array([2, 3, 4], pa.int32()), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pc.sum(ids.flatten()).as_py() == 250_000 * 10 and peak < 1_000_000
    vocab = rows([("<PAD>", 0), ("<UNK>", 1), ("a", 2)], "token string, id int")
    df = rows([(1, [2, 5, 0]), (2, None), (3, [])], "id long, ids array<int>")
    assert {r["id"]: r["tokens"] for r in text.decode_tokens(df, vocab).collect()} == {1: ["a", "<UNK>", "<PAD>"], 2: None, 3: []}
