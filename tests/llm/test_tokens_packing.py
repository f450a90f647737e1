"""Exact ids, histograms and packing against brute force."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import packing, pieces, queries, tokens
from tagloom.llm.common import table

SF = "/root/testdata/sf0.001"
PARTS = ["a", "the", "ing", " ", "  ", "é", "你好", "\n", "▁", "\t", "'s", "<|endoftext|>", "<s>", "😀", "12", ".", " \n", "ﬁ", "\x1c", "\x00"]


@pytest.fixture(scope="module")
def reference():
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: bpe.encode(text, add_special_tokens=False).ids


BPE = tokens.ByteBpe(queries.BPE_RANKS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_bpe_ids_are_exact(reference, text):
    assert np.frombuffer(BPE.encode(text), dtype="<u4").tolist() == reference(text)


@pytest.mark.parametrize("path", [queries.PIECES])
def test_piece_ids_are_the_librarys(path):
    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    encoder, pick = pieces.Encoder(vocabulary, cache_words=500), random.Random(7)
    texts = ["".join(pick.choices(PARTS, k=pick.randint(0, 40))) for _ in range(2000)] + ["the ing" * 3000]
    texts = [t.replace("\x00", "") for t in texts]
    for start in range(0, len(texts), 300):
        part = texts[start : start + 300]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert ids.tolist() == model.encode(text)
            assert pieces._plain(vocabulary.surface, ids) == text.replace("▁", " ")


def test_memory_is_linear_in_a_words_length():
    """The memory of a text without spaces is checked at 20,000 characters, then 200,000 are encoded."""
    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES), pieces.Vocabulary(queries.PIECES)
    encoder, pick = pieces.Encoder(vocabulary), random.Random(3)
    texts = ["".join(pick.choices(["你好", "é", "the", "ing", "😀", "Qz9", "/"], k=n)) for n in (10_000, 100_000)]
    for text, least in zip(texts, (20_000, 200_000), strict=True):
        text = text.ljust(least, "x")[:least]
        tracemalloc.start()
        ids = encoder.encode([text])[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2000 * len(text)
        assert ids.tolist() == model.encode(text)


def test_usual_words_take_no_step_a_character(monkeypatch):
    """Trie nodes of usual words get their states in arrays; only longer words are walked one character at a time."""
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES), pieces.Encoder(pieces.Vocabulary(queries.PIECES))
    pick = random.Random(11)
    kept = [p for p in PARTS if p not in ("\x00", "▁")]
    texts = [" ".join("".join(pick.choices(kept, k=pick.randint(1, 4))) for _ in range(40)) for _ in range(200)]
    walked, step = [], pieces.Viterbi._by_merges
    monkeypatch.setattr(pieces.Viterbi, "_by_merges", lambda self, word, *rest: walked.append(word) or step(self, word, *rest))
    assert [ids.tolist() for ids in encoder.encode(texts)] == [model.encode(t) for t in texts]
    assert not walked
    edges = [c * (pieces.LONG + n) for c in ("a", "é", "你", "😀") for n in (-3, -2, -1, 0, 1)] + texts[:5]
    assert [ids.tolist() for ids in encoder.encode(edges)] == [model.encode(t) for t in edges]
    assert walked and all(len(word) > pieces.LONG for word in walked)


def brute_merges(text, scores):
    parts = list(text)
    while True:
        best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores), default=None)
        if best is None:
            return parts
        parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]


@pytest.mark.parametrize("seed", range(8))
def test_levels_are_the_walk_and_the_merges(seed, monkeypatch):
    """Small vocabularies with equal scores, pieces that never form and characters that are no piece."""
    pick = random.Random(seed)
    vocabulary = pieces.Vocabulary(queries.PIECES)
    made = {"".join(pick.choices("abcd", k=pick.randint(2, 5))) for _ in range(40)}
    vocabulary.ids = {p: i for i, p in enumerate(["a", "b", "c", *sorted(made)])}
    vocabulary.scores = {p: -float(pick.randint(0, 6)) for p in vocabulary.ids}
    vocabulary.endings = {}
    for p in sorted(made, key=len, reverse=True):
        vocabulary.endings[p[-2:]] = tuple(dict.fromkeys((*vocabulary.endings.get(p[-2:], ()), len(p))))
    viterbi = pieces.Viterbi(vocabulary, most_pairs=50)
    for before in ["", "z", *vocabulary.ids]:
        for piece in vocabulary.ids:
            assert viterbi._agree(before, piece) == (brute_merges(before + piece, vocabulary.scores) == [p for p in (before, piece) if p])
    words = sorted({"".join(pick.choices("abcdez", k=pick.randint(1, 14))) for _ in range(400)})
    monkeypatch.setattr(pieces, "LEVEL_WORDS", 60)
    monkeypatch.setattr(pieces, "LONG", 10)
    assert list(viterbi.encode(words)) == list(viterbi._walk(words))


def test_unigram_viterbi_is_the_best_sum():
    vocabulary = pieces.Vocabulary(queries.PIECES, bpe=False)
    vocabulary.ids = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "aba"])}
    vocabulary.scores = {"▁": -2.0, "a": -1.5, "b": -1.5, "ab": -2.2, "▁a": -2.1, "ba": -2.6, "aba": -4.0}
    vocabulary.longest = 3

    def best(word):
        if not word:
            return 0.0
        return max(vocabulary.scores[word[:n]] + best(word[n:]) for n in (1, 2, 3) if word[:n] in vocabulary.scores)

    words = sorted({"▁" + "".join(random.Random(i).choices("ab", k=i % 9)) for i in range(60)})
    names = {i: p for p, i in vocabulary.ids.items()}
    for word, coded in zip(words, pieces.Viterbi(vocabulary).encode(words), strict=True):
        ids = np.frombuffer(coded, dtype="<i4")
        assert "".join(names[i] for i in ids) == word
        assert abs(sum(vocabulary.scores[names[i]] for i in ids) - best(word)) < 1e-9


ODD = [(1, "one two", 9), (2, None, 9), (3, "", 9), (4, "word " * 9000, None), (5, "one two", 9), (5, "one two", 9), (None, "x", 9)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_tokens int")


def test_pieces_frame_edges(spark, odd):
    got = pieces.encode(odd, queries.PIECES, ["doc_id", "text"]).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    assert len(got) == 7 and all(r["ids"] == (model.encode(r["text"]) if r["text"] else []) for r in got)
    assert pieces.encode(odd.limit(0), queries.PIECES, ["doc_id"]).count() == 0
    assert all(r["restored"] for r in queries.op4_sentencepiece(spark, SF).collect())


def test_counts_and_histogram(spark, odd, reference):
    counted = tokens.token_counts(odd, queries.BPE_RANKS, ["doc_id", "text"])
    lengths = [r["n_tokens"] for r in counted.collect()]
    assert sorted(lengths) == sorted(len(reference(t or "")) for _, t, _ in ODD)
    histogram = tokens.length_histogram(counted)
    rows = {r["context_limit"]: r for r in histogram.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r["docs"] == Counter(lengths)[limit] and r["docs_longer"] == sum(x > limit for x in lengths)
        assert r["truncated_total"] == sum(min(x, limit) for x in lengths) and r["total_tokens"] == sum(lengths)
        assert r["tokens_within"] == sum(x for x in lengths if x <= limit) and r["tokens_longer"] == sum(x for x in lengths if x > limit)
    for limit in (0, 1, 2, 500, 10**6):
        at = tokens.at_limit(histogram, limit).first()
        assert at["truncated_total"] == sum(min(x, limit) for x in lengths) and at["docs_cut"] == sum(x > limit for x in lengths)
    share = {r["share"]: r["length"] for r in tokens.length_quantiles(histogram, [0.5, 1.0]).collect()}
    assert share == {0.5: sorted(lengths)[3], 1.0: max(lengths)}
    assert tokens.length_histogram(counted.limit(0)).count() == 0


def test_histogram_groups_and_blocks(spark):
    rows = [("a" if i % 3 else None, (i * 37) % 900) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, n_tokens long")
    for r in tokens.length_histogram(frame, by=("g",)).collect():
        own = [n for g, n in rows if g == r["g"]]
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in own) and r["docs_longer"] == sum(x > r["context_limit"] for x in own)


def test_token_pieces(odd, reference):
    got = packing.token_pieces(odd, queries.BPE_RANKS, most=64).toPandas()
    assert sorted(got["length"].groupby(got["doc_id"].astype(float), dropna=False).sum()) == sorted(
        [len(reference("one two")) + 1, 1, 1, len(reference("word " * 9000)) + 1, 2 * len(reference("one two")) + 2, 2])
    long = got[got["doc_id"] == 4].sort_values("piece")
    ids = np.array([*reference("word " * 9000), 0], dtype="<u4")
    assert (long["length"].iloc[1:] == 64).all() and long["start"].tolist() == (long["length"].cumsum() - long["length"]).tolist()
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(long["start"], long["length"], strict=True)] == long["ids_crc32"].tolist()


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 1000, 1e9), (100, 4, 1e9), (100, 1000, 3000.0)])
def test_best_fit_keeps_every_capacity(rule, limits):
    pick = random.Random(3)
    lengths = np.array([pick.randint(0, 50) for _ in range(500)])
    capacity = packing.Capacity(*limits, weights=(1.0, 1.0, 1.0), rule=rule)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        own = own[np.lexsort((own, lengths[own] * 0 + offsets[own]))]
        assert lengths[own].sum() <= limits[0] and len(own) <= limits[1] and (lengths[own] ** 2).sum() <= limits[2] + 1e-6
    least = max(lengths.sum() / limits[0], len(lengths) / limits[1], (lengths**2).sum() / limits[2])
    assert len(np.unique(bins)) <= 1.25 * least + 2
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), capacity)


def test_pack_is_gapless_and_tight(spark):
    got = queries.op10_best_fit_packing(spark, SF).toPandas()
    assert got["doc_id"].nunique() == table(spark, SF, "documents").count()
    ordered = got.sort_values(["sequence_id", "offset", "length"])
    groups = ordered.groupby("sequence_id")["length"]
    assert (ordered["offset"] == groups.cumsum() - ordered["length"]).all() and groups.sum().max() <= 2048
    assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 2048) * 1.02 + 1


def test_pack_edges(spark):
    items = spark.createDataFrame([(1, 5), (1, 5), (2, None), (3, 10)], "id long, length long")
    got = packing.pack(items, capacity=packing.Capacity(tokens=10, documents=10, attention=100.0), group_items=2).collect()
    assert len(got) == 4
    assert packing.pack(items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items.withColumnRenamed("id", "offset"))
