"""Cross-tokenizer alignment against the two libraries and a search of all overlaps."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tagloom.llm import alignment, queries
from tagloom.session import store_table

PARTS = ["a", "the", "ing", " ", "  ", " the", " of", "é", "你好", "\n", "▁", "\t", "'s", "<|endoftext|>", "<s>", "<0x41>", "😀", "12", ".", " \n", "ﬁ", "\x1c", "\x00"]


def unbyte():
    """Byte of each character of the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in zip(plain + [256 + i for i in range(len(others))], plain + others, strict=True)}


def brute(texts):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    table, rows, count = unbyte(), [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        spell_a = [bytes(table[c] for c in a_model.id_to_token(i)) for i in a]
        spell_b = []
        for i in b:
            piece = b_model.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece)
            spell_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            rows.append(None)
            continue

        def spans(spelled):
            at, out = 0, []
            for s in spelled:
                out.append((at, at + len(s)))
                at += len(s)
            return out

        sa, sb = spans(spell_a), spans(spell_b)
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for high in shared:
            groups.append(",".join(str(i) for i, (s, e) in zip(a, sa, strict=True) if low <= s and e <= high) + "|"
                          + ",".join(str(i) for i, (s, e) in zip(b, sb, strict=True) if low <= s and e <= high))
            low = high
        links = [(x, y) for x, (s, e) in zip(a, sa, strict=True) for y, (t, f) in zip(b, sb, strict=True) if s < f and t < e]
        count.update(set(links))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], r[2], len(r[3]), sum(count[p] == best[p[0]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


def frame(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choices(PARTS, k=pick.randint(0, 25))) for _ in range(400)]
    texts += [t.replace("▁", "").replace("\x00", "") for t in texts] + [None, "", " ", "  ", "   a", "x" * 3000, "two  spaces here", "the of"] * 2
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").limit(40).collect()]
    rows = [(i if i % 9 else None, t, "z") for i, t in enumerate(texts)]
    return texts, spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, doc_id long, text string, ids string").repartition(4)


def test_against_brute_force_both_ways(spark):
    texts, docs = frame(spark)
    aligned = store_table(alignment.align(docs, queries.BPE_RANKS, queries.PIECES, ["n", "doc_id"]), "aligned")
    counts = store_table(alignment.pair_counts(aligned), "counts")
    want = brute(texts)
    for most in (alignment.LOOKUP_PAIRS, 3):
        found = sorted(alignment.with_counts(aligned, counts, most).collect(), key=lambda r: r.n)
        assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found] == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    aligned = store_table(alignment.align(docs, queries.BPE_RANKS, queries.PIECES, ["doc_id"]), "aligned")
    assert alignment.with_counts(aligned, store_table(alignment.pair_counts(aligned), "counts")).count() == 0


def test_no_python_call_for_new_words():
    """1500 words that were never met before cost no Python call each."""
    aligner = alignment.Aligner(queries.BPE_RANKS, queries.PIECES)
    pick = random.Random(3)
    new = [" ".join("".join(pick.choices("abcdefghij", k=9)) for _ in range(300)) for _ in range(5)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        aligner.align(new)
    finally:
        sys.setprofile(None)
    assert calls < 500


def test_parts_hold_every_text_once():
    texts = [None, "", "x" * (2 * alignment.PART_CHARS), "y", *["z" * 1000] * 3000, None]
    cut = list(alignment.parts(texts))
    assert [t for part in cut for t in part] == texts and all(cut) and list(alignment.parts([])) == []
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= alignment.PART_CHARS for part in cut)
    assert max(map(len, cut)) <= alignment.BATCH_ROWS


def test_parts_do_not_change_results(spark, monkeypatch):
    """Texts next to each other are aligned alone, whatever part they meet in."""
    texts = frame(spark)[0]
    aligner = alignment.Aligner(queries.BPE_RANKS, queries.PIECES)

    def rows(found):
        *counts, digests, pairs, times, starts = found
        return [(*(int(c[i]) for c in counts), digests[i], pairs[s:e].tolist(), times[s:e].tolist()) for i, (s, e) in enumerate(zip(starts, starts[1:], strict=False))]

    alone = [row for t in texts for row in rows(aligner.align([t]))]
    monkeypatch.setattr(alignment, "PART_CHARS", 500)
    assert rows(aligner.align(texts)) == alone
    assert [row for part in alignment.parts(texts) for row in rows(aligner.align(part))] == alone


def test_large_ids_beside_null(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**53 + 1, "c d"), (2**62 + 3, None)], "doc_id long, text string").coalesce(1)
    aligned = alignment.align(docs, queries.BPE_RANKS, queries.PIECES, ["doc_id"])
    assert {r.doc_id for r in aligned.collect()} == {None, 2**53 + 1, 2**62 + 3}
