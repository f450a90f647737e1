"""Removal of repeated passages against a plain search of every string."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import suffixes


def brute(rows, length):
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        if key is not None:
            for p in range(len(data) - length + 1):
                s = data[p : p + length]
                least[s] = min(least.get(s, key), key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if key is not None and least[data[p : p + length]] < key:
                gone[p : p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(data):
            if gone[p]:
                start = p
                while p < len(data) and gone[p]:
                    p += 1
                spans.append((start, p))
            else:
                p += 1
        out.append((key, len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in frame.collect()), key=str)


def texts(rng, n, letters="abcdeé ", copies=True):
    rows, whole = [], []
    for i in range(n):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 160)))
        if copies and whole and rng.random() < 0.6:
            old = rng.choice(whole)
            s = rng.randrange(len(old) + 1)
            text = text[: rng.randrange(len(text) + 1)] + old[s : s + rng.randint(1, 140)] + text[-rng.randint(1, 30):]
        whole.append(text)
        rows.append((rng.choice([i, 1000 - i]), text))
    return rows


@pytest.mark.parametrize("length", [2, 9, 16, 17, 50])
def test_against_brute_force(spark, length):
    rng = random.Random(length)
    rows = texts(rng, 120, "ab" if length == 9 else "abcdefghijklmnoé ")
    rows += [(None, rows[3][1]), (5, None), (6, ""), (7, rows[9][1]), (7, rows[8][1]), (7, rows[8][1]),
             (-4, "x" * 400), (2000, "y" + "x" * 300 + "z"), (2001, "xy" * 200), (2002, "xy" * 90)]
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, tag int").repartition(5)
    assert got(suffixes.remove_repeats(frame, length)) == brute(rows, length)


def test_groups_over_many_ranges(spark, monkeypatch):
    # One passage in most rows, and ranges so small that its groups span several.
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 300)
    rng = random.Random(1)
    passage = "the very same passage, long enough to be found everywhere it is"
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) + passage + str(i % 7)) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.remove_repeats(frame, 50)) == brute(rows, 50)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 64)
    rows = texts(random.Random(4), 60)
    found = list(suffixes.blocks([t.encode() for _, t in rows], 20))
    windows = sum(int(c.sum()) for *_, c in found)
    assert windows == sum(max(len(t.encode()) - 19, 0) for _, t in rows)


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_line_in_many_contexts(spark, monkeypatch):
    # Blocks at the line's ends share a smallest rank and differ: they are spread by their content.
    spread = [(1 << 19, 16), (64, 2)]
    rng = random.Random(7)
    line = "a line that stands in every one of the documents, again and again."
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(40)) + line + "".join(rng.choice("abcdef") for _ in range(40))) for i in range(200)]
    rows += [(500 + i, rows[i][1][rng.randint(0, 30) : -rng.randint(1, 30)]) for i in range(40)] + [(9, None), (None, rows[4][1])]
    expected = brute(rows, 50)
    for gather, many in spread:
        monkeypatch.setattr(suffixes, "GATHER_ROWS", gather)
        monkeypatch.setattr(suffixes, "MANY", many)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert got(suffixes.remove_repeats(frame, 50)) == expected


def test_equal_blocks_of_a_task_are_sent_once():
    # 1000 documents hold the same block, and 1000 another content with the same smallest rank each.
    n = 1000
    rows = (np.full(2 * n, 7, dtype=np.uint64), np.append(np.zeros(n), np.arange(1, n + 1)).astype(np.uint64),
            np.arange(2 * n), np.zeros(2 * n, dtype=np.int64), np.arange(2 * n) << 16 | 1)
    sent, kind, route = suffixes._spread(*rows)
    assert np.count_nonzero(kind == suffixes.SETTLED) == n - 1
    assert np.count_nonzero(kind == suffixes.SPREAD) == n + 1
    assert np.count_nonzero(kind == suffixes.MARK) == 1
    assert len(set(route[kind == suffixes.SPREAD].tolist())) == n + 1


def test_periodic_texts(spark):
    rows = [(1, "x" * 3000 + "end"), (2, "begin" + "x" * 200_000 + "end"), (3, "xyz" * 900), (4, "zxyz" + "xyz" * 20_000 + "x")]
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert spans == {1: [], 2: [(5, 200_008)], 3: [], 4: [(0, 60_005)]}


def test_shuffle_files_are_dropped(spark):
    # What the comparisons shuffle is gone when the places are stored.
    rng = random.Random(3)
    rows = [(i, 0, text) for i, (_, text) in enumerate(texts(rng, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, tag long, text string")
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {str(f) for folder in folders for f in Path(folder).rglob("shuffle_*.data")}

    before = files()
    found = suffixes.repeated_windows(docs, sum(len(t) for *_, t in rows), 50)
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert found.where(F.col("place") >= 0).count() > 0
