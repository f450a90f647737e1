"""Quality rules, fingerprints, near duplicates, quotations and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import dartminhash, fingerprints, neardup, quality, queries, quotes
from tagloom.llm.common import table
from tagloom.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, key string, weight string, __text string"
ODD = [
    (1, "a b c a b c a b c a"), (2, None), (3, ""), (4, "x\ny\nx\n\n \ny\r\nx"), (5, "& # % < a|b"), (6, "w " * 30_000),
    (7, "same text here now ok yes"), (7, "same text here now ok yes"), (8, "Same  text here now ok yes"), (9, "é ü 你 好\x0b!"), (None, "same text here now ok yes"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", "w", "t") for r in ODD], DOCS)


def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd):
    for frame in (odd, table(spark, SF, "documents")):
        texts = collections.Counter((r["doc_id"], *base_counts(r["text"])) for r in frame.select("doc_id", "text").collect())
        got = collections.Counter((r["doc_id"], *(r[c] for c in quality.BASE)) for r in quality.statistics(frame, ["doc_id"]).collect())
        assert got == texts


def test_quality_learns_an_ordered_list(spark):
    pick = random.Random(5)
    rows = []
    for i in range(3000):
        n, symbols, dup = pick.randint(60, 400), pick.choice([0, 0, 0, 40]), pick.choice([0, 0, 9])
        rows.append((i, n, n * 5, symbols, dup, 0, int(not (symbols or dup == 9 and n < 200))))
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality int")
    rules = quality.learn(frame)
    assert 2 <= len(rules) <= 6
    got = quality.decide(frame, rules).join(frame.select("doc_id", "quality"), "doc_id").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.98
    assert quality.learn(frame.where("quality = 1")) == [] and quality.learn(frame.limit(0)) == []
    assert quality.decide(frame.limit(0), rules).count() == 0


def test_quality_query(spark):
    got = queries.op6_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
    assert (got["base_failed"] == failed).all() and not got[got["base_failed"]]["kept"].any()
    plan = quality.judge(table(spark, SF, "documents"), [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_fingerprints(spark):
    docs = table(spark, SF, "documents")
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op8_document_fingerprints(spark, SF).collect()}
    errors = []
    for at, (i, text) in enumerate(texts):
        following = texts[(at + 1) % len(texts)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        for value, other in ((got[i]["near_edited"], edited), (got[i]["near_next"], following)):
            a, b = shingles(text), shingles(other)
            errors.append(value - len(a & b) / len(a | b))
    assert np.abs(errors).mean() < 0.04 and abs(np.mean(errors)) < 0.01


def test_fingerprint_edges(spark, odd):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["sketch"] == by_id[3]["sketch"] == [] and by_id[2]["n_chars"] == 0 and by_id[3]["near_edited"] == 1.0
    assert by_id[7]["sketch"] == by_id[8]["sketch"] and by_id[None]["near_next"] is None
    assert fingerprints.edited_fingerprints(odd.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(odd.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_sketches_merge_and_estimate(spark):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    frame = spark.createDataFrame([("g", text[:9000]), ("g", text[8000:]), ("e", None), (None, "a b")], "g string, t string")
    parts = frame.select("g", fingerprints.sketch(F.col("t")).alias("s"))
    merged = {r["g"]: r["s"] for r in fingerprints.merge_groups(parts, ["g"], "s").collect()}
    by_hand = sorted({h for r in parts.where("g = 'g'").collect() for h in r["s"]})[: fingerprints.K]
    assert merged["g"] == by_hand and merged["e"] == [] and len(merged[None]) == 1
    s = fingerprints.sketch(F.lit(text))
    whole = spark.range(1).select(fingerprints.distinct_shingles(s).alias("n"), fingerprints.containment(s, s).alias("c")).first()
    assert abs(whole["n"] / 700 - 1) < 0.3 and whole["c"] > 0.99


def test_darts_estimate_weighted_jaccard():
    pick = np.random.default_rng(1)
    darts = dartminhash.Darts(bands=100, rows=20)
    for weights in (pick.integers(1, 6, 300).astype(float), pick.random(300) * 3):
        names = np.sort(pick.integers(0, 2**63, 300).astype(np.uint64))
        other = np.where(pick.random(300) < 0.7, weights, weights * 0.4)
        a, b = (names, weights), (names[20:], other[20:])
        union = np.concatenate([np.maximum(weights[20:], other[20:]), weights[:20]]).sum()
        want = np.minimum(weights[20:], other[20:]).sum() / union
        one, two = darts.signatures([a, b])
        assert abs((one == two).mean() - want) < 0.04
        assert abs(dartminhash.weighted_jaccard(a, b) - want) < 1e-9
    assert (darts.signatures([a])[0] == one).all()  # alone or with others alike


def test_components_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, j) for j in range(1001, 1400)]
    rows = chain + star + [(5, 5), (7, 6), (6, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[j] == 1000 for j in range(1000, 1400))
    assert got[6] == got[7] == 6 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(texts, threshold=0.8):
    counts = {}
    for i, text in texts:
        words = (text or "").lower().split()
        if words:
            counts[i] = collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(counts)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            both = sum((counts[i] & counts[j]).values())
            if both and both >= threshold * (sum(counts[i].values()) + sum(counts[j].values()) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


@pytest.mark.parametrize("few", [2, 48])
def test_near_duplicates_planted(spark, few):
    """Copies, near copies in a chain, and many texts with one shared passage; few members outside force splitting."""
    pick = random.Random(11)
    word = lambda: f"w{pick.randint(0, 5000)}"
    texts, passage = [], [word() for _ in range(120)]
    for group in range(6):
        body = [word() for _ in range(200)]
        for copy in range(12):
            for _ in range(copy % 4):
                body = body.copy()
                body[pick.randrange(200)] = word()
            texts.append((group * 100 + copy, " ".join(body)))
    texts += [(1000 + i, " ".join(passage + [word() for _ in range(60)])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs, few=few).collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize(("hot", "block"), [(64, 2048), (3, 8)])
def test_near_duplicates_of_one_large_bucket(spark, monkeypatch, hot, block):
    """One band only, so that pairs within large buckets of texts over a template have no second band."""
    monkeypatch.setattr(neardup, "_HOT", hot)
    monkeypatch.setattr(neardup, "_BLOCK", block)
    pick, darts = random.Random(13), dartminhash.Darts(bands=1, rows=1)
    word = lambda: f"w{pick.randint(0, 5000)}"
    template, texts = [word() for _ in range(120)], []
    for i in range(80):
        body = template + [word() for _ in range(pick.randint(20, 60))]
        near = body.copy()
        near[pick.randrange(len(near))] = word()
        texts += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(near + [word()] * pick.randint(0, 3)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs, darts=darts, few=2).collect()}
    bands = {r["key"]: r["bands"][0] for r in neardup.signatures(docs, darts).collect()}
    assert max(collections.Counter(bands.values()).values()) > 20
    sets = {i: dartminhash.Shingler(5).weighted(neardup.words_of(t)) for i, t in texts}
    alike = [(i, j) for i in sets for j in sets if i < j and bands[i] == bands[j] and dartminhash.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    assert len(alike) > 20 and all(got[i] == got[j] for i, j in alike)
    brute = brute_classes(texts)
    assert all(brute[i] == brute[c] for i, c in got.items())


def test_near_duplicate_edges(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    # Rows without an id are documents too, each text with a key of its own.
    nameless = [r["class_id"] for r in got if r["doc_id"] is None]
    assert len(nameless) == odd.where("doc_id IS NULL").count() and all(c is not None for c in nameless)
    got = [r for r in got if r["doc_id"] is not None]
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (7, 7), (8, 7), (9, 9)]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_of_the_table(spark):
    docs = table(spark, SF, "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_minhash_near_dedup(spark, SF).collect()}
    assert got == brute_classes(texts)


MAILS = [
    (1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "> Hello  there\n> How are YOU?\n\nFine."),
    (1, 2, "a", ">> Hello there\n>> How are you?\n> Fine.\nGood.\n"), (1, 3, "c", "> Hello there\n> How are you?\nMe too."),
    (1, 4, "c", "> never said\nWhat?"), (2, 0, "a", "Fine."), (2, 1, "b", "> Fine.\n> Fine.\nx"), (2, 1, "b", "> Fine.\nx"),
    (None, 0, "a", "Hi"), (None, 1, None, "> Hi\r\nHo"), (3, None, "a", "> Hi\nlost"), (4, 0, "a", None), (4, 1, "a", ""), (4, 2, "a", ">>>"),
    (5, 0, "a", "z " * 50_000), (5, 1, "b", "> " + "z " * 50_000 + "\nseen"),
]


def test_quotes(spark):
    frame = spark.createDataFrame([(*m, "x", 1) for m in MAILS], "conv_id long, turn long, role string, text string, level string, position int")
    got = collections.defaultdict(list)
    for r in quotes.conversations(frame).collect():
        got[r["conv_id"], r["turn"]].append((r["parent_turn"], r["root_turn"], r["depth"], r["quotes"], r["linked"], r["text"]))
    assert sum(map(len, got.values())) == len(MAILS)
    assert got[1, 1] == [(0, 0, 1, 1, 1, "Fine.")] and got[1, 2] == [(1, 0, 2, 2, 2, "Good.")]
    assert got[1, 3] == [(0, 0, 1, 1, 1, "Me too.")] and got[1, 4] == [(None, 4, 0, 1, 0, "What?")]
    assert [x[0] for x in got[2, 1]] == [0, 0] and got[None, 1] == [(0, 0, 1, 1, 1, "Ho")]
    assert got[3, None] == [(None, None, 0, 0, 0, "lost")]
    assert got[4, 0] == [(None, 0, 0, 0, 0, None)] and got[4, 1][0][5] == got[4, 2][0][5] == ""
    assert got[5, 1][0][0] == 0 and got[5, 1][0][5] == "seen"
    assert quotes.conversations(frame.limit(0)).count() == 0


def test_quotes_of_parts_and_nearest_source(spark):
    """A quoted paragraph or line finds its message; of several senders the nearest earlier one is the source."""
    rows = [
        (1, 0, "First paragraph here.\n\nSecond paragraph here.\nIt has two lines."), (1, 1, "> Second paragraph here.\n> It has two lines.\nYes."),
        (1, 2, "ok"), (1, 3, "> It has two lines.\nThat line."), (1, 4, "ok"), (1, 5, "> ok\nFine then."),
        (1, 6, "> nobody said this\n>\n> First paragraph here.\nMixed."), (1, 7, "> First paragraph here.\n> but changed\nA line of it."),
        (2, 0, "yes no\nwell"), (2, 1, "> well\nToo short a line."), (3, 1, "early"), (3, 9000, "> early\nfar"), (3, 9001, "> far\nnear"),
    ]
    frame = spark.createDataFrame([(c, t, "r", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["linked"], r["depth"]) for r in quotes.conversations(frame).collect()}
    assert got[1, 1] == got[1, 3] == (0, 1, 1) and got[1, 5] == (4, 1, 1) and got[1, 6] == got[1, 7] == (0, 1, 1)
    assert got[2, 1] == (None, 0, 0) and got[3, 9000] == (1, 1, 1) and got[3, 9001] == (9000, 1, 2)
    twice = quotes.conversations(frame.unionByName(frame)).collect()
    assert sorted(r["position"] for r in twice if r["conv_id"] == 1) == list(range(16))
    assert {r["linked"] for r in twice if r["turn"] == 6} == {1}
    links = {(r["conv_id"], r["turn"]): r["source_turn"] for r in quotes.link_quotes(frame).collect()}
    assert links[1, 5] == 4 and links[2, 1] is None


def test_with_quotes_edges(spark):
    rows = [(1, t, "r", f"line {t} a\nline {t} b") for t in range(130)] + [(1, None, "r", "lost"), (None, 0, "r", "n"), (None, 1, "r", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["text"] for r in quotes.with_quotes(frame).collect()}
    assert len(got) == len(rows) and got[1, None] == "lost" and got[None, 0] == "n" and got[None, 1] is None
    assert got[1, 65] == ">> line 63 a\n>> line 63 b\n> line 64 a\n> line 64 b\nline 65 a\nline 65 b"
    assert got[1, 64] == ">> line 62 a\n> line 63 a\nline 64 a\nline 64 b" and got[1, 0] == "line 0 a\nline 0 b"
    assert quotes.with_quotes(frame.limit(0)).count() == 0


def test_reply_order(spark):
    """A deep chain: every parent comes before its replies, positions count from 0."""
    pick = random.Random(2)
    rows, parents = [], {}
    for turn in range(40):
        parent = pick.randrange(turn) if turn % 7 else None
        parents[turn] = parent
        rows.append((9, turn, "r", (f"> says {parent}\n" if parent is not None else "") + f"says {turn}"))
    got = {r["turn"]: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(r["position"] for r in got.values()) == list(range(40))
    for turn, parent in parents.items():
        assert got[turn]["parent_turn"] == parent and got[turn]["text"] == f"says {turn}"
        assert parent is None or got[parent]["position"] < got[turn]["position"]


def test_pipeline(spark, tmp_path):
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    docs = table(spark, SF, "documents").toPandas()
    assert set(pieces["doc_id"]) <= set(docs["doc_id"]) and pieces["doc_id"].nunique() > 0.6 * len(docs)
    classes = brute_classes([(i, t) for i, t in zip(docs["doc_id"], docs["text"], strict=True) if i in set(pieces["doc_id"])])
    assert all(i == c for i, c in classes.items())
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_edges(spark):
    labels = table(spark, SF, "labels").count()
    assert labels
    rows = [(1, "the cat and the dog sat on a mat today", "en", "s", 1, "x"), (2, None, "en", None, None, "x"), (3, "", None, "s", 0, "x"),
            (4, "the cat and the dog sat on a mat today", "en", "s", 1, "x"), (4, "the cat and the dog sat on a mat today", "en", "s", 1, "x"),
            (None, "the cat and the dog sat on a mat today", "en", "s", 1, "x")]
    for frame_rows in (rows, []):
        docs = spark.createDataFrame(frame_rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == corpus_pipeline.COLUMNS
        got = sorted((r["doc_id"] for r in docs.collect()), key=repr)
        assert got == ([1, None] if frame_rows else [])


def test_cells_never_rule_out_similar_texts(spark):
    pick, shingler, rows = random.Random(4), dartminhash.Shingler(), []
    for n in (6, 40, 120, 300):
        body = [f"w{pick.randint(0, 40 if n == 40 else 9000)}" for _ in range(n)]
        for edits in (0, 1, 2, 3, n // 20, n // 10, n):
            other = body.copy()
            for _ in range(edits):
                other[pick.randrange(n)] = f"x{pick.randint(0, 9000)}"
            a, b = shingler.weighted(body), shingler.weighted(other)
            w, v = int(a[1].sum()), int(b[1].sum())
            rows.append((dartminhash.weighted_jaccard(a, b), w, neardup.occupied(a[0], w).tolist(), v, neardup.occupied(b[0], v).tolist()))
    frame = spark.createDataFrame(rows, "s double, w long, c array<long>, w2 long, c2 array<long>")
    got = frame.select("s", neardup.cannot_reach(0.8, "w", "c", "w2", "c2").alias("out")).collect()
    assert not any(r["out"] for r in got if r["s"] >= 0.8) and sum(r["out"] for r in got) >= 0.6 * sum(r["s"] < 0.7 for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    from check import compare, connect

    ok, note = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note


def test_texts_that_share_an_id_stay_apart(spark):
    """Ids may repeat or be missing; every different text keeps a place of its own."""
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = "red orange yellow green blue indigo violet black white grey brown pink teal gold silver"
    rows = [(1, a), (1, b), (2, b + " copper"), (3, None), (4, a), (None, a), (None, "nothing else here is like this text at all")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = neardup.near_duplicates(docs, threshold=0.6).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((k is None, k or 0) for k, _ in rows)
    of = {}
    for r in found:
        of.setdefault(r.doc_id, set()).add(r.class_id)
    assert len(of[1]) == 2 and len(of[2] | of[4]) == 2 and of[2] | of[4] <= of[1] | {2} and len(of[None]) == 2
    kept = corpus_pipeline.distinct(spark, docs.unionByName(docs), "").collect()
    texts = [r.text for r in kept if r.doc_id is not None]
    # The longer text is 10 of 11 passages like the other: one of them stays.
    assert len(texts) == 3 and {a, None, b + " copper"} == set(texts) and len(kept) - len(texts) == 4
