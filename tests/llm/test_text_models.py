"""Language identification, toxicity, url filter: edge cases and held-out accuracy."""

import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import langid, queries, toxicity, urls
from tagloom.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, __lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, letterless, very long and repeated texts; columns whose names clash."""
    return spark.createDataFrame([
        (1, "the cat and the dog " * 30, "en", 5.0, "x"), (2, "der hund und die katze " * 30, "de", 5.0, "x"),
        (3, None, "en", 5.0, "x"), (4, "", None, 5.0, "x"), (5, "12 %% 34", "en", None, None), (6, "the dog " * 40_000, None, 5.0, "x"),
        (7, "the dog", "en", 5.0, "x"), (7, "the dog", "en", 5.0, "x"), (None, "die katze", "de", 5.0, "x"),
    ], DOCS)


def test_language_edges(odd):
    model = langid.fit(odd, min_word=1, min_gram=1)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd, model, ["doc_id"]).collect()]
    by_id = {i: p for i, p, _ in got}
    assert by_id == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", 7: "en", None: "de"}
    assert len(got) == 9 and all(0 <= s <= 1 for _, _, s in got)


def test_language_backoff_uses_shorter_grams(odd):
    scorer = langid.Scorer(langid.fit(odd, min_word=1, min_gram=1))
    assert scorer.score("katzen")[0] == "de" and scorer.score("theo")[0] == "en"
    assert scorer.score("ж")[0] in ("de", "en")


def test_language_without_rows(odd):
    empty = odd.limit(0)
    model = langid.fit(empty)
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, model, ["doc_id"]).collect()} == {"und"}


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_toxicity_finds_the_sentence(spark):
    rows = [(i, f"Plain words stay here {'abcdefgh'[i % 8]}. " + ("You vilewort! " if i % 2 else "You friend! ") + "All is well.") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 150)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i]["score"] >= 0.7) == bool(i % 2) for i in range(150, 200))
    start, end, _ = got[151]["offending"][0]
    assert len(got[151]["offending"]) == 1 and "vilewort" in rows[151][1][start:end]


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    one_class = toxicity.fit(odd, labels, F.lit(True))
    assert one_class == toxicity.NOTHING_LEARNED
    none = toxicity.fit(odd.limit(0), labels.limit(0), F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, none, ["doc_id"]).collect()}
    assert got[3] == got[4] == 0.0 and all(0 <= s <= 1 for s in got.values())
    two = toxicity.fit(odd, spark.createDataFrame([(1, 1), (2, 0), (7, 0)], "doc_id long, toxic int"), F.lit(True), min_ratio=1.0, chance=1e9)
    assert toxicity.score(odd, two, ["doc_id"]).count() == 9


def test_toxicity_held_out(spark):
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert held[held["toxic"] == 1]["predicted"].mean() > 0.75
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.02


URLS = [
    (1, "http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    (2, "https://b.net/x", "b.net", "/x", "net/", "block"), (3, "https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    (4, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (5, "x://y.org/fr/://z", "y.org", "/fr/://z", "org/fr/", "allow"),
    (6, None, "", "", None, None), (7, "no scheme/en", "", "", None, None), (8, "", "", "", None, None),
    (9, "http://\n.org?/fr/", "\n.org", "", None, None), (9, "http://\n.org?/fr/", "\n.org", "", None, None),
    (10, "http://net/" + "a" * 50_000, "net", "/" + "a" * 50_000, "net/", "block"), (None, "http://ÄB.net/", "Äb.net", "/", "net/", "block"),
]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in URLS], "page_id long, url string, host string, rule string")
    got = urls.judge(pages, queries.URL_RULES).collect()
    want = sorted(((i, h, p, r) for i, _, h, p, r, _ in URLS), key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=repr) == want
    by_rule = {r["page_id"]: r["verdict"] for r in got if r["rule"]}
    assert by_rule == {i: v for i, *_, r, v in URLS if r}
    assert {r["verdict"] for r in got} <= {"allow", "block"}


def test_url_without_examples(spark):
    pages = spark.createDataFrame([(1, "http://a.xx/b"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(pages, queries.URL_RULES).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_model_counts_by_hand(spark):
    texts = [("\x02ab\x03", True)] * 3 + [("\x02cd\x03", False)] * 2
    model = urls.fit(spark.createDataFrame(texts, "text string, accepted boolean"), folds=1_000_003)
    assert model.contexts[""] == (9, 6, 3, 3) and model.children["\x02a"] == (3, 0)
    judge = urls.Judge(model)
    assert judge.difference("\x02ab\x03") > 0 > judge.difference("\x02cd\x03")


def test_url_model_generalises(spark):
    got = queries.op7_url_filter(spark, SF).where(F.col("rule").isNotNull()).toPandas()
    right = ((got["difference"] > 0) == (got["verdict"] == "allow")).mean()
    assert right > 0.95


def test_url_model_keeps_every_gram(spark, monkeypatch):
    """A host seen ten times among 1,500,000 characters is in the model; a model in tables gives the same differences."""
    texts = [("\x02" + "ab" * 50 + "\x03", i % 2 == 0, 7500) for i in range(2)] + [("\x02zq.xy/\x03", True, 5), ("\x02zq.xv/\x03", False, 5)]
    frame = spark.createDataFrame(texts, "text string, accepted boolean, n int")
    frame = frame.select(F.explode(F.sequence(F.lit(1), F.col("n"))), "text", "accepted").drop("col")
    local = urls.fit(frame, folds=1_000_003)
    assert local.children["q.xy/\x03"] == (5, 0) and local.contexts["zq.x"] == (5, 5, 1, 1)
    monkeypatch.setattr(urls, "LOCAL_GRAMS", 0)
    large = urls.fit(frame, folds=1_000_003)
    assert large.tables is not None and large.threshold == local.threshold
    asked = spark.createDataFrame([(1, "\x02zq.xy/\x03"), (2, "\x02zq.xv/\x03"), (3, None), (4, ""), (5, "\x02newé\x03"), (6, "\x02zq.xy/\x03")], "i int, t string")
    one = {r["i"]: r["difference"] for r in urls.score(asked, local, ["i"], "t").collect()}
    two = {r["i"]: r["difference"] for r in urls.score(asked, large, ["i"], "t").collect()}
    assert one[1] > 0.05 and one[2] < -0.05 and two == pytest.approx(one, abs=1e-12)


def test_only_letters_make_a_language(spark):
    """Numerals that are no letters (fractions, superscripts, Roman numeral signs) give no language."""
    docs = spark.createDataFrame([(i, "le chat et la souris", "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "12 _ 3"), (3, "le ² chat")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(odd, model, ["doc_id"]).orderBy("doc_id").collect()] == ["und", "und", "fr"]
