"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability
sigmoid(bias + scores of its distinct words), a document if any sentence is
(noisy-or), and the likelihood of document labels alone trains the weights. The
same sentence scores then locate what is offending. A word scores the weights
of its known parts: itself and its n-grams, ends marked, so that inflected and
compound forms share evidence.

The classifier is fitted on a bounded sample of labelled documents
(``sample_docs``), half of them toxic where there are so many, weighted back to
the labels' own shares. Whole texts are read in fitting and scoring.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import picked_below, small_batches
from tagloom.session import store_table

_SENTENCE = re.compile(r"[^.!?\n]+")
_JVM_WORD = r"\p{L}+"
_WORD = regex.compile(_JVM_WORD)
GRAMS = (3, 7)


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]


NOTHING_LEARNED = ToxicityModel(-30.0, {})


def parts(word: str) -> set[str]:
    """The marked word and its marked n-grams."""
    marked = f"^{word}$"
    found = {marked[i : i + n] for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(marked) - n + 1)}
    found.add(marked)
    return found


class WordScores:
    """Scores of words, cached, ``cache_words`` of them at most."""

    def __init__(self, weights: dict[str, float], cache_words: int = 300_000):
        self._weights, self._most = weights, cache_words
        self._cache: dict[str, float] = {}

    def of(self, words: set[str]) -> float:
        cache, total = self._cache, 0.0
        for word in words:
            value = cache.get(word)
            if value is None:
                if len(cache) >= self._most:
                    cache.clear()
                get = self._weights.get
                value = cache[word] = sum([get(p, 0.0) for p in sorted(parts(word))])
            total += value
        return total


def fit(
    docs: DataFrame, labels: DataFrame, learn_from: Column, sample_docs: int = 8000, min_ratio: float = 4.0, chance: float = 1.0,
    rounds: int = 150, key: str = "doc_id", text: str = "text", label: str = "toxic",
) -> ToxicityModel:
    """Train on about ``sample_docs`` labelled documents for which ``learn_from`` holds.

    A document with several labels is toxic if any says so; null labels, null
    texts and ids without a document teach nothing. A part of a word carries
    weight if toxic documents have it ``min_ratio`` times as often as the others
    and chance does not explain it: the log-likelihood ratio of its counts
    against the classes' shares exceeds the log of the number of parts, so that
    about ``chance`` parts pass by accident, whatever the size. Every part that
    passes is kept. Without texts of both classes, or without such a part,
    nothing is learned and every score is next to 0.
    """
    spark = docs.sparkSession
    marked = labels.where(learn_from & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = toxic / max(1, toxic + clean)
    if not toxic or not clean:
        return NOTHING_LEARNED
    shares = {1: sample_docs / 2 / toxic, 0: sample_docs / 2 / clean}
    chosen = marked.where(
        ((F.col("y") == 1) & picked_below(shares[1], F.col("key"))) | ((F.col("y") == 0) & picked_below(shares[0], F.col("key"))))
    sample = store_table(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "key").select("key", "y", "text"), "toxicity-sample")  # at most about sample_docs ids
    n_toxic, n_clean = (max(1.0, min(float(sizes[y]), sample_docs / 2)) for y in (1, 0))
    words = (
        sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_JVM_WORD), F.lit(0)))).alias("word"))
        .groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    )
    rate = (F.col("t") + 0.5) / n_toxic / ((F.col("c") + 0.5) / n_clean)
    counts = store_table(words.select("t", "c", F.explode(_jvm_parts("word")).alias("part")).groupBy("part").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-parts")
    bound = math.log(max(1, counts.count()) / chance)
    q = n_toxic / (n_toxic + n_clean)

    def pull(n: str, share: float) -> Column:
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("t") + F.col("c")) * share))).otherwise(0.0)

    unlikely = pull("t", q) + pull("c", 1 - q) >= bound
    found = counts.where((rate >= min_ratio) & unlikely).orderBy("part").toPandas()["part"]
    index = {part: i for i, part in enumerate(found)}
    small_batches(spark)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for y, content in zip(batch["y"], batch["text"], strict=True):
                ids, ends = [], []
                for sentence in _sentences(content):
                    known = {index[p] for w in sentence[2] for p in parts(w) if p in index}
                    ids.extend(sorted(known))
                    ends.append(len(ids))
                rows.append((int(y), np.array(ids, dtype="<i4").tobytes(), np.array(ends, dtype="<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["y", "ids", "ends"])

    bags = sample.select("y", "text").mapInPandas(encode, "y int, ids binary, ends binary").toPandas()
    bags = bags[bags["ends"].str.len() > 0].sort_values(["y", "ids", "ends"], kind="stable")
    if set(bags["y"]) != {0, 1} or not index:
        return NOTHING_LEARNED
    weights = {1: share / 0.5, 0: (1 - share) / 0.5}
    return _train(bags, list(found), weights, rounds)


def _jvm_parts(word: str) -> Column:
    """``parts`` as an expression."""
    marked = F.concat(F.lit("^"), F.col(word), F.lit("$"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(marked), *[of_length(n) for n in range(GRAMS[0], GRAMS[1] + 1)]))


def _sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct words of each sentence that has a word."""
    for match in _SENTENCE.finditer(text):
        words = set(_WORD.findall(match.group().lower()))
        if words:
            yield match.start(), match.end(), words


def _train(bags: pd.DataFrame, words: list[str], class_weight: dict[int, float], rounds: int, l2: float = 1e-4) -> ToxicityModel:
    """Full-batch Adam on the noisy-or likelihood of the bags' labels."""
    y = bags["y"].to_numpy()
    ends = [np.frombuffer(e, dtype="<i4") for e in bags["ends"]]
    word_of = np.concatenate([np.frombuffer(x, dtype="<i4") for x in bags["ids"]])
    bag_of = np.repeat(np.arange(len(y)), [len(e) for e in ends])
    sentence_of = np.repeat(np.arange(len(bag_of)), np.concatenate([np.diff(e, prepend=0) for e in ends]))
    weight = np.array([class_weight[int(v)] for v in y]) / len(y)
    values = np.concatenate([np.zeros(len(words)), [-6.0]])
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, rounds + 1):
        z = np.clip(values[-1] + np.bincount(sentence_of, values[word_of], minlength=len(bag_of)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        total = np.maximum(np.bincount(bag_of, np.log1p(np.exp(z)), minlength=len(y)), 1e-9)
        pull = weight * np.where(y == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        by_sentence = pull[bag_of] * p
        gradient = np.concatenate([np.bincount(word_of, by_sentence[sentence_of], minlength=len(words)) + l2 * values[:-1] / len(words), [by_sentence.sum()]])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        values = values - 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
    return ToxicityModel(float(values[-1]), {w: float(v) for w, v in zip(words, values, strict=False)})


RESULT = "score double, sentences int, offending array<struct<start:int,end:int,score:double>>"


def score_text(bias: float, words: WordScores, text: str | None, least: float = 0.5) -> tuple[float, int, list[dict]]:
    """Noisy-or score, number of sentences, and the spans of sentences from ``least`` on."""
    spans = list(_sentences(text)) if text else []
    if not spans:
        return 0.0, 0, []
    z = np.array([bias + words.of(found) for _, _, found in spans])
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    score = -np.expm1(-np.logaddexp(0, z).sum())
    hits = [{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= least)]
    return float(score), len(spans), hits


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """``keep`` columns with ``score``, ``sentences`` and ``offending`` spans.

    Spans are code point offsets in the text. Null texts and texts without a
    word score 0. A repeated row gets its result again; other columns are not
    read, whatever their names.
    """
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = WordScores(model.weights)
        for texts in batches:
            yield pd.DataFrame([score_text(model.bias, words, t, least) for t in texts], columns=["score", "sentences", "offending"])

    scored = F.pandas_udf(apply, RESULT)
    return docs.select(*keep, scored(F.col(text)).alias("__tox")).select(
        *keep, "__tox.score", "__tox.sentences", "__tox.offending")
