"""Language identification by words first, then shorter and shorter n-grams.

A known word scores by its log relative frequency in each language. An unseen
word backs off: with spaces marked at both ends, its n-grams of the greatest
length of which any is known are averaged; if none is known, the next shorter
length is tried. A text scores the mean over its words.

Words are runs of letters, lower-cased. The model is fitted on a bounded sample
of labelled rows (``docs_per_language``), which bounds what is sent to tasks;
whole texts are counted and scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import picked_below, small_batches
from tagloom.session import store_table

UNDETERMINED = "und"
LONGEST_GRAM = 5
# A letter is a character of the Unicode category L, here and in the JVM.
_JVM_WORD = r"\p{L}+"
_WORD = regex.compile(_JVM_WORD)


@dataclass(frozen=True)
class LanguageModel:
    """Log10 frequencies by language, one row for each word or n-gram."""

    languages: tuple[str, ...]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def fit(
    docs: DataFrame, lang: str = "lang", text: str = "text", docs_per_language: int = 2000,
    min_word: int = 3, min_gram: int = 5, key: str = "doc_id",
) -> LanguageModel:
    """A model of about ``docs_per_language`` whole texts of each language.

    Rows whose language or text is null are left out; the choice hashes ``key``,
    so it is repeatable. Words seen fewer than ``min_word`` and n-grams fewer
    than ``min_gram`` times count as unseen. Without any labelled row the model
    has no language and every text is undetermined.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col("lang") == name) & picked_below(docs_per_language / sizes[name], F.col("key")))
    words = (
        labelled.where(chosen)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_JVM_WORD), F.lit(0))).alias("word"))
        .groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    )
    words = store_table(words, "language-words")
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    def of_length(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        cut = F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))
        return words.where(F.length(marked) >= n).select("lang", "n", F.explode(cut).alias("gram"))

    by_length = [of_length(n) for n in range(1, LONGEST_GRAM + 1)]
    grams = by_length[0]
    for more in by_length[1:]:
        grams = grams.unionByName(more)
    grams = grams.groupBy("gram", "lang").agg(F.sum("n").alias("n"))

    def logs(counts: DataFrame, name: str, least: int, totals) -> tuple[dict[str, int], np.ndarray]:
        kept = counts.groupBy(name).agg(F.sum("n").alias("all"), *[
            F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)
        ]).where(F.col("all") >= least).orderBy(name).toPandas()
        table = kept[[f"n{i}" for i in range(len(languages))]].to_numpy(dtype=float) if languages else np.zeros((0, 0))
        return {x: i for i, x in enumerate(kept[name])}, np.log10((table + 0.5) / totals(kept[name], table))

    def over_words(_, table):
        return table.sum(axis=0) + 1.0

    def over_grams(names, table):
        length = np.array([len(x) for x in names], dtype=int)
        sums = np.ones((LONGEST_GRAM + 1, table.shape[1]))
        np.add.at(sums, length, table)
        return sums[length]

    word_index, word_logs = logs(words, "word", min_word, over_words)
    gram_index, gram_logs = logs(grams, "gram", min_gram, over_grams)
    return LanguageModel(languages, word_index, word_logs, gram_index, gram_logs)


class Scorer:
    """Scores texts; unseen words are cached, ``cache_words`` of them at most."""

    def __init__(self, model: LanguageModel, cache_words: int = 300_000, evidence: int = 10):
        self._model, self._evidence = model, evidence
        self._logs = np.concatenate([model.word_logs, np.zeros((cache_words, len(model.languages)))])
        self._known = len(model.words)
        self._index = dict(model.words)
        self._next = self._known
        self._floor = np.full(len(model.languages), math.log10(0.5) - 3)

    def backed_off(self, word: str) -> np.ndarray:
        marked, grams = f" {word} ", self._model.grams
        for n in range(min(LONGEST_GRAM, len(marked)), 0, -1):
            rows = [at for i in range(len(marked) - n + 1) if (at := grams.get(marked[i : i + n])) is not None]
            if rows:
                return self._model.gram_logs[rows].mean(axis=0)
        return self._floor

    def _row(self, word: str) -> int:
        at = self._index.get(word)
        if at is None:
            at = self._next
            self._logs[at] = self.backed_off(word)
            self._index[word] = at
            self._next += 1
        return at

    def score(self, text: str | None) -> tuple[str, float]:
        """Best language and its share of the posterior; ties go to the first by name."""
        words = _WORD.findall(text.lower()) if text else []
        if not words or not self._model.languages:
            return UNDETERMINED, 0.0
        total = np.zeros(len(self._model.languages))
        for start in range(0, len(words), 50_000):
            part = words[start : start + 50_000]
            if self._next + len(part) > len(self._logs):
                self._index, self._next = dict(self._model.words), self._known
            rows = list(map(self._index.get, part))
            if None in rows:
                rows = [self._row(w) if at is None else at for w, at in zip(part, rows, strict=True)]
            total += self._logs[rows].sum(axis=0)
        power = total / len(words) * min(len(words), self._evidence) * math.log(10)
        share = np.exp(power - power.max())
        best = int(np.argmax(share))
        return self._model.languages[best], float(share[best] / share.sum())


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (0 to 1) of the whole text.

    Null texts and texts without a letter are ``und`` with score 0. Only the text
    is an input of the prediction. A repeated row gets its result again. Columns
    not in ``keep`` are not read, whatever their names.
    """
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.DataFrame([scorer.score(t) for t in texts], columns=["lang_pred", "score"])

    scored = F.pandas_udf(apply, "lang_pred string, score double")
    return docs.select(*keep, scored(F.col(text)).alias("__lang")).select(*keep, "__lang.lang_pred", "__lang.score")
