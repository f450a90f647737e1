"""URL filter: host and path rules, then a ratio of two character models.

URLs that a rule settles are the examples: one variable-order Markov model is
fitted to the accepted and one to the rejected. The others are judged by the
difference of their log-likelihoods per character against a threshold
calibrated on examples that the models have not seen.

All examples are counted and every context and continuation stays in the model,
so what the models hold follows the input. A model of few n-grams is looked up
row by row; a larger one stays in tables, which the distinct n-grams of the
distinct URLs are joined with. Both ways give the same differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import store_table

ORDER = 5
# Models of at most so many n-grams are sent to tasks as dictionaries.
LOCAL_GRAMS = 300_000
BEGIN, END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """From the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ``? #``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``host/path`` and what to do; fits the host, its subdomains and longer paths."""

    action: str
    text: str

    def fits(self, host: str, path: str) -> Column:
        name, _, rest = self.text.partition("/")
        named = (F.col(host) == name) | F.col(host).endswith("." + name)
        return named & F.col(path).startswith("/" + rest)


def longest_rule(rules: list[Rule], host: str, path: str, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; ties go to the first given."""
    chain = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        case = (rule.fits(host, path), F.lit(value(rule)))
        chain = F.when(*case) if chain is None else chain.when(*case)
    return chain if chain is not None else F.lit(None).cast("string")


def shape(url: str) -> Column:
    """What the models read: the whole url after ``://``, query and fragment too, each run of digits as one ``0``, ends marked.

    The host is lower-cased; without ``://`` the url is read as it is, and null is empty.
    """
    whole = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    read = F.when(F.contains(whole, F.lit("://")), F.concat(host_of(url), rest)).otherwise(whole)
    return F.concat(F.lit(BEGIN), F.regexp_replace(read, r"[0-9]+", "0"), F.lit(END))


@dataclass(frozen=True)
class UrlModel:
    """Witten-Bell estimates of both models; ``contexts`` by context, ``children`` by context and character.

    A large model has both as ``tables`` instead: ``context`` with ``sy``, ``sx``,
    ``dy`` and ``dx``, and ``gram`` with ``y`` and ``x``.
    """

    contexts: dict[str, tuple[int, int, int, int]]
    children: dict[str, tuple[int, int]]
    alphabet: int
    threshold: float
    tables: tuple[DataFrame, DataFrame] | None = None


def fit(examples: DataFrame, text: str = "text", accepted: str = "accepted", folds: int = 5) -> UrlModel:
    """Fit and calibrate on all ``examples`` (``text`` as ``shape`` gives it, boolean ``accepted``).

    Equal texts are counted together first, so that repeated URLs cost nothing.
    One text in ``folds``, by hash, is kept for the threshold with the best mean
    of both classes' accuracies. Null texts and labels are left out. Without
    examples of both classes every difference is 0 and the threshold too.
    """
    counted = (
        examples.where(F.col(text).isNotNull() & F.col(accepted).isNotNull())
        .groupBy(F.col(text).alias("t"), F.col(accepted).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    )
    counted = store_table(counted.withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(folds))), "url-examples")
    taught = counted.where((F.col("fold") != 0) & (F.length("t") > 1))
    yes, no = F.when(F.col("a"), F.col("n")).otherwise(0), F.when(~F.col("a"), F.col("n")).otherwise(0)

    def grams(t: Column) -> Column:
        def at(i: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.least(i - 1, F.lit(ORDER))), lambda m: F.substring(t, i - m, m + 1))

        return F.flatten(F.transform(F.sequence(F.lit(2), F.length(t)), at))

    pairs = (
        taught.select(yes.alias("y"), no.alias("x"), F.explode(grams(F.col("t"))).alias("gram"))
        .groupBy("gram").agg(F.sum("y").alias("y"), F.sum("x").alias("x"))
    )
    pairs = store_table(pairs, "url-grams")
    totals = pairs.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).agg(
        F.sum("y").alias("sy"), F.sum("x").alias("sx"),
        F.sum((F.col("y") > 0).cast("long")).alias("dy"), F.sum((F.col("x") > 0).cast("long")).alias("dx"))
    totals = store_table(totals, "url-contexts")
    top = totals.where(F.col("context") == "").first()
    if top is None or not top["sy"] or not top["sx"]:
        return UrlModel({}, {}, 1, 0.0)
    alphabet = 1 + pairs.where(F.length("gram") == 1).count()
    if pairs.count() <= LOCAL_GRAMS:
        kept, sums = pairs.toPandas(), totals.toPandas()
        children = {g: (int(y), int(x)) for g, y, x in zip(kept["gram"], kept["y"], kept["x"], strict=True)}
        contexts = {c: (int(sy), int(sx), int(dy), int(dx)) for c, sy, sx, dy, dx in sums.itertuples(index=False)}
        model = UrlModel(contexts, children, alphabet, 0.0)
    else:
        model = UrlModel({}, {}, alphabet, 0.0, (totals, pairs))
    step = 0.01
    held = score(counted.where(F.col("fold") == 0), model, ["a", "n"], "t").select(
        F.greatest(F.least(F.round(F.col("difference") / step), F.lit(1000)), F.lit(-1000)).cast("int").alias("bin"), "a", "n")
    bins = held.groupBy("bin").agg(F.sum(yes).alias("y"), F.sum(no).alias("x")).toPandas().sort_values("bin")
    return replace(model, threshold=step * _best_cut(bins))


def _best_cut(bins: pd.DataFrame) -> float:
    """Bin position from which accepting gives the best balanced accuracy; of equal ones the nearest to 0."""
    if bins["y"].sum() == 0 or bins["x"].sum() == 0:
        return 0.0
    y, x = bins["y"] / bins["y"].sum(), bins["x"] / bins["x"].sum()
    right = pd.concat([1 - y.cumsum() + x.cumsum()]).tolist()  # cut just above each bin
    at = bins["bin"].tolist()
    cuts = [(1.0, at[0] - 0.5), *[(r, (b + c) / 2) for r, b, c in zip(right, at, at[1:] + [at[-1] + 1], strict=True)]]
    best = max(r for r, _ in cuts)
    return min((c for r, c in cuts if r >= best - 1e-12), key=abs)


class Judge:
    """Log-likelihood difference per character; steps are cached by context and character."""

    def __init__(self, model: UrlModel, most: int = 500_000):
        self._model, self._most = model, most
        self._steps: dict[str, float] = {}

    def _step(self, gram: str) -> float:
        p = [1.0 / self._model.alphabet] * 2
        for m in range(len(gram)):
            context = gram[len(gram) - 1 - m : -1]
            sums = self._model.contexts.get(context)
            if sums is None:
                break
            seen = self._model.children.get(context + gram[-1], (0, 0))
            for k in (0, 1):
                if sums[k]:
                    p[k] = (seen[k] + sums[2 + k] * p[k]) / (sums[k] + sums[2 + k])
        return math.log(p[0]) - math.log(p[1])

    def difference(self, text: str | None) -> float:
        if not text or len(text) < 2 or not self._model.contexts:
            return 0.0
        if len(self._steps) > self._most:
            self._steps.clear()
        total = 0.0
        for i in range(1, len(text)):
            gram = text[max(0, i - ORDER) : i + 1]
            step = self._steps.get(gram)
            if step is None:
                step = self._steps[gram] = self._step(gram)
            total += step
        return total / (len(text) - 1)


def score(urls: DataFrame, model: UrlModel, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns and ``difference`` (above 0: likelier accepted); null and empty texts get 0.

    Rounded to nine digits, so that the order of additions decides no verdict.
    """
    if model.tables is not None:
        rows = urls.select(*keep, F.col(text).alias("__text"))
        found = _differences(urls.select(F.col(text).alias("__text")), model)
        return rows.join(found, "__text", "left").select(*keep, F.round(F.coalesce("__difference", F.lit(0.0)), 9).alias("difference"))

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(model)
        for texts in batches:
            yield pd.Series([judge.difference(t) for t in texts], dtype="float64")

    return urls.select(*keep, F.round(F.pandas_udf(apply, "double")(F.col(text)), 9).alias("difference"))


def _differences(texts: DataFrame, model: UrlModel) -> DataFrame:
    """``__difference`` of each distinct ``__text`` of two characters or more, from a model in tables.

    Estimates are made once for a distinct n-gram. A context that was seen was
    seen with every shorter one, so the contexts that are found are those the
    estimate goes through.
    """
    totals, pairs = model.tables
    texts = store_table(texts.where(F.length("__text") > 1).distinct(), "url-texts")
    at = F.explode(F.sequence(F.lit(2), F.length("__text"))).alias("at")
    gram = F.expr(f"substring(__text, greatest(at - {ORDER}, 1), least(at, {ORDER + 1}))")
    # Two hashes stand for a text, so that it is not moved once a character.
    name = [F.xxhash64("__text").alias("h1"), F.xxhash64(F.lit(1), "__text").alias("h2")]
    places = store_table(
        texts.select("__text", *name, at).select("h1", "h2", gram.alias("gram")).groupBy("h1", "h2", "gram").agg(F.count(F.lit(1)).alias("n")),
        "url-places")
    wanted = store_table(places.select("gram").distinct(), "url-wanted")
    ends = wanted.select("gram", F.explode(F.expr("transform(sequence(1, length(gram)), m -> substring(gram, length(gram) - m + 1, m))")).alias("end"))
    known = ends.select("end").distinct().withColumn("context", F.expr("substring(end, 1, length(end) - 1)")).join(totals, "context").join(
        pairs.withColumnRenamed("gram", "end"), "end", "left").na.fill(0, ["y", "x"]).drop("context")
    levels = ends.join(store_table(known, "url-known"), "end").groupBy("gram").agg(
        F.array_sort(F.collect_list(F.struct(F.length("end").alias("m"), "y", "x", "sy", "sx", "dy", "dx"))).alias("levels"))

    def estimate(seen: str, sums: str, kinds: str) -> Column:
        return F.aggregate("levels", F.lit(1.0 / model.alphabet), lambda p, v: F.when(
            v[sums] > 0, (v[seen] + v[kinds] * p) / (v[sums] + v[kinds])).otherwise(p))

    steps = store_table(levels.select("gram", (F.log(estimate("y", "sy", "dy")) - F.log(estimate("x", "sx", "dx"))).alias("step")), "url-steps")
    sums = places.join(steps, "gram").groupBy("h1", "h2").agg((F.sum(F.col("n") * F.col("step")) / F.sum("n")).alias("__difference"))
    return store_table(texts.select("__text", *name).join(sums, ["h1", "h2"]).select("__text", "__difference"), "url-differences")


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``difference`` of every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is judged by the models like any other; they read the whole url. A
    difference equal to the threshold is accepted. A repeated row is judged again
    and counts again as an example; an empty table gives no rows. Other columns
    are not read.
    """
    parsed = pages.select(F.col(key).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), shape(url).alias("text"))
    ruled = parsed.select(
        "*", longest_rule(rules, "host", "path", lambda r: r.text).alias("rule"),
        longest_rule(rules, "host", "path", lambda r: r.action).alias("action"))
    examples = ruled.where(F.col("action").isNotNull()).select("text", (F.col("action") == "allow").alias("accepted"))
    model = fit(examples)
    judged = score(ruled, model, ["page_id", "host", "path", "rule", "action"], "text")
    by_model = F.when(F.col("difference") >= model.threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", by_model).alias("verdict"), "difference")
