"""Quality rules: text statistics and a learned decision list, native to Spark.

Statistics are array and string expressions inside one row; nothing is exploded
or shuffled for them. The list is learned by sequential covering: each rule
grows a conjunction of thresholds that gains most information about bad texts
on labelled statistics, is pruned on a held-out part, and takes what it covers
out of play. The learned list is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import id_fold, let
from tagloom.session import store_table

_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: str) -> Column:
    """Runs of characters other than space and the five controls from tab to return; null: none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more in the text.

    Windows are keyed by a 64-bit hash of their words and sorted with their
    places; equal neighbours are repeats. Each repeated window then adds the
    words up to the next one, ``width`` at most, so no word counts twice.
    """

    def windows(w: Column) -> Column:
        key = lambda i: F.struct(F.xxhash64(*[w[i + k] for k in range(width)]).alias("h"), i.alias("i"))
        return F.when(F.size(w) >= width + 1, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - width), key)))

    def places(s: Column) -> Column:
        same = lambda e, j: (
            ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        step = lambda i, j: F.least(F.coalesce(F.get(p, j + 1) - i, F.lit(width)), F.lit(width))
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

    return F.coalesce(let(let(windows(words), places), covered), F.lit(0)).cast("long")


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the five base counts of each whole text (null: no words).

    ``n_dup_lines`` counts lines with a word that equal an earlier line.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.length(F.translate(line, _SPACE, "")) > 0)
    duplicates = let(lines, lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long"))
    by_word = docs.select(
        *keep, let(words_of(text), counts).alias("__w"),
        F.length(F.translate(whole, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicates.alias("n_dup_lines"),
    )
    return by_word.select(*keep, F.col("__w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                          F.col("__w.n_repeat_words").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may test, all from the base counts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines").cast("double"),
        "dup_line_share": F.col("n_dup_lines") * 10 / n, "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, Column]) -> Column:
        column = values[self.feature]
        return column > self.threshold if self.above else column <= self.threshold


Rule = tuple[Condition, ...]


def matches(rule: Rule, values: dict[str, Column]) -> Column:
    held = F.lit(True)
    for condition in rule:
        held = held & condition.holds(values)
    return held


def verdict(rules: list[Rule], values: dict[str, Column] | None = None) -> Column:
    """The number of the first rule that matches, from 1; null where none does (the text is good)."""
    values = values or features()
    chain = None
    for number, rule in enumerate(rules, 1):
        chain = F.when(matches(rule, values), number) if chain is None else chain.when(matches(rule, values), number)
    return chain if chain is not None else F.lit(None).cast("int")


def learn(
    labelled: DataFrame, good: str = "quality", key: str = "doc_id", cuts: int = 24, max_rules: int = 6,
    max_conditions: int = 3, least_precision: float = 0.75, least_bad: int = 3,
) -> list[Rule]:
    """An ordered list of rules that mark bad texts (``good`` = 0) from labelled base counts.

    All labelled rows are used; null labels are left out. Values are first
    replaced by their place among ``cuts`` quantiles and equal rows counted, so
    that each step reads a small table and returns one count per feature and
    cut. Growing picks the condition with the greatest information gain over
    bad texts until no good one is left; pruning drops last conditions while
    precision on the third of the rows kept for it does not fall. A rule below
    ``least_precision`` there, or with fewer than ``least_bad`` bad texts, ends
    the list. With one class only there are no rules. Ties go to the first
    feature and the lowest cut.
    """
    values = features()
    rows = store_table(
        labelled.where(F.col(good).isNotNull()).select(
            (F.col(good) == 0).alias("bad"), (F.coalesce(id_fold(key, 3), F.lit(0)) == 0).alias("prune"),
            *[v.alias(n) for n, v in values.items()]), "quality-labelled")
    points = rows.select(*[
        F.percentile_approx(F.when(F.col("bad") == b, F.col(n)), [i / cuts for i in range(cuts + 1)], 10_000).alias(f"{n}_{b}")
        for n in values for b in (True, False)]).first()
    edges = {n: sorted({*(points[f"{n}_True"] or []), *(points[f"{n}_False"] or [])}) for n in values}
    place = {n: _place(F.col(n), edges[n]) for n in values}
    table = store_table(
        rows.select("bad", "prune", *[p.alias(n) for n, p in place.items()]).groupBy("bad", "prune", *values)
        .agg(F.count(F.lit(1)).alias("n")), "quality-cells")
    cells = {n: F.col(n) for n in values}

    def counted(where: Column) -> dict[str, dict[int, list[int]]]:
        """Bad and good rows by feature and place."""
        long = table.where(where).select("bad", "n", F.explode(F.array(*[
            F.struct(F.lit(n).alias("f"), F.col(n).alias("at")) for n in values])).alias("c"))
        found: dict[str, dict[int, list[int]]] = {n: {} for n in values}
        for r in long.groupBy("c.f", "c.at").agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"),
            F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g")).collect():
            found[r["f"]][r["at"]] = [r["b"], r["g"]]
        return found

    def sums(where: Column) -> tuple[int, int]:
        r = table.where(where).agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n")))).first()
        return int(r[0] or 0), int(r[1] or 0)

    rules: list[list[tuple[str, bool, int]]] = []
    left = F.lit(True)
    for _ in range(max_rules):
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < max_conditions:
            best = _best_condition(counted(left & ~F.col("prune") & _cell_match(grown, cells)))
            if best is None:
                break
            grown.append(best[0])
            if best[1] == 0:
                break
        kept, precision, bad = grown, 0.0, 0
        for size in range(len(grown), 0, -1):
            b, g = sums(left & F.col("prune") & _cell_match(grown[:size], cells))
            if (b + 1) / (b + g + 2) >= precision:
                kept, precision, bad = grown[:size], (b + 1) / (b + g + 2), b
        if not grown or precision < least_precision or bad < least_bad:
            break
        rules.append(kept)
        left = left & ~_cell_match(kept, cells)
    return [tuple(Condition(f, above, _midway(edges[f], at)) for f, above, at in rule) for rule in rules]


def _midway(edges: list[float], at: int) -> float:
    """Half way to the next edge, so that a threshold keeps its distance from either class."""
    return (edges[at] + edges[at + 1]) / 2 if at + 1 < len(edges) else edges[at]


def _place(column: Column, edges: list[float]) -> Column:
    """How many edges lie below the value: place p means above edge p-1 and not above edge p."""
    found = F.lit(0)
    for edge in edges:
        found = found + (column > float(edge)).cast("int")
    return found


def _cell_match(rule: list[tuple[str, bool, int]], cells: dict[str, Column]) -> Column:
    held = F.lit(True)
    for feature, above, at in rule:
        held = held & ((cells[feature] > at) if above else (cells[feature] <= at))
    return held


def _best_condition(counts: dict[str, dict[int, list[int]]]) -> tuple[tuple[str, bool, int], int] | None:
    """The condition with the greatest gain and the good rows it leaves; None if none gains."""
    best, best_gain, left_good = None, 0.0, 0
    for feature, by_place in counts.items():
        bad, good = sum(b for b, _ in by_place.values()), sum(g for _, g in by_place.values())
        if not bad:
            return None
        before = math.log2(bad / (bad + good))
        low_bad = low_good = 0
        for at in sorted(by_place)[:-1]:
            low_bad, low_good = low_bad + by_place[at][0], low_good + by_place[at][1]
            for above, b, g in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                gain = b * (math.log2(b / (b + g)) - before) if b else 0.0
                if gain > best_gain + 1e-9:
                    best, best_gain, left_good = (feature, above, at), gain, g
    return (best, left_good) if best else None


def judge(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``rule`` (number of the matching rule) and ``kept``.

    Null and empty texts have no words and fail the base. A repeated row is
    judged again, an empty table gives no rows, other columns are not read.
    """
    return decide(statistics(docs, [key], text), rules, key)


def decide(counted: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    judged = counted.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return judged.select(key, *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
