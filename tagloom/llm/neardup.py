"""Near-duplicate classes of documents by banded weighted minwise signatures.

1. Every text becomes a weighted set of hashed shingles (five lower-cased words,
   weighted by how often each occurs) and a dart signature; texts of equal words
   collapse to the one with the smallest id.
2. Representatives that share a band meet in a bucket. In each bucket one member is
   the pivot and the rest are compared with it: first the one that meets most
   others over all its buckets (the original of many near copies does), then one
   picked by a hash. A hot bucket costs one comparison per member each time.
3. Comparisons are exact (weighted Jaccard on whole texts); links make classes.
4. A bucket that still holds several classes is not settled. If few of its members
   are outside its largest class, these meet all of other classes. If many are, its
   members go into a prefix join: with all shingles in one order, rare ones first,
   two texts that reach the threshold share a shingle near the front of both, so
   those that share one there meet. Of the pairs of 4 those are compared whose
   occupied cells (a bitmap of shingle hashes) do not rule the similarity out.
   Both ways are exact: to share one band is enough, however large the bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import small_batches
from tagloom.llm.components import components
from tagloom.llm.dartminhash import Darts, Shingler, mix, weighted_jaccard
from tagloom.session import broadcast_if_small, store_table

THRESHOLD = 0.8
WIDTH = 5
# An unsettled bucket with at most so many members outside its largest class has
# them compared with the rest: a bounded number of partners for each member. The
# members of others go into the prefix join.
FEW = 48
# Cells of the sketch that orders shingles by how often they occur. It decides
# what the prefix join costs, not what it finds.
_SKETCH = 1 << 21
# A shingle at the front of more texts than this is joined by classes of weight,
# each a factor _STEP wide.
_HOT = 64
_STEP = 1.05
# Rows of one shingle that one task's block of the prefix join holds.
_BLOCK = 2048
_CELLS = 200_000
# Texts whose shingles a task keeps at hand while it compares pairs.
_RECENT = 256


def occupied(values: np.ndarray, weight: int) -> np.ndarray:
    """A bitmap of the cells that shingle hashes fall in, eight to sixteen cells a unit of weight, as 64-bit words."""
    n_words = 1 << max(0, int(weight - 1).bit_length() - 3)
    cells = np.unique((values & np.uint64(n_words * 64 - 1)).astype(np.int64))
    words = np.zeros(n_words, dtype=np.uint64)
    np.bitwise_or.at(words, cells >> 6, np.uint64(1) << (cells & 63).astype(np.uint64))
    return words.view(np.int64)


def cannot_reach(threshold: float, w1: str, c1: str, w2: str, c2: str) -> Column:
    """True only if two texts' weights and cells show that their similarity is below ``threshold``.

    A cell that one text occupies and the other does not holds weight of at least
    1 that they do not share. Bitmaps of different length are not compared.
    """

    def alone(x: str, y: str) -> Column:
        rest = F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))).cast("long"))
        return F.aggregate(rest, F.lit(0).cast("long"), lambda total, n: total + n)

    shared = F.least(F.col(w1) - alone(c1, c2), F.col(w2) - alone(c2, c1))
    return (F.size(c1) == F.size(c2)) & (shared < threshold * (F.col(w1) + F.col(w2) - shared) - 1e-9)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def signatures(docs: DataFrame, darts: Darts, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``content`` (digest of the words), ``weight``, ``bands`` and ``cells`` of texts with a word."""
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            rows, sets, cells = [], [], 0
            for k, content in zip(batch["key"], batch["text"], strict=True):
                words = words_of(content)
                if words:
                    sets.append(shingler.weighted(words))
                    rows.append((k, hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest(), int(sets[-1][1].sum())))
                    cells += len(words)
                if cells > _CELLS:
                    yield finish(rows, sets)
                    rows, sets, cells = [], [], 0
            if rows:
                yield finish(rows, sets)

    def finish(rows: list[tuple], sets: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "content", "weight"])
        out["cells"] = [occupied(values, weight) for (values, _), weight in zip(sets, out["weight"], strict=True)]
        out["bands"] = list(darts.band_keys(darts.signatures(sets)))
        return out

    wanted = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    return wanted.mapInPandas(apply, "key long, content string, weight long, cells array<long>, bands array<long>")


def similar(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``a``, ``b`` whose whole texts reach ``threshold``, with ``similarity``.

    Texts of candidates alone are shuffled.
    """
    ids = store_table(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "candidates")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = store_table(texts.join(broadcast_if_small(ids), "key", "left_semi"), "candidate-texts")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, recent = Shingler(width), {}

        def shingles(k: int, content: str) -> tuple[np.ndarray, np.ndarray]:
            found = recent.get(k)
            if found is None:
                if len(recent) >= _RECENT:
                    recent.clear()
                found = recent[k] = shingler.weighted(words_of(content))
            return found

        for batch in batches:
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": [
                weighted_jaccard(shingles(a, x), shingles(b, y))
                for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True)]})

    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
    compared = both.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long, similarity double")
    return compared.where(F.col("similarity") >= threshold)


def _near_weight(threshold: float, x: str, y: str):
    """Weights so different rule the similarity out."""
    return F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9


def _star(members: DataFrame, threshold: float, central: bool) -> DataFrame:
    """Pairs of each bucket's members with its pivot: the one with the greatest ``degree``, or the bucket's own hash picks.

    Members of the pivot's class are left out: their link would join nothing.
    """
    first = [-F.col("degree")] if central else []
    pivots = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*first, F.xxhash64("bucket", "key"), "key", "weight", "root")).alias("p")
    ).where(F.col("n") > 1).select(
        "bucket", F.col("p.key").alias("pivot"), F.col("p.weight").alias("pivot_weight"), F.col("p.root").alias("pivot_root"))
    return (
        members.join(pivots, "bucket").where((F.col("root") != F.col("pivot_root")) & _near_weight(threshold, "weight", "pivot_weight"))
        .select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
    )


def _fronts(keys: DataFrame, docs: DataFrame, threshold: float, width: int, key: str, text: str) -> DataFrame:
    """``key``, ``weight``, ``token`` and ``at`` of each text's first shingles, in an order that all texts share.

    The order is by a sketch of how many texts have a shingle, then by hash. A
    shingle that occurs ``n`` times is ``n`` tokens, so weighted Jaccard is that of
    token sets. Two texts of ``threshold`` share a token among the first
    w - ceil(threshold * w) + 1 of each. Tokens of one text alone may be missing.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = texts.join(broadcast_if_small(keys), "key", "left_semi")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [(k, *shingler.weighted(words_of(content))) for k, content in zip(batch["key"], batch["text"], strict=True)]
            rows = [(k, values.view(np.int64), counts.astype(np.int64)) for k, values, counts in sets if len(values)]
            yield pd.DataFrame(rows, columns=["key", "values", "counts"])

    sets = store_table(texts.select("key", "text").mapInPandas(shingled, "key long, values array<long>, counts array<long>"), "shingles")
    cells = sets.select(F.explode("values").alias("v")).groupBy(F.col("v").bitwiseAND(_SKETCH - 1).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    counted = cells.toPandas()  # at most _SKETCH rows
    sketch = np.zeros(_SKETCH, dtype=np.int64)
    sketch[counted["cell"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for batch in batches:
            rows = []
            for k, values, counts in zip(batch["key"], batch["values"], batch["counts"], strict=True):
                values, counts = np.asarray(values, dtype=np.int64), np.asarray(counts, dtype=np.int64)
                weight = int(counts.sum())
                most = weight - math.ceil(threshold * weight - 1e-9) + 1
                n = often[values & (_SKETCH - 1)]
                order = np.lexsort((values, n))
                values, counts, n = values[order], counts[order], n[order]
                last = np.cumsum(counts)
                end = int(np.searchsorted(last, most)) + 1
                values, counts, n, first = values[:end], counts[:end], n[:end], (last - counts)[:end]
                at = np.arange(min(most, weight))
                owner = np.repeat(np.arange(len(values)), counts)[: len(at)]
                tokens = mix(values.view(np.uint64)[owner] + mix((at - first[owner]).astype(np.uint64))).view(np.int64)
                met = n[owner] > 1
                rows.append((k, weight, tokens[met], at[met]))
            yield pd.DataFrame(rows, columns=["key", "weight", "tokens", "places"])

    found = sets.mapInPandas(front, "key long, weight long, tokens array<long>, places array<long>")
    return found.select("key", "weight", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(
        "key", "weight", F.col("t.tokens").alias("token"), F.col("t.places").alias("at"))


def _met(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` of groups that hold several roots, with the group's size ``n`` and its most frequent root ``main``."""
    groups = rows.groupBy(*group, "root").agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"))
    return rows.join(groups.where(F.col("roots") > 1).drop("roots"), group)


def _prefix_pairs(members: DataFrame, docs: DataFrame, threshold: float, width: int, key: str, text: str) -> DataFrame:
    """Pairs ``a``, ``b`` of ``members`` (``key``, ``root``) of different roots; none that reaches ``threshold`` is left out.

    Before the first token they share, two texts have nothing in common, so what
    follows it in the shorter rest bounds what they share; a pair is kept if that is enough
    for some token. Tokens of many texts are joined by the weight classes of
    both, so that texts meet only in classes where the bound allows it. Members
    of a token's most frequent root meet the others only, in salted blocks.
    """
    share = threshold / (1 + threshold)
    fronts = _fronts(members.select("key"), docs, threshold, width, key, text).join(members, "key")
    fronts = store_table(_met(store_table(fronts, "fronts"), ["token"]), "fronts-met")
    # A partner's least and greatest weight: of those, what follows the token has to hold share * (both weights).
    rest = F.col("weight") - F.col("at")
    least, most = threshold * F.col("weight") - 1e-6, F.least(F.col("weight") / threshold, rest / share - F.col("weight")) + 1e-6

    def step(w: Column) -> Column:
        return F.floor(F.log(w) / math.log(_STEP)).cast("int")

    fronts = fronts.where(most >= least)
    classed = fronts.where(F.col("n") > _HOT).drop("n", "main").withColumn("c", step(F.col("weight")))
    classed = classed.withColumn("d", F.explode(F.sequence(step(F.greatest(least, F.lit(1.0))), step(F.greatest(most, F.lit(1.0))))))
    classed = store_table(classed.select("key", "weight", "root", "token", "at", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")), "fronts-classed")
    few = fronts.where(F.col("n") <= _HOT).withColumns({"c": F.lit(-1), "d": F.lit(-1)})
    rows = store_table(few.unionByName(_met(classed, ["token", "c", "d"])), "fronts-met")
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    right = rows.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    left = rows.where(F.col("root") != F.col("main")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = left.select("token", "c", "d", "block", *[F.col(x).alias(f"{x}2") for x in ("key", "weight", "root", "at")])
    enough = F.least(rest, F.col("weight2") - F.col("at2")) >= share * (F.col("weight") + F.col("weight2")) - 1e-6
    once = (F.col("root") == F.col("main")) | (F.col("key") < F.col("key2"))
    return right.join(left, ["token", "c", "d", "block"]).where((F.col("root") != F.col("root2")) & once & enough).select(
        F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


KEY = "__key"


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a number ``__key`` for each pair of id and text.

    It is the id where the id has one text. Of several texts under one id the one
    with the smallest hash keeps the id; the others, and rows without an id, go by
    a hash of id and text with bit 62 set. Equal rows share a key. Texts are
    shuffled only if there are such rows.
    """
    own, made = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), (1 << 62) - 1
    ids = docs.select(F.col(key).cast("long").alias("__id"), own.alias("__own")).groupBy("__id").agg(
        F.min("__own").alias("__first"), F.max("__own").alias("__last"))
    mixed = store_table(ids.where(F.col("__id").isNull() | (F.col("__first") < F.col("__last"))).select("__id", "__first"), "mixed-ids")
    plain = F.col(key).cast("long")
    if mixed.isEmpty():
        return docs.withColumn(KEY, plain)
    surrogate = F.xxhash64(plain, own).bitwiseAND(F.lit(made)).bitwiseOR(F.lit(1 << 62))
    unchanged = plain.isNotNull() & (F.col("__first").isNull() | (F.col("__first") == own))
    marked = docs.join(mixed.where(F.col("__id").isNotNull()), plain == F.col("__id"), "left")
    return marked.withColumn(KEY, F.when(unchanged, plain).otherwise(surrogate)).drop("__id", "__first")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, darts: Darts | None = None,
    few: int = FEW, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id`` and ``links``.

    ``class_id`` is the smallest key of all documents connected by similarities of
    at least ``threshold``. Different texts that share an id, and rows without an
    id, are documents of their own, told apart by ``keyed``; elsewhere the key is
    the id. ``links`` counts the similarities that were found between the
    document's text and different texts while classes were joined. Null texts and
    texts without a word are alone in their class. An empty table gives no rows;
    other columns are not read. Two texts at the threshold itself miss each other
    in every band with probability (1 - 0.8^7)^32, five in ten thousand; at 0.85
    or more it is less than one in a hundred thousand.
    """
    known = keyed(docs.select(key, text), key, text)
    found = classes(known, threshold, width, darts, few, KEY, text).withColumnRenamed(KEY, "__found")
    ids = store_table(known.select(KEY, key), "ids")
    made = ids.where(F.col(KEY) >= F.lit(1 << 62)).distinct().withColumnRenamed(KEY, "__found")
    if made.isEmpty():
        return found.withColumnRenamed("__found", key)
    named = found.join(made, "__found", "left")
    return named.select(F.when(F.col("__found") < F.lit(1 << 62), F.col("__found")).otherwise(F.col(key)).alias(key), "class_id", "links")


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, darts: Darts | None = None,
    few: int = FEW, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The classes of ``near_duplicates`` for rows of which ``key`` names the text; null keys are left out."""
    darts = darts or Darts()
    signed = store_table(signatures(docs, darts, width, key, text), "signatures")
    first = signed.groupBy("content").agg(
        F.min(F.struct("key", "weight", "bands", "cells")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = store_table(
        first.select("content", "copies", F.col("r.key").alias("key"), F.col("r.weight").alias("weight"), F.col("r.bands").alias("bands"),
            F.col("r.cells").alias("cells")),
        "representatives")
    members = reps.select("key", "weight", F.col("key").alias("root"), F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = store_table(members.join(shared, "bucket"), "buckets")
    degrees = store_table(members.groupBy("key").agg(F.sum("n").alias("degree")), "degrees")
    members = members.drop("n")
    links = done = labels = None
    for central in (True, False):
        pairs = _star(members.join(degrees, "key") if central else members, threshold, central)
        pairs = store_table(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        links, done, labels = _add(pairs, links, done, labels, docs, threshold, width, key, text)
        members = store_table(
            members.drop("root").join(labels.select(F.col("node").alias("key"), "root"), "key", "left")
            .withColumn("root", F.coalesce("root", "key")),
            "placed")
    state = (
        members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("classes"))
        .where(F.col("classes") > 1)
        .select("bucket", F.col("most.root").alias("main"), (F.col("n") - F.col("most.n")).alias("outside"))
    )
    state = store_table(state, "unsettled")
    rest = members.join(state.where(F.col("outside") <= few), "bucket").select("bucket", "key", "weight", "root", "main")
    rest = store_table(rest.join(reps.select("key", "cells"), "key"), "unsettled-members")
    outside = rest.where(F.col("root") != F.col("main")).select("bucket", *[F.col(c).alias(f"{c}2") for c in ("key", "weight", "root", "cells")])
    apart = (
        rest.join(outside, "bucket").where(
            (F.col("root") != F.col("root2")) & _near_weight(threshold, "weight", "weight2")
            & ~cannot_reach(threshold, "weight", "cells", "weight2", "cells2"))
        .select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    )
    links, done, labels = _add(store_table(apart, "pairs"), links, done, labels, docs, threshold, width, key, text)
    large = members.join(state.where(F.col("outside") > few).select("bucket"), "bucket", "left_semi").select("key").distinct()
    large = store_table(large.join(labels.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "large")
    if not large.isEmpty():
        met = store_table(_prefix_pairs(large, docs, threshold, width, key, text).join(done, ["a", "b"], "left_anti"), "met")
        held = reps.select("key", "weight", "cells")
        met = (
            met.join(held.select(*[F.col(c).alias(n) for c, n in (("key", "a"), ("weight", "weight"), ("cells", "cells"))]), "a")
            .join(held.select(*[F.col(c).alias(n) for c, n in (("key", "b"), ("weight", "weight2"), ("cells", "cells2"))]), "b")
            .where(~cannot_reach(threshold, "weight", "cells", "weight2", "cells2")).select("a", "b").distinct()
        )
        links, done, labels = _add(store_table(met, "pairs"), links, done, labels, docs, threshold, width, key, text)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    placed = (
        reps.select("content", "copies", "key")
        .join(labels.select(F.col("node").alias("key"), "root"), "key", "left").join(degree, "key", "left")
        .select("content", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
        .where((F.col("copies") > 1) | (F.col("links") > 0))
    )
    ids = docs.select(F.col(key).cast("long").alias("key")).where(F.col("key").isNotNull())
    found = signed.select("key", "content").join(placed, "content", "left").select(
        "key", F.coalesce("root", "key").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    wordless = ids.join(signed.select("key"), "key", "left_anti").select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(wordless).withColumnRenamed("key", key)


def _add(pairs: DataFrame, links, done, labels, docs: DataFrame, threshold: float, width: int, key: str, text: str):
    """Compare new ``pairs``: all links, all compared pairs, and the labels of the classes so far."""
    if labels is not None and pairs.isEmpty():
        return links, done, labels
    fresh = store_table(similar(pairs, docs, threshold, width, key, text).select("a", "b"), "links")
    done = pairs if done is None else done.unionByName(pairs)
    if labels is not None and fresh.isEmpty():
        return links, done, labels
    links = fresh if links is None else links.unionByName(fresh)
    return links, done, components(links)
