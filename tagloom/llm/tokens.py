"""Exact byte-level BPE ids and the exact histogram of encoded lengths.

Null and empty texts have no ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import small_batches
from tagloom.session import store_table

# Fixed value: the pre-token pattern of byte-level BPE vocabularies of 50,257 ids.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Fixed value: the added token of that vocabulary.
SPECIAL_TOKENS = (("<|endoftext|>", 50256),)

class ByteBpe:
    """Ids of whole texts as little-endian 32-bit words.

    ``ranks_path`` names the vocabulary as ranks (base64 bytes and id a line).
    ``special`` tokens are cut out of a text first and have their own ids, as in
    the tokenizers library; with none, their strings are ordinary text.
    """

    def __init__(self, ranks_path: str, special: tuple[tuple[str, int], ...] = SPECIAL_TOKENS):
        with open(ranks_path, "rb") as lines:
            self._ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=self._ranks, special_tokens={})
        self._special = {name: np.array([number], dtype="<u4") for name, number in special}
        self._cut = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True)))) if special else None

    def surface(self) -> list[bytes]:
        """The bytes of every id; ids that are no rank have none."""
        found = [b""] * (max(self._ranks.values()) + 1)
        for token, rank in self._ranks.items():
            found[rank] = token
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._cut is None or not self._cut.search(text):
            return self._bpe.encode_to_numpy(text).tobytes()
        found, start = [], 0
        for hit in self._cut.finditer(text):
            found += [self._bpe.encode_to_numpy(text[start : hit.start()]), self._special[hit.group()]]
            start = hit.end()
        return np.concatenate([*found, self._bpe.encode_to_numpy(text[start:])]).tobytes()


def token_counts(docs: DataFrame, ranks_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens``, the exact encoded length of ``text``.

    Null and empty texts count 0. One narrow pass, no shuffle; other columns of
    ``docs`` are not read, whatever their names.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = ByteBpe(ranks_path)
        for texts in batches:
            yield pd.Series([len(bpe.encode(t)) // 4 for t in texts], dtype="int64")

    counted = F.pandas_udf(count, "long")
    return docs.select(*keep, counted(F.col(text)).alias("n_tokens"))


# Width of the blocks in which suffix sums are taken; only the number of
# blocks, the longest text over this width, meets in one task.
BLOCK = 256


def length_histogram(lengths: DataFrame, length: str = "n_tokens", by: tuple[str, ...] = ()) -> DataFrame:
    """Answers for every context limit, from one histogram of lengths.

    One row per group of ``by`` and distinct length, taken as the limit:
    ``docs`` of exactly that length, ``docs_within`` and ``tokens_within`` up to
    and including it, ``docs_longer`` and ``tokens_longer`` beyond it,
    ``truncated_total`` (all tokens when every document is cut at the limit),
    ``total_docs``, ``total_tokens``, and ``quantile``, the share of documents
    within. Between two listed limits the counts stay and ``truncated_total``
    grows by ``docs_longer`` per token, so ``at_limit`` is exact everywhere.

    Null lengths are left out; an empty table gives no rows; a null group value
    is a group. Documents combine map-side into the histogram, so a hot group
    costs no more than its distinct lengths. Suffix sums run inside blocks of
    ``BLOCK`` lengths and then over block totals.
    """
    keys = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    names = [f"__by{i}" for i in range(len(by))]
    counts = (
        lengths.where(F.col(length).isNotNull())
        .select(*keys, F.col(length).cast("long").alias("__len"))
        .groupBy(*names, "__len").agg(F.count(F.lit(1)).alias("__docs"))
        .withColumn("__block", F.expr(f"__len div {BLOCK}"))
    )
    counts = store_table(counts, "length-histogram")
    blocks = counts.groupBy(*names, "__block").agg(
        F.sum("__docs").alias("__bd"), F.sum(F.col("__docs") * F.col("__len")).alias("__bt")
    )
    after = Window.partitionBy(*names).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names)
    blocks = blocks.select(
        *[F.col(n).alias(f"{n}_") for n in names], F.col("__block").alias("__block_"),
        F.coalesce(F.sum("__bd").over(after), F.lit(0)).alias("__ad"),
        F.coalesce(F.sum("__bt").over(after), F.lit(0)).alias("__at"),
        F.sum("__bd").over(whole).alias("__td"), F.sum("__bt").over(whole).alias("__tt"),
    )
    same = F.col("__block") == F.col("__block_")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    inside = Window.partitionBy(*names, "__block").orderBy(F.desc("__len")).rowsBetween(Window.unboundedPreceding, -1)
    longer = counts.withColumns({
        "__ld": F.coalesce(F.sum("__docs").over(inside), F.lit(0)),
        "__lt": F.coalesce(F.sum(F.col("__docs") * F.col("__len")).over(inside), F.lit(0)),
    }).join(blocks, same)
    docs_longer, tokens_longer = F.col("__ld") + F.col("__ad"), F.col("__lt") + F.col("__at")
    return longer.select(
        *[F.col(n).alias(c) for n, c in zip(names, by, strict=True)],
        F.col("__len").alias("context_limit"), F.col("__docs").alias("docs"),
        (F.col("__td") - docs_longer).alias("docs_within"), (F.col("__tt") - tokens_longer).alias("tokens_within"),
        docs_longer.alias("docs_longer"), tokens_longer.alias("tokens_longer"),
        (F.col("__tt") - tokens_longer + docs_longer * F.col("__len")).alias("truncated_total"),
        F.col("__td").alias("total_docs"), F.col("__tt").alias("total_tokens"),
        ((F.col("__td") - docs_longer) / F.col("__td")).alias("quantile"),
    )


def at_limit(histogram: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals with every document cut at ``limit`` tokens, one row per group.

    Reads off the last listed length not above the limit; below the shortest
    length every document is cut. Exact for any limit of 0 or more.
    """
    listed = F.max(F.when(F.col("context_limit") <= limit, F.struct(
        "context_limit", "docs_longer", "truncated_total"))).alias("at")
    grouped = histogram.groupBy(*by).agg(listed, F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"))
    cut = F.coalesce(F.col("at.docs_longer"), F.col("total_docs"))
    base = F.coalesce(F.col("at.truncated_total"), F.lit(0))
    at = F.coalesce(F.col("at.context_limit"), F.lit(0))
    return grouped.select(
        *by, F.lit(limit).cast("long").alias("context_limit"), cut.alias("docs_cut"),
        (base + cut * (F.lit(limit) - at)).alias("truncated_total"), "total_docs", "total_tokens",
    )


def length_quantiles(histogram: DataFrame, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """The smallest length that covers each share of the documents, per group."""
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return (
        histogram.select(*by, "context_limit", "quantile", share)
        .where(F.col("quantile") >= F.col("share"))
        .groupBy(*by, "share").agg(F.min("context_limit").alias("length"))
    )
