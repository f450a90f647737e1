"""Vector best-fit packing of token sequences.

Every sequence has three capacities: tokens, documents, and attention cost
(the sum of squared lengths). An item goes to the open sequence that fits it in
all three and scores best, by the norm of what would be left (``norm``) or by
the weighted dot product of item and residual (``dot``); if none fits, it opens
one. Items come in falling length.

Spark deals the items to packing groups of a bounded number of rows; each group
is packed on its own and leaves about one sequence partly filled, a share of
one in thousands. The number of groups grows with the items, the work and
memory of a group do not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import small_batches
from tagloom.llm.tokens import ByteBpe

# Items of one packing group; the mean of what the hash deals to it.
GROUP_ITEMS = 16_384


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: float = 2048.0 * 2048.0
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item of one group.

    Equal lengths keep their order and of equally good bins the oldest wins, so
    the result depends on the input order alone. An item beyond a capacity on
    its own raises.
    """
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    weights = np.asarray(capacity.weights, dtype=float)
    n = len(lengths)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    left = np.empty((3, max(n, 1)))  # share of each capacity that is left, by open bin in order of opening
    used, owner = np.zeros(max(n, 1), dtype=np.int64), np.empty(max(n, 1), dtype=np.int64)
    live, opened = 0, 0
    tiny = 1e-12
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        need = np.array([size, 1.0, float(size) * size]) / limits
        if (need > 1 + tiny).any():
            raise ValueError(f"an item of {size} tokens exceeds a capacity on its own")
        place = live
        if live:
            score, room = np.zeros(live), np.ones(live, dtype=bool)
            for space, part, weight in zip(left[:, :live], need, weights, strict=True):
                room &= space >= part - tiny
                score += -(space * part * weight) if capacity.rule == "dot" else weight * (space - part) ** 2
            score[~room] = np.inf
            best = int(np.argmin(score))
            if room[best]:
                place = best
        if place == live:
            left[:, place], used[place], owner[place] = 1.0, 0, opened
            live, opened = live + 1, opened + 1
        bins[at], offsets[at] = owner[place], used[place]
        left[:, place] -= need
        used[place] += size
        if (left[:, place] <= tiny).any():  # nothing else can enter
            for array in (*left, used, owner):
                array[place : live - 1] = array[place + 1 : live].copy()
            live -= 1
    return bins, offsets


def pack(items: DataFrame, length: str = "length", capacity: Capacity | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """All columns of ``items`` with ``sequence_id`` and ``offset``.

    ``items`` should be a stored table: it is counted once to size the groups.
    Items that fill a sequence by themselves take one each without any shuffle.
    Null lengths count as 0 tokens. Items of equal length are taken in the order of their plain columns. Repeated rows are separate items and are
    dealt apart by their place in the table, so no key can be hot. An empty
    table gives an empty result. Columns of ``items`` named ``sequence_id``,
    ``offset`` or ``__group`` raise.
    """
    capacity = capacity or Capacity()
    clash = {"sequence_id", "offset", "__group"} & set(items.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    groups = max(1, -(-items.count() // group_items))
    tokens = F.coalesce(F.col(length), F.lit(0)).cast("long")
    row = F.monotonically_increasing_id()
    alone = items.where(tokens >= capacity.tokens).select(
        "*", (-1 - row).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    order = [f.name for f in items.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ignore_index=True)  # rows arrive in no fixed order
        bins, offsets = best_fit(rows[length].fillna(0).to_numpy().astype(np.int64), capacity)
        return rows.drop(columns="__group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = items.withColumn("__group", F.pmod(F.xxhash64(row), F.lit(groups))).where(tokens < capacity.tokens)
    return dealt.groupBy("__group").applyInPandas(fit, schema).unionByName(alone)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, ranks_path: str, most: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``most`` tokens of each text followed by ``end_id``.

    Only documents beyond the limit are cut; the first piece takes the rest, so
    that all others are full. Null and empty texts are one piece of one token.
    A repeated row gives its pieces again. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe(ranks_path)
        for batch in batches:
            rows = []
            for key, content in zip(batch["doc_id"], batch["text"], strict=True):
                ids = bpe.encode(content) + end
                total = len(ids) // 4
                start, size = 0, total % most or min(total, most)
                for piece in range(-(-total // most)):
                    rows.append((key, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, size = start + size, most
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return wanted.mapInPandas(cut, PIECES)
