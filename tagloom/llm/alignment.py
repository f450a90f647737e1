"""Alignment of two tokenizers' ids through the bytes at which their tokens end.

Every text is tokenised whole by both, A (byte-level BPE ranks) and B (a
SentencePiece model). Both kinds of tokens spell the same bytes without gaps, so
each byte at which a token ends, of A or B, ends exactly one overlap of a token
of A and one of B: a link. Where a token of each ends, a group is closed. Links
and groups of many texts are found together by running counts over marked bytes.
A text whose tokens of either kind do not spell a space and the text has no tokens.

``align`` writes one row per document with its distinct linked id pairs; one
aggregation counts the documents of every pair; ``with_counts`` then looks the
counts up in the row where the pairs, proven by a count, are few, and joins them
by pair where they are not. Both give the same rows.

Null and empty texts have no tokens; repeated rows are documents of their own;
texts of any length are aligned whole; other columns are kept if asked for.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import BATCH_ROWS, small_batches
from tagloom.llm.tokens import ByteBpe
from tagloom.session import store_table

MARK = "▁"
LOOKUP_PAIRS = 2_000_000
# Characters of the texts that are aligned in one go: enough that the fixed costs
# of a step vanish, and few enough that its arrays are small beside the batch.
PART_CHARS = 200_000
# Bytes for the digits of an id and what follows it.
CELL = 8
_NO_IDS = (np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint32))
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def piece_surface(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of every piece."""
    return [
        bytes([int(_BYTE_PIECE.fullmatch(model.id_to_piece(i)).group(1), 16)]) if model.is_byte(i)
        else model.id_to_piece(i).replace(MARK, " ").encode()
        for i in range(model.get_piece_size())
    ]


class PieceModel:
    """Ids of a SentencePiece model as little-endian 32-bit words."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface = piece_surface(self._model)

    def encode(self, text: str) -> bytes:
        return array("I", self._model.encode(text)).tobytes()


class Aligner:
    """Aligns texts, those of a list in one go."""

    def __init__(self, ranks_path: str, model_path: str):
        self._a = ByteBpe(ranks_path, special=())
        self._b = PieceModel(model_path)
        self._surface = self._a.surface(), self._b.surface
        self._size = [np.array([len(s) for s in side], dtype=np.int64) for side in self._surface]
        most = max(map(len, self._surface))
        if most > 10 ** (CELL - 1):
            raise ValueError(f"ids may have {CELL - 1} digits at most")
        self._cell = np.frombuffer(b"".join(str(i).encode().ljust(CELL, b"\0") for i in range(most)), dtype=np.uint64)
        self._bits = [len(side).bit_length() for side in self._surface]

    def _ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none if either's tokens do not spell a space and the text."""
        if not text:
            return _NO_IDS
        ids = tuple(np.frombuffer(c, dtype=np.uint32) for c in (self._a.encode(" " + text), self._b.encode(text)))
        whole = (" " + text).encode()
        if any(b"".join(map(side.__getitem__, i.tolist())) != whole for side, i in zip(self._surface, ids, strict=True)):
            return _NO_IDS
        return ids

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links and digest of the groups of every text; its distinct pairs and their times, and where they start.

        The texts are laid end to end, so an end of a text is a shared end.
        """
        ids = [self._ids(t) for t in texts]
        a, b = (np.concatenate([_NO_IDS[0], *side]).astype(np.int64) for side in ([i[k] for i in ids] for k in (0, 1)))
        n_a, n_b = (np.array([len(i[k]) for i in ids], dtype=np.int64) for k in (0, 1))
        ends = [np.cumsum(size[i]) for size, i in zip(self._size, (a, b), strict=True)]
        mark = np.zeros(ends[0][-1] if len(a) else 0, dtype=np.uint8)
        mark[ends[0] - 1] = 1
        mark[ends[1] - 1] |= 2
        # A link ends where a token does: 1 of A, 2 of B, 3 of both, which closes a group.
        kind = mark[mark != 0]
        at_a, at_b = (np.cumsum(closes, dtype=np.int64) - closes for closes in (kind & 1, kind >> 1))
        shared = np.flatnonzero(kind == 3)
        to_a, to_b = at_a[shared] + 1, at_b[shared] + 1
        n_groups = np.diff(np.searchsorted(to_a, np.cumsum(n_a), side="right"), prepend=0)
        n_links = n_a + n_b - n_groups

        bits_a, bits_b = self._bits
        key = np.repeat(np.arange(len(texts)), n_links) << bits_a
        key |= a[at_a]
        key <<= bits_b
        key |= b[at_b]
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(first, append=len(key))
        key = key[first]
        starts = np.searchsorted(key >> (bits_a + bits_b), np.arange(len(texts) + 1))
        pairs = ((key >> bits_b) & ((1 << bits_a) - 1)) << 32 | key & ((1 << bits_b) - 1)
        return n_a, n_b, n_groups, n_links, self._digests(a, b, to_a, to_b, n_a + n_b), pairs, times, starts

    def _digests(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, n: np.ndarray) -> list[str]:
        """Digests of the groups as text. A group ends after ``to_a`` and ``to_b`` tokens, a text after ``n`` more of both.

        Every id is written to a cell of its own, digits first and what follows
        them last; the empty bytes between are then left out.
        """
        in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        cells = np.empty(len(a) + len(b), dtype=np.uint64)
        cells[np.arange(len(a)) + np.repeat(to_b - in_b, in_a)] = self._cell[a]
        cells[np.arange(len(b)) + np.repeat(to_a, in_b)] = self._cell[b]
        follows = cells.view(np.uint8)[CELL - 1 :: CELL]
        follows[:] = ord(",")
        follows[to_a + to_b - in_b - 1] = ord("|")
        follows[to_a + to_b - 1] = ord(";")
        written, ends = cells.tobytes(), (CELL * np.cumsum(n)).tolist()
        return [hashlib.sha256(written[s : e - 1].translate(None, b"\0")).hexdigest() if s < e else "" for s, e in zip([0, *ends], ends, strict=False)]


def parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of ``PART_CHARS`` and ``BATCH_ROWS`` at most, or of one longer text."""
    start, chars = 0, 0
    for at, text in enumerate(texts):
        n = len(text or "")
        if at > start and (chars + n > PART_CHARS or at - start == BATCH_ROWS):
            yield texts[start:at]
            start, chars = at, 0
        chars += n
    if start < len(texts):
        yield texts[start:]


_ADDED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align(docs: DataFrame, ranks_path: str, model_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, counts, the digest of the groups, and the distinct linked pairs with their times.

    A pair is the id of A in the upper and that of B in the lower 32 bits.
    One narrow pass.
    """
    clash = {f.split()[0] for f in _ADDED.split(", ")} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    content = "__text" if text in keep else text
    wanted = docs.select(*keep, F.col(text).alias(content))
    schema = T.StructType([*[docs.schema[k] for k in keep], *T.StructType.fromDDL(_ADDED).fields])
    names = [f.name for f in schema.fields[len(keep):]]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ranks_path, model_path)
        for batch in batches:
            kept = pa.Table.from_batches([batch.select(keep)])
            start = 0
            for part in parts(batch.column(content).to_pylist()):
                *counts, digests, pairs, times, starts = aligner.align(part)
                lists = [pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(values)) for values in (pairs, times)]
                found = kept.slice(start, len(part))
                for name, column in zip(names, [*map(pa.array, counts), pa.array(digests, pa.string()), *lists], strict=True):
                    found = found.append_column(name, column)
                start += len(part)
                yield from found.to_batches()

    return wanted.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold the pair linked; whether none of its A id's pairs has more.

    Pairs combine map-side, so a pair that all documents hold costs a row a task.
    """
    counts = store_table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.join(most, a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """``aligned`` without its lists, with ``n_best`` and ``count_sum`` over its links.

    Both arguments should be stored tables. ``counts`` of at most ``lookup_pairs``
    rows is sent to the tasks as sorted arrays (17 bytes a pair); a larger one is
    joined with the exploded pairs, where Spark splits hot pairs.
    """
    keep = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.limit(lookup_pairs + 1).count() > lookup_pairs:
        return _joined(aligned, counts, keep)
    table = counts.toPandas().sort_values("pair")
    known = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "docs", "best")))

    @F.pandas_udf("n_best long, count_sum long")
    def look_up(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        pair, docs, best = known.value
        sizes = pairs.map(len).to_numpy()
        if not sizes.sum():
            return pd.DataFrame({"n_best": np.zeros(len(pairs), np.int64), "count_sum": np.zeros(len(pairs), np.int64)})
        at = np.searchsorted(pair, np.concatenate(pairs.to_numpy()))
        n = np.concatenate(times.to_numpy())
        sums = [np.concatenate(([0], np.cumsum(v))) for v in (n * best[at], n * docs[at])]
        ends = np.cumsum(sizes)
        return pd.DataFrame({name: s[ends] - s[ends - sizes] for name, s in zip(("n_best", "count_sum"), sums, strict=True)})

    return aligned.select(*keep, look_up("pairs", "times").alias("found")).select(*keep, "found.*")


def _joined(aligned: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    marked = store_table(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned-rows")
    links = marked.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("__row", "link.pairs", "link.times")
    sums = links.join(counts, F.col("pairs") == F.col("pair")).groupBy("__row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    added = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("n_best", "count_sum")]
    return marked.select("__row", *keep).join(sums, "__row", "left").select(*keep, *added)
