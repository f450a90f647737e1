"""Vocabulary, token ids and overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as fx
from tagloom.operators.rank import global_rank
from tagloom.session import bounded_dict

# Vocabulary and chunk defaults.
VOCAB_MAX, VOCAB_MIN_FREQ, VOCAB_SMALLEST_MAX = 50_000, 2, 1000
PAD_ID, UNK_ID = 0, 1
MAX_LEN, OVERLAP = 512, 128


def tokenize(df: DataFrame, text: str = "text", name: str = "tokens", anonymize_numbers: bool = True) -> DataFrame:
    return df.withColumn(name, fx.tokenize(F.col(text), anonymize_numbers))


def token_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Occurrences per token; a token in every text is summed map-side first.

    The outer form keeps Spark from inferring a "list is not empty" filter,
    which it would push below the tokenizer and so tokenize three times.
    """
    flat = df.select(F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
    return flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, tokens: str = "tokens", max_size: int = VOCAB_MAX, min_freq: int = VOCAB_MIN_FREQ) -> DataFrame:
    """(token, id): specials first, then by (count desc, token), ``<NUM>`` last.

    At most ``max_size`` entries, so every later broadcast has a known bound.
    """
    if max_size < VOCAB_SMALLEST_MAX:
        raise ValueError(f"max_size must be at least {VOCAB_SMALLEST_MAX}")
    if min_freq < 1:
        raise ValueError("min_freq must be at least 1")
    specials = [fx.PAD, fx.UNK]
    room = max_size - len(specials) - 1
    kept = token_counts(df, tokens).filter(
        (F.col("n") >= min_freq) & ~F.col("token").isin(*specials, fx.NUM)
    )
    best = kept.orderBy(F.desc("n"), "token").limit(room)
    ranked = global_rank(best, [F.desc("n"), F.asc("token")])
    words = ranked.select("token", (F.col("rank") + len(specials) - 1).cast("int").alias("id"))
    n_words = F.coalesce(ranked.agg(F.max("rank")).scalar(), F.lit(0))
    ends = df.sparkSession.createDataFrame([(fx.PAD, PAD_ID), (fx.UNK, UNK_ID)], "token string, id int")
    number = ends.filter(F.col("id") == PAD_ID).select(
        F.lit(fx.NUM).alias("token"), (n_words + len(specials)).cast("int").alias("id")
    )
    return ends.unionByName(words).unionByName(number)


def _replaced(lists: pa.Array, known: pa.Array, by: pa.Array, other) -> pa.Array:
    """Lists whose items are replaced in Arrow columns: no Python object for an item."""
    found = pc.index_in(lists.flatten().cast(known.type), value_set=known)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pc.fill_null(by.take(found), other), mask=lists.is_null())


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, tokens: str = "tokens", max_len: int | None = None,
                  name: str = "ids") -> DataFrame:
    """(key, ids): unknown tokens get the unknown id, empty texts are one unknown.

    The clip comes first, so tokens past ``max_len`` are never looked up. The
    lookup stays inside the row: rows that share a key keep their own tokens.
    """
    index = bounded_dict(vocab, "token", "id")
    sent = df.sparkSession.sparkContext.broadcast((pa.array(index.keys(), pa.string()), pa.array(index.values(), pa.int32())))

    @F.arrow_udf("array<int>")
    def looked_up(lists: pa.Array) -> pa.Array:
        return _replaced(lists, *sent.value, UNK_ID)

    cut = F.slice(F.col(tokens), 1, max_len) if max_len is not None else F.col(tokens)
    filled = F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit(fx.UNK)))
    return df.select(key, looked_up(filled).alias(name))


def decode_tokens(df: DataFrame, vocab: DataFrame, ids: str = "ids", name: str = "tokens") -> DataFrame:
    """ids → tokens; an id the vocabulary lacks is the unknown token, null lists stay null.

    The vocabulary goes to each task once, not into the rows.
    """
    tokens = bounded_dict(vocab, "id", "token")
    sent = df.sparkSession.sparkContext.broadcast((pa.array(tokens.keys(), pa.int64()), pa.array(tokens.values(), pa.string())))

    @F.arrow_udf("array<string>")
    def named(lists: pa.Array) -> pa.Array:
        return _replaced(lists, *sent.value, fx.UNK)

    return df.withColumn(name, named(F.col(ids)))


def chunk_sequences(df: DataFrame, ids: str = "ids", max_len: int = MAX_LEN, overlap: int = OVERLAP, n_special: int = 0,
                    pad=PAD_ID) -> DataFrame:
    """Explode every sequence into chunks of ``max_len`` sharing ``overlap`` items.

    ``n_special`` slots per chunk are left for a caller's marker items, so the
    step is ``max_len - n_special - overlap``. The last chunk is padded, the
    mask tells content (1) from padding (0). Row-local.
    """
    width = max_len - n_special
    step = width - overlap
    if step < 1 or overlap < 0:
        raise ValueError("overlap must be smaller than the chunk content")
    n = F.size(ids)
    last = F.when(n > width, F.ceil((n - width) / F.lit(step)) * step).otherwise(F.lit(0)).cast("int")
    rest = [c for c in df.columns if c != ids]
    parts = df.select(*rest, F.posexplode(
        F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(ids, i + 1, width))
    ).alias("chunk_no", "__part"))
    return _padded(parts, "__part", width, pad, rest + ["chunk_no"])


def truncate_pad(df: DataFrame, ids: str = "ids", max_len: int = MAX_LEN, pad=PAD_ID) -> DataFrame:
    """One fixed-length sequence and mask per row. Row-local."""
    rest = [c for c in df.columns if c != ids]
    return _padded(df.select(*rest, F.slice(ids, 1, max_len).alias("__part")), "__part", max_len, pad, rest)


def _padded(df: DataFrame, part: str, width: int, pad, keep: list[str]) -> DataFrame:
    missing = F.lit(width) - F.size(part)
    return df.select(
        *keep,
        F.concat(part, F.array_repeat(F.lit(pad), missing)).alias("ids"),
        F.concat(F.transform(part, lambda _: F.lit(1)), F.array_repeat(F.lit(0), missing)).alias("mask"),
    )
