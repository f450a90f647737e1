"""TF-IDF over word and character n-grams, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import text as fx
from tagloom.operators import grams
from tagloom.operators.rank import global_rank
from tagloom.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage, is_small, store_table

WORD, CHAR, NO_BLOCK = 0, 1, -1
# Character grams that a task may hold, about 30 bytes each; words take a string each.
CHAR_TERMS = 4_000_000
FORMAT_VERSION = 1


@dataclass(frozen=True)
class TfidfConfig:
    """Defaults of the vectorizers. A cap of None keeps every gram of ``min_df`` documents."""

    mode: str = "both"
    word_ngram: tuple[int, int] = (1, 2)
    char_ngram: tuple[int, int] = (3, 5)
    word_max_features: int | None = 50_000
    char_max_features: int | None = 30_000
    min_df: int | float = 2
    lowercase: bool = True
    strip_accents: bool = True
    sublinear_tf: bool = True

    def __post_init__(self):
        if self.mode not in {"word", "char", "both", "none"}:
            raise ValueError(f"unknown mode: {self.mode}")

    def blocks(self) -> dict[int, tuple[tuple[int, int], int | None]]:
        """block → (n-gram range, cap), word block first."""
        out = {}
        if self.mode in {"word", "both"}:
            out[WORD] = (tuple(self.word_ngram), self.word_max_features)
        if self.mode in {"char", "both"}:
            out[CHAR] = (tuple(self.char_ngram), self.char_max_features)
        return out


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary: (feature_id, block, term, df, n, idf), ids word block first."""

    config: TfidfConfig
    vocab: DataFrame = field(repr=False)
    n_docs: int = 0
    n_features: int = 0

    def transform(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        return transform_tfidf(self, df, key, text)


def _lower(text: Column, config: TfidfConfig) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.lower(text) if config.lowercase else text


def _strip(text: Column, config: TfidfConfig) -> Column:
    return fx.strip_accents(text) if config.strip_accents else text


def _gram_lists(df: DataFrame, blocks: dict, config: TfidfConfig, *keep: str) -> DataFrame:
    """keep, __g<block>: all grams of ``__text`` per block (row-local)."""
    folded = df.select(*keep, _strip(_lower(F.col("__text"), config), config).alias("__text"))
    stored = {}
    if WORD in blocks:
        stored["__words"] = fx.words(F.col("__text"))
    if CHAR in blocks:
        stored["__chars"] = fx.collapse_blanks(F.col("__text"))
    items = folded.select(*keep, *[c.alias(name) for name, c in stored.items()])
    if CHAR in blocks:
        items = items.withColumn("__wide", fx.wide_characters(F.col("__chars")))
    grams = {
        b: fx.ngrams("__words", *ngram, " ") if b == WORD else fx.char_ngrams("__chars", "__wide", *ngram)
        for b, (ngram, _) in blocks.items()
    }
    return items.select(*keep, *[g.alias(f"__g{b}") for b, g in grams.items()])


def _sources(df: DataFrame, blocks: dict, config: TfidfConfig, *keep: str) -> DataFrame:
    """keep, __s<block>: the words of ``__text`` parted by spaces, or the text, whose characters the tasks fold."""
    of = {WORD: lambda t: F.concat_ws(" ", fx.words(_strip(t, config))), CHAR: lambda t: t}
    lower = df.select(*keep, _lower(F.col("__text"), config).alias("__text"))
    return lower.select(*keep, *[of[b](F.col("__text")).alias(f"__s{b}") for b in blocks])


def _counted(batch: pa.RecordBatch, low: int, high: int, config: TfidfConfig) -> Iterator[tuple[int, grams.Counts]]:
    """(block, counts) of all grams in the rows from ``low`` to ``high`` of a batch."""
    for b, (ngram, _) in config.blocks().items():
        texts = batch.column(f"__s{b}").slice(low, high - low).to_pylist()
        if b == WORD:
            items = grams.Items.words(texts)
        else:
            items = grams.Items.characters(texts)
            items = (items.without_marks() if config.strip_accents else items).with_single_blanks()
        for counts in grams.counted(items, *ngram, " " if b == WORD else ""):
            yield b, counts


def _parts(batch: pa.RecordBatch, blocks: dict, most: int) -> Iterator[tuple[int, int]]:
    sizes = np.ones(batch.num_rows, dtype=np.int64)
    for b in blocks:
        sizes += pc.binary_length(batch.column(f"__s{b}")).to_numpy(zero_copy_only=False)
    return grams.parts(sizes, most)


def _summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Counts of several parts added up by term."""
    if len(held) < 2:
        return held
    table = pa.Table.from_batches(held).group_by(["block", "term"], use_threads=False).aggregate([("df", "sum"), ("n", "sum")])
    return table.select(["block", "term", "df_sum", "n_sum"]).rename_columns(["block", "term", "df", "n"]).to_batches()


def fit_tfidf(df: DataFrame, config: TfidfConfig = TfidfConfig(), text: str = "text") -> TfidfModel:
    """Document and term counts → vocabulary with idf, capped where the configuration has a cap.

    A task counts the grams of about a million characters at a time, adds up a
    million counts at a time and passes on one row per distinct gram of these,
    with its documents and occurrences; Spark adds these up by term. No shuffle on the document, and a gram found everywhere is
    summed map-side.
    """
    spark = df.sparkSession
    n_docs = df.count()
    if n_docs == 0:
        raise ValueError("cannot fit on an empty training set")
    blocks = config.blocks()
    if not blocks:
        return TfidfModel(config, spark.createDataFrame([], _VOCAB_SCHEMA), n_docs, 0)

    most = grams.BATCH_ITEMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for low, high in _parts(batch, blocks, most):
                for b, counts in _counted(batch, low, high, config):
                    times = np.append(0, np.cumsum(counts.times))[counts.firsts]
                    held.append(pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(counts.firsts) - 1, b, np.int32)), counts.strings(),
                         pa.array(np.diff(counts.firsts)), pa.array(np.diff(times))], ["block", "term", "df", "n"]))
                    rows += held[-1].num_rows
                if rows > most:
                    held = _summed(held)
                    rows = sum(x.num_rows for x in held)
                if rows > most // 2:
                    yield from held
                    held, rows = [], 0
        yield from _summed(held)

    partial = _sources(df.select(F.col(text).alias("__text")), blocks, config).mapInArrow(count, "block int, term string, df long, n long")
    counts = partial.groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    lowest = config.min_df * n_docs if isinstance(config.min_df, float) else config.min_df
    # Both caps read these counts, and so do the ranks: store them once.
    frequent = store_table(counts.filter(F.col("df") >= lowest), "terms")
    kept = None
    for block, (_, cap) in blocks.items():
        best = frequent.filter(F.col("block") == block)
        best = best if cap is None else best.orderBy(F.desc("n"), "term").limit(cap)
        kept = best if kept is None else kept.unionByName(best)
    ranked = global_rank(kept, [F.asc("block"), F.asc("term")])
    idf = F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1
    vocab = cut_lineage(ranked.select(
        (F.col("rank") - 1).cast("int").alias("feature_id"), "block", "term", "df", "n", idf.alias("idf")
    ))
    return TfidfModel(config, vocab, n_docs, vocab.count())


_VOCAB_SCHEMA = "feature_id int, block int, term string, df bigint, n bigint, idf double"


def transform_tfidf(model: TfidfModel, df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, feature_ids ARRAY<INT>, feature_values ARRAY<FLOAT>), L2 norm 1 per block.

    The text is shuffled and sorted once on the key; a task then counts the grams
    of about a million characters at a time and looks each distinct one up in the
    vocabulary, which it holds as sorted numbers. Texts of one key are counted together, and
    a key met in several batches passes on its counts, not its texts.
    """
    config, blocks, sublinear, most = model.config, model.config.blocks(), model.config.sublinear_tf, grams.BATCH_ITEMS
    terms = model.vocab.select("feature_id", "block", "term", "idf")
    if not is_small(terms, BROADCAST_ROWS if WORD in blocks else CHAR_TERMS):
        return _transform_joined(model, df, key, text)
    known = terms.toArrow()
    ids, block = (known.column(c).to_numpy().astype(np.int64) for c in ("feature_id", "block"))
    width = int(ids.max(initial=0)) + 1
    idf, of_block = np.zeros(width), np.zeros(width, dtype=np.int64)
    idf[ids], of_block[ids] = known.column("idf").to_numpy(), block
    lookups = {}
    for b in blocks:
        texts = known.column("term").filter(pa.array(block == b)).to_pylist()
        lookups[b] = grams.Lookup.of(grams.Items.words(texts) if b == WORD else grams.Items.characters(texts), ids[block == b])
    sent = df.sparkSession.sparkContext.broadcast((lookups, idf, of_block))
    first = F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1
    placed = df.select(key, F.col(text).alias("__text")).withColumn("__first", first)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups, idf, of_block = sent.value

        def packed(keys: pa.Array, doc: np.ndarray, ids: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            weight = (1 + np.log(times) if sublinear else times) * idf[ids]
            place = 2 * doc + (of_block[ids] if len(blocks) > 1 else 0)
            norm = np.sqrt(np.bincount(place, weight * weight, 2 * len(keys)))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(keys)))).astype(np.int32))
            values = (weight / norm[place]).astype(np.float32)
            return pa.RecordBatch.from_arrays(
                [keys, pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values))],
                [key, "feature_ids", "feature_values"])

        # The last key of a part stays open: the next part may go on with it.
        none = np.empty(0, dtype=np.int64)
        open_key, open_ids, open_times = None, none, none
        for batch in batches:
            fresh = batch.column("__first")
            for low, high in _parts(batch, blocks, most):
                new = fresh.slice(low, high - low)
                keys = batch.column(key).slice(low, high - low).filter(new)
                doc_of = np.cumsum(new.to_numpy(zero_copy_only=False)) - (open_key is None)
                keys = keys if open_key is None else pa.concat_arrays([open_key, keys])
                docs, ids, times = [np.zeros(len(open_ids), np.int64)], [open_ids], [open_times]
                for b, counts in _counted(batch, low, high, config):
                    found = np.repeat(lookups[b].find(counts), np.diff(counts.firsts))
                    held = np.flatnonzero(found >= 0)
                    docs.append(doc_of[counts.rows[held]])
                    ids.append(found[held])
                    times.append(counts.times[held])
                doc, ids, total = grams.added(docs, ids, times, len(idf))
                closed = int(np.searchsorted(doc, len(keys) - 1))
                if len(keys) > 1:
                    yield packed(keys[:-1], doc[:closed], ids[:closed], total[:closed])
                open_key, open_ids, open_times = keys[-1:], ids[closed:], total[closed:]
        if open_key is not None:
            yield packed(open_key, np.zeros(len(open_ids), np.int64), open_ids, open_times)

    schema = T.StructType([df.select(key).schema[0]]).add("feature_ids", T.ArrayType(T.IntegerType())).add("feature_values", T.ArrayType(T.FloatType()))
    return _sources(placed, blocks, config, key, "__first").mapInArrow(weigh, schema)


def _transform_joined(model: TfidfModel, df: DataFrame, key: str, text: str) -> DataFrame:
    """The same with a vocabulary beyond what a task may hold: grams meet it in a join."""
    config, blocks = model.config, model.config.blocks()
    placed = df.select(key, F.col(text).alias("__text")).repartition(key)
    grams = _gram_lists(placed, blocks, config, key)
    lists = [F.struct(F.lit(NO_BLOCK).alias("block"), F.array(F.lit("")).alias("grams"))] + [
        F.struct(F.lit(b).alias("block"), F.col(f"__g{b}").alias("grams")) for b in blocks
    ]
    flat = grams.select(key, F.explode(F.array(*lists)).alias("k")).select(key, "k.block", "k.grams")
    terms = flat.select(key, "block", F.explode("grams").alias("term"))
    marker = df.sparkSession.createDataFrame([(-1, NO_BLOCK, "", 0.0)], "feature_id int, block int, term string, idf double")
    known = broadcast_if_small(model.vocab.select("feature_id", "block", "term", "idf").unionByName(marker))
    counted = terms.join(known, ["block", "term"]).groupBy(key, "feature_id", "block", "idf").agg(F.count(F.lit(1)).alias("tf"))
    tf = 1 + F.ln("tf") if config.sublinear_tf else F.col("tf")
    weighted = counted.select(key, "feature_id", "block", (tf * F.col("idf")).alias("w"))
    # Norms are aggregates beside the list: a norm computed from the list would
    # be inlined into the lambda below and evaluated again for every entry.
    norm = lambda b: F.sqrt(F.sum(F.when(F.col("block") == b, F.col("w") * F.col("w"))))
    packed = weighted.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("feature_id", "block", "w"))).alias("__all"),
        norm(WORD).alias("__word_norm"), norm(CHAR).alias("__char_norm"),
    ).withColumn("__in", F.filter("__all", lambda e: e["feature_id"] >= 0))
    scaled = F.transform(
        "__in", lambda e: (e["w"] / F.when(e["block"] == WORD, F.col("__word_norm")).otherwise(F.col("__char_norm"))).cast("float")
    )
    return packed.select(key, F.transform("__in", lambda e: e["feature_id"]).alias("feature_ids"), scaled.alias("feature_values"))


def fit_transform_splits(
    splits: dict[str, DataFrame], key: str, config: TfidfConfig = TfidfConfig(), text: str = "text"
) -> tuple[TfidfModel, dict[str, DataFrame]]:
    """Fit on ``train`` only and transform every split to the same width."""
    model = fit_tfidf(splits["train"], config, text)
    return model, {name: model.transform(df, key, text) for name, df in splits.items()}


def long_features(features: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature_id, value), one row per non-zero."""
    # By place, not by zipped pairs: the lists are read where they are, without an object for each entry.
    flat = features.filter(F.col("feature_values").isNotNull()).select(*keys, "feature_values", F.posexplode("feature_ids").alias("__at", "feature_id"))
    return flat.select(*keys, "feature_id", F.get("feature_values", F.col("__at")).alias("value")).filter(F.col("feature_id").isNotNull())


def to_vectors(features: DataFrame, size: int, name: str = "features") -> DataFrame:
    """Add a sparse ML vector; built in the JVM through its JSON form."""
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("feature_ids").alias("indices"),
        F.transform("feature_values", lambda v: v.cast("double")).alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return features.withColumn(name, F.from_json(F.to_json(F.struct(sparse.alias("v"))), schema)["v"])


def save_features(model: TfidfModel, path: str) -> None:
    """Vocabulary as Parquet, parameters and version as one JSON row."""
    model.vocab.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vocab")
    spark = model.vocab.sparkSession
    row = {"version": FORMAT_VERSION, "n_docs": model.n_docs, "n_features": model.n_features, **asdict(model.config)}
    row["word_ngram"], row["char_ngram"] = list(row["word_ngram"]), list(row["char_ngram"])
    row["min_df_is_share"], row["min_df"] = isinstance(row["min_df"], float), float(row["min_df"])
    spark.createDataFrame([row], _PARAM_SCHEMA).write.mode("overwrite").json(f"{path}/params")


_PARAM_SCHEMA = (
    "version int, n_docs bigint, n_features bigint, mode string, word_ngram array<int>, char_ngram array<int>, "
    "word_max_features int, char_max_features int, min_df double, min_df_is_share boolean, lowercase boolean, "
    "strip_accents boolean, sublinear_tf boolean"
)


def load_features(spark: SparkSession, path: str) -> TfidfModel:
    row = spark.read.schema(_PARAM_SCHEMA).json(f"{path}/params").first().asDict()
    if row["version"] != FORMAT_VERSION:
        raise ValueError(f"unknown feature format: {row['version']}")
    config = TfidfConfig(
        mode=row["mode"], word_ngram=tuple(row["word_ngram"]), char_ngram=tuple(row["char_ngram"]),
        word_max_features=row["word_max_features"], char_max_features=row["char_max_features"],
        min_df=row["min_df"] if row["min_df_is_share"] else int(row["min_df"]), lowercase=row["lowercase"],
        strip_accents=row["strip_accents"], sublinear_tf=row["sublinear_tf"],
    )
    vocab = spark.read.schema(_VOCAB_SCHEMA).parquet(f"{path}/vocab")
    return TfidfModel(config, vocab, row["n_docs"], row["n_features"])
