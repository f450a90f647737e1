"""Language, toxicity, near duplicates, packing: documents to training sequences.

Each stage takes the documents its predecessor kept and returns those it keeps,
with the columns of ``documents``; the last returns the packed pieces. Models are
learned from the stage's own documents by the same folds as the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import langid, neardup, packing, queries, toxicity
from tagloom.llm.common import table
from tagloom.session import store_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a language found with at least ``LEAST_LANGUAGE_SCORE``.

    Null texts and texts without a letter are rejected.
    """
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, queries.language_model(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose toxicity score is below the limit of the query."""
    docs = docs.select(*COLUMNS)
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < queries.TOXIC_FROM).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that with the smallest key.

    Different texts under one id are documents of their own. Of rows with the same
    id and text the one that sorts first stays; rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    known = neardup.keyed(docs.where(F.col("doc_id").isNotNull()))
    found = neardup.classes(known, key=neardup.KEY)
    kept = store_table(found.where(F.col("class_id") == F.col(neardup.KEY)).select(neardup.KEY).distinct(), "kept-keys")
    first = known.join(kept, neardup.KEY, "left_semi").groupBy(neardup.KEY).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return first.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    pieces = store_table(packing.token_pieces(docs, queries.BPE_RANKS), "pieces")
    return packing.pack(pieces)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


# Learned models and tokens are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
