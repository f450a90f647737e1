"""The registered queries of this package; ``ORACLES`` has the SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import alignment, centroids, fingerprints, langid, neardup, packing, pieces, quality, quotes, suffixes, tokens, toxicity, urls
from tagloom.llm.common import id_fold, table
from tagloom.session import store_table

QUERIES: dict = {}
ORACLES: dict = {}
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Totals for every context limit, by language."""
    counted = tokens.token_counts(table(spark, d, "documents"), BPE_RANKS, keep=["lang"])
    return tokens.length_histogram(counted, by=("lang",))


@query
def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    cut = store_table(packing.token_pieces(table(spark, d, "documents"), BPE_RANKS), "pieces")
    return packing.pack(cut)


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.where(id_fold("doc_id", 4) != 2))


@query
def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document, learned from three quarters of the ids."""
    docs = table(spark, d, "documents")
    found = langid.identify(docs, language_model(docs.select("doc_id", "text", "lang")), keep=["doc_id"])
    held_out = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), id_fold("doc_id", 3) != 1)


TOXIC_FROM = 0.7


@query
def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document and its offending sentences."""
    docs = table(spark, d, "documents")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, d, "labels")), keep=["doc_id"])
    held_out = F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "sentences", "offending")


URL_RULES = [
    urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"),
    urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/"),
]


@query
def op7_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(table(spark, d, "pages"), URL_RULES)


@query
def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Base counts of every document and the verdict of rules learned from quality labels."""
    counted = store_table(quality.statistics(table(spark, d, "documents"), ["doc_id"]), "quality-counts")
    labels = table(spark, d, "labels").where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return quality.decide(counted, quality.learn(counted.join(labels, "doc_id")))


@query
def op8_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    found = fingerprints.edited_fingerprints(table(spark, d, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op5_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return neardup.near_duplicates(table(spark, d, "documents"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query
def op4_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every document, and whether decoding them gives its text back."""
    found = pieces.round_trip(table(spark, d, "documents"), PIECES, keep=["doc_id"])
    return found.select("doc_id", F.size("ids").alias("n_ids"), "ids", "restored")


@query
def op2_quote_linking(spark: SparkSession, d: str) -> DataFrame:
    """All conversations, sent as messages that quote two turns back, whole or by a line, put together again."""
    return quotes.conversations(quotes.with_quotes(table(spark, d, "conversations")))


ORACLES["op2_quote_linking"] = r"""
WITH RECURSIVE b AS (SELECT m.*, CASE WHEN m.turn % 2 <> 0 THEN x.text ELSE string_split(x.text, chr(10))[1] END AS b1,
        CASE WHEN m.turn % 2 <> 0 THEN y.text ELSE string_split(y.text, chr(10))[1] END AS b2
    FROM conversations m LEFT JOIN conversations x ON x.conv_id = m.conv_id AND x.turn = m.turn - 1
    LEFT JOIN conversations y ON y.conv_id = m.conv_id AND y.turn = m.turn - 2),
sent AS (SELECT conv_id, turn, coalesce('>> ' || replace(b2, chr(10), chr(10) || '>> ') || chr(10), '') ||
        coalesce('> ' || replace(b1, chr(10), chr(10) || '> ') || chr(10), '') || text AS t FROM b),
lines AS (SELECT conv_id, turn, unnest(a) AS line, generate_subscripts(a, 1) AS pos
    FROM (SELECT conv_id, turn, regexp_split_to_array(t, '\r\n|\r|\n') AS a FROM sent)),
levels AS (SELECT conv_id, turn, pos, length(replace(replace(regexp_extract(line, '^(?:[ \t]*>)+'), ' ', ''), chr(9), '')) AS level,
    regexp_replace(line, '^(?:[ \t]*>)+ ?', '') AS body FROM lines),
runs AS (SELECT conv_id, turn, level, min(pos) AS pos, string_agg(body, chr(10) ORDER BY pos) AS body FROM (
        SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS island FROM levels)
    GROUP BY conv_id, turn, level, island HAVING trim(regexp_replace(string_agg(body, chr(10) ORDER BY pos), '\s+', ' ', 'g')) <> ''),
cut AS (SELECT conv_id, turn, level, pos, 0 AS grain, body FROM runs
    UNION ALL SELECT conv_id, turn, level, pos, 1, unnest(regexp_split_to_array(body, '\n(?:\s*\n)+')) FROM runs
    UNION ALL SELECT conv_id, turn, level, pos, 2, unnest(string_split(body, chr(10))) FROM runs),
unit AS (SELECT DISTINCT conv_id, turn, level, pos, grain, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS said FROM cut
    WHERE len(regexp_extract_all(body, '\S+')) >= CASE grain WHEN 2 THEN 3 ELSE 1 END),
link AS (SELECT q.conv_id, q.turn, q.level, q.pos, coalesce(max(o.turn) FILTER (q.grain = 0), max(o.turn) FILTER (q.grain = 1), max(o.turn)) AS source
    FROM unit q LEFT JOIN unit o ON o.level = 0 AND o.conv_id = q.conv_id AND o.said = q.said AND o.turn < q.turn
    WHERE q.level > 0 GROUP BY ALL),
parent AS (SELECT conv_id, turn, max(source) FILTER (level = 1) AS parent, count(*) AS quotes, count(source) AS linked FROM link GROUP BY ALL),
own AS (SELECT conv_id, turn, string_agg(regexp_replace(body, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY pos) AS text FROM runs WHERE level = 0 GROUP BY ALL),
tree AS (SELECT c.conv_id, c.turn, c.turn AS root, 0 AS depth FROM conversations c LEFT JOIN parent p USING (conv_id, turn) WHERE p.parent IS NULL
    UNION ALL SELECT p.conv_id, p.turn, t.root, t.depth + 1 FROM tree t JOIN parent p ON p.conv_id = t.conv_id AND p.parent = t.turn)
SELECT c.conv_id, c.turn, c.role, p.parent AS parent_turn, t.root AS root_turn, t.depth, coalesce(p.quotes, 0) AS quotes, coalesce(p.linked, 0) AS linked,
    CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY t.root, t.depth, c.turn) - 1 AS INTEGER) AS position, coalesce(o.text, '') AS text
FROM conversations c JOIN tree t USING (conv_id, turn) LEFT JOIN parent p USING (conv_id, turn) LEFT JOIN own o USING (conv_id, turn)"""


VECTOR_SIZE, CLUSTERS, ROUNDS = 64, 40, 5


@query
def op11_centroid_clustering(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of all whole vectors after five rounds."""
    vectors = store_table(centroids.integer_vectors(table(spark, d, "embeddings"), VECTOR_SIZE), "vectors")
    return centroids.with_inertia(centroids.cluster(vectors, CLUSTERS, ROUNDS))


ORACLES["op11_centroid_clustering"] = centroids.oracle_sql(CLUSTERS, ROUNDS, VECTOR_SIZE)


@query
def op12_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the passages of 50 bytes or more that an earlier one holds."""
    found = suffixes.remove_repeats(table(spark, d, "documents"), 50)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans")


@query
def op13_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Every document's tokens of two tokenizers linked by their bytes, and how common the links are."""
    aligned = store_table(alignment.align(table(spark, d, "documents"), BPE_RANKS, PIECES, ["doc_id"]), "aligned")
    return alignment.with_counts(aligned, store_table(alignment.pair_counts(aligned), "pair-counts"))
