"""Queries over tokens, vocabulary, token ids and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog import fixtures as fx
from tagloom.catalog.fixtures import sql
from tagloom.operators import text
from tagloom.session import cut_lineage, store_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# The documents hold no character NFKC would change, so the SQL may skip it.
_TOKENS = r"""list_transform(list_filter(list_transform(string_split_regex(regexp_replace(lower(text), '\p{C}', ' ', 'g'), '\s+'),
    lambda t: regexp_replace(t, '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g')), lambda t: regexp_matches(t, '[\p{L}\p{N}]')),
    lambda t: CASE WHEN regexp_matches(t, '\p{Nd}{2}') THEN '<NUM>' ELSE t END)"""
TOK = ("tok", f"SELECT doc_id, {_TOKENS} AS tokens FROM documents")
VOCAB = ("vocab", """SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tok) WHERE token <> '<NUM>' GROUP BY token HAVING count(*) >= 2
    ORDER BY n DESC, token LIMIT {room})
    UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1
    UNION ALL SELECT '<NUM>', CAST(2 + (SELECT least({room}, count(*)) FROM (SELECT token FROM (SELECT unnest(tokens) AS token FROM tok)
        WHERE token <> '<NUM>' GROUP BY token HAVING count(*) >= 2)) AS INTEGER)""".format(room=2997))
IDS = ("ids", """SELECT t.doc_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM (
    SELECT doc_id, unnest(CASE WHEN len(tokens) = 0 THEN ['<UNK>'] ELSE tokens END) AS token,
        generate_subscripts(CASE WHEN len(tokens) = 0 THEN ['<UNK>'] ELSE tokens END, 1) AS pos FROM tok) t
    LEFT JOIN vocab v USING (token) GROUP BY t.doc_id""")
VOCAB_SIZE = 3000
LEN, OVER, SPECIAL = 64, 16, 2


def tokens(spark, d):
    return text.tokenize(fx.documents(spark, d)).select("doc_id", "tokens")


def tokens_and_vocab(spark, d):
    """The vocabulary and the tokens it was built from: stored, so that texts are cut into tokens once."""
    rows = store_table(tokens(spark, d), "tokens")
    return rows, cut_lineage(text.build_vocab(rows, max_size=VOCAB_SIZE))


def _csv(col):
    return F.concat_ws(",", F.transform(col, lambda x: x.cast("string")))


def _digest(col):
    return F.md5(F.concat_ws(",", F.transform(col, lambda x: x.cast("string"))).cast("binary"))


@query("tokenize", sql("SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok", TOK))
def q_tokenize(spark, d):
    return tokens(spark, d).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.concat_ws(" ", "tokens").cast("binary")).alias("tokens_md5")
    )


@query("build_vocab", sql("SELECT token, id FROM vocab", TOK, VOCAB))
def q_build_vocab(spark, d):
    return text.build_vocab(tokens(spark, d), max_size=VOCAB_SIZE)


@query("encode_tokens", sql("SELECT doc_id, md5(array_to_string(ids, ',')) AS ids_md5, len(ids) AS n FROM ids", TOK, VOCAB, IDS))
def q_encode_tokens(spark, d):
    ids = text.encode_tokens(*tokens_and_vocab(spark, d), "doc_id")
    return ids.select("doc_id", _digest("ids").alias("ids_md5"), F.size("ids").cast("bigint").alias("n"))


@query("decode_tokens", sql("""SELECT doc_id, md5(string_agg(v.token, ' ' ORDER BY pos)) AS tokens_md5 FROM (
    SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM ids) JOIN vocab v USING (id) GROUP BY doc_id""", TOK, VOCAB, IDS))
def q_decode_tokens(spark, d):
    rows, words = tokens_and_vocab(spark, d)
    ids = text.encode_tokens(rows, words, "doc_id")
    return text.decode_tokens(ids, words).select("doc_id", F.md5(F.concat_ws(" ", "tokens").cast("binary")).alias("tokens_md5"))


_W = LEN - SPECIAL
_STEP = _W - OVER
CHUNKED = ("chunked", f"""SELECT doc_id, CAST(c AS INTEGER) AS chunk_no, list_slice(ids, c * {_STEP} + 1, c * {_STEP} + {_W}) AS part
    FROM (SELECT doc_id, ids, unnest(range(0, CAST(ceil(greatest(len(ids) - {_W}, 0) / CAST({_STEP} AS DOUBLE)) AS BIGINT) + 1)) AS c FROM ids)""")


@query("chunk_sequences", sql(f"""SELECT doc_id, chunk_no, md5(array_to_string(list_concat(part, list_resize(CAST([] AS INTEGER[]), {_W} - len(part), 0)), ',')) AS ids_md5,
    CAST(len(part) AS BIGINT) AS n_real FROM chunked""", TOK, VOCAB, IDS, CHUNKED))
def q_chunk_sequences(spark, d):
    ids = text.encode_tokens(*tokens_and_vocab(spark, d), "doc_id")
    chunks = text.chunk_sequences(ids, max_len=LEN, overlap=OVER, n_special=SPECIAL)
    real = F.aggregate("mask", F.lit(0).cast("bigint"), lambda acc, m: acc + m)
    return chunks.select("doc_id", "chunk_no", _digest("ids").alias("ids_md5"), real.alias("n_real"))


@query("truncate_pad", sql(f"""SELECT doc_id, md5(array_to_string(list_concat(part, list_resize(CAST([] AS INTEGER[]), {LEN} - len(part), 0)), ',')) AS ids_md5,
    repeat('1', len(part)) || repeat('0', {LEN} - len(part)) AS mask FROM (SELECT doc_id, list_slice(ids, 1, {LEN}) AS part FROM ids)""", TOK, VOCAB, IDS))
def q_truncate_pad(spark, d):
    ids = text.encode_tokens(*tokens_and_vocab(spark, d), "doc_id", max_len=LEN)
    rows = text.truncate_pad(ids, max_len=LEN)
    return rows.select("doc_id", _digest("ids").alias("ids_md5"), F.concat_ws("", F.transform("mask", lambda m: m.cast("string"))).alias("mask"))
