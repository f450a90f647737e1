"""Note and code tables derived from the benchmark tables, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import spread

CATEGORY = "en"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notes per admission; about five customers make one subject."""
    docs = documents(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    on = docs.select(
        F.col("doc_id").alias("note_id"), F.expr("doc_id DIV 2").alias("hadm_id"), F.col("lang").alias("category"), "text"
    )
    return on.join(orders, F.col("o_orderkey") == F.col("hadm_id")).select(
        "note_id", F.expr("o_custkey DIV 5").alias("subject_id"), "hadm_id", "category", "text"
    )


def codes(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """One code per line item; repeats within an admission are kept."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    code = F.concat("p_type", F.lit("."), "p_brand") if wide else F.col("p_brand")
    line = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
    return line.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("hadm_id"), code.alias("code")
    )


# --- The same tables, and the steps shared by many checks, as SQL ------------

WS = r"[\s\x1c-\x1f]"
CTES = {
    "notes": """SELECT d.doc_id AS note_id, o.o_custkey // 5 AS subject_id, d.doc_id // 2 AS hadm_id,
        d.lang AS category, d.text FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id // 2""",
    "codes": """SELECT l.l_orderkey AS hadm_id, p.p_brand AS code
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "codes_wide": """SELECT l.l_orderkey AS hadm_id, p.p_type || '.' || p.p_brand AS code
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "clean": rf"""SELECT note_id, subject_id, hadm_id, text FROM (
        SELECT note_id, subject_id, hadm_id,
            regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'),
                '^{WS}+|{WS}+$', '', 'g') AS text
        FROM notes) WHERE length(text) >= 50""",
    "clean_en": "SELECT c.* FROM clean c JOIN notes n USING (note_id) WHERE lower(trim(n.category)) = 'en'",
    "merged_en": """SELECT l.subject_id, l.hadm_id, l.text, g.labels FROM (
        SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY length(text) DESC, note_id) AS rn FROM clean_en) l
        JOIN grouped g USING (hadm_id) WHERE rn = 1""",
    "clean_codes": "SELECT hadm_id, upper(trim(code)) AS code FROM codes",
    "grouped": "SELECT hadm_id, list_sort(list(DISTINCT code)) AS labels FROM clean_codes GROUP BY hadm_id",
    "longest": """SELECT note_id, subject_id, hadm_id, text FROM (
        SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY length(text) DESC, note_id) AS rn FROM clean)
        WHERE rn = 1""",
    "merged": """SELECT l.subject_id, l.hadm_id, l.text, g.labels FROM longest l JOIN grouped g USING (hadm_id)""",
    "pairs": "SELECT subject_id, hadm_id, unnest(labels) AS code FROM merged",
    "freq": """SELECT code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, code) AS rnk
        FROM pairs GROUP BY code""",
    "label_map": "SELECT code, CAST(rnk - 1 AS INTEGER) AS idx FROM freq",
    "enc": """SELECT m.subject_id, m.hadm_id, coalesce(x.labels_idx, CAST([] AS INTEGER[])) AS labels_idx
        FROM merged m LEFT JOIN (SELECT hadm_id, list_sort(list(DISTINCT idx)) AS labels_idx
            FROM pairs JOIN label_map USING (code) GROUP BY hadm_id) x USING (hadm_id)""",
}


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` behind the named steps it mentions, directly or through others."""
    steps = {**CTES, **dict(extra)}
    order: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[A-Za-z_]\w*", text))
        for name in steps:
            if name in words and name not in order and steps[name] is not text:
                visit_step(name)

    def visit_step(name: str) -> None:
        if name in order or name in active:
            return
        active.add(name)
        visit(steps[name])
        order.append(name)

    active: set[str] = set()
    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({steps[name]})" for name in order) + "\n" + body
