"""Deduplicate notes, group codes, join both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.hashing import seeded_key
from tagloom.operators.cleaning import require_rows
from tagloom.operators.rank import global_rank

NOTE_SEPARATOR = "\n\n"
# A concatenated text longer than this is kept in ordered parts (Spark cells
# end at 2 GiB); nothing is cut off.
MAX_CELL_CHARS = 1 << 28


def dedupe_keep_longest(df: DataFrame, key: str = "hadm_id", note: str = "note_id") -> DataFrame:
    """One row per admission: the longest text, ties to the smallest note id.

    ``max_by`` combines map-side, so a hot admission ships one row per map task,
    and the output is already partitioned on the join key. A choice per column
    lets Spark leave out the text where only the ids are read.
    """
    order = F.struct(F.length("text"), -F.col(note))
    best = [F.max_by(c, order).alias(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(*best).select(*df.columns)


def dedupe_concat(
    df: DataFrame, sep: str = NOTE_SEPARATOR, note: str = "note_id", max_cell_chars: int = MAX_CELL_CHARS
) -> DataFrame:
    """One text per (subject, admission), notes joined in note-id order.

    A group whose whole text would exceed ``max_cell_chars`` is kept as several
    rows: ``part`` 0, 1, ... in order, to be joined with ``sep``. Every other
    group is the single row ``part = 0``. Parts are cut by a running sum of
    lengths: a note belongs to the part in whose range it starts, so a part
    exceeds the limit by its last note at most. Only ids and lengths of the
    (few) oversized groups are ranked; only they meet the notes in the join.
    """
    keys = ["subject_id", "hadm_id"]
    width = F.length("text") + F.lit(len(sep))
    oversized = df.groupBy(*keys).agg(F.sum(width).alias("__chars")).filter(F.col("__chars") > max_cell_chars).select(*keys)
    if oversized.isEmpty():
        parts = df.withColumn("part", F.lit(0).cast("bigint"))
    else:
        sizes = df.select(*keys, note, width.alias("__width")).join(oversized, keys, "left_semi")
        placed = global_rank(sizes, [F.asc(c) for c in (*keys, note)], running={"__width": "__upto"})
        start = F.col("__upto") - F.col("__width")
        first = placed.groupBy(*keys).agg(F.min(start).alias("__first"))
        cut = placed.join(first, keys).select(*keys, note, F.floor((start - F.col("__first")) / max_cell_chars).alias("__raw"))
        numbered = cut.select(*keys, "__raw").distinct().withColumn(
            "part", F.row_number().over(Window.partitionBy(*keys).orderBy("__raw")).cast("bigint") - 1)
        of_note = cut.join(numbered, [*keys, "__raw"]).select(*keys, note, F.col("part"))
        parts = df.join(of_note, [*keys, note], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    return parts.groupBy(*keys, "part").agg(
        F.expr(f"listagg(text, '{_sql_text(sep)}') WITHIN GROUP (ORDER BY {note})").alias("text"),
        F.count(F.lit(1)).alias("n_notes"),
    )


def _sql_text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")


def aggregate_labels(codes: DataFrame, key: str = "hadm_id", code: str = "code") -> DataFrame:
    """Distinct sorted codes per admission.

    Pairs are made distinct first: that shuffle spreads a hot admission over
    its codes, and the list built afterwards is bounded by the code system.
    """
    return (
        codes.select(key, code).distinct().groupBy(key).agg(F.array_sort(F.collect_list(code)).alias("labels"))
    )


def merge_notes_labels(
    notes: DataFrame, labels: DataFrame, policy: str = "concat", order: bool = True, check: bool = False
) -> DataFrame:
    """Deduplicate by policy, inner-join on the admission, fixed column order.

    Of a text in several parts only part 0 carries the labels, so that every
    count of labels sees an admission once.
    """
    if policy == "longest":
        unique, extra = dedupe_keep_longest(notes), []
    elif policy == "concat":
        unique, extra = dedupe_concat(notes), ["part"]
    else:
        raise ValueError(f"unknown policy: {policy}")
    joined = unique.join(labels, "hadm_id")
    if extra:
        joined = joined.withColumn("labels", F.when(F.col("part") == 0, F.col("labels")).otherwise(F.array().cast("array<string>")))
    merged = joined.select("subject_id", "hadm_id", *extra, "text", "labels")
    if check:
        require_rows(merged, "notes joined with labels")
    return merged.orderBy("hadm_id", "subject_id", *extra) if order else merged


def code_counts(codes: DataFrame, key: str = "hadm_id", code: str = "code") -> DataFrame:
    """Codes per admission with multiplicity: ``array<struct<code,n>>``.

    The list is as long as the distinct codes; repeats are counted map-side.
    """
    pairs = codes.groupBy(key, code).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(code).alias("code"), "n"))).alias("code_counts"))


def expand_code_counts(df: DataFrame, column: str = "code_counts") -> DataFrame:
    """Turn counted codes into the plain list with repeats (row-local)."""
    repeated = F.flatten(F.transform(column, lambda e: F.array_repeat(e["code"], e["n"].cast("int"))))
    return df.withColumn("labels", repeated).drop(column)


def merge_raw(notes: DataFrame, codes: DataFrame) -> DataFrame:
    """Every note with its admission's codes, repeats kept (as counts)."""
    return notes.join(code_counts(codes), "hadm_id").select("subject_id", "hadm_id", "note_id", "text", "code_counts")


def sample_keys(df: DataFrame, column: str, n: int | None, seed) -> DataFrame:
    """Exactly min(n, total) distinct ids, seeded; n null or ≤ 0 keeps all."""
    keys = df.select(column).dropna().distinct()
    if n is None or n <= 0:
        return keys
    keyed = keys.withColumn("__key", seeded_key(seed, F.col(column)))
    ranked = global_rank(keyed, [F.asc("__key"), F.asc(column)], rank="__rank")
    return ranked.filter(F.col("__rank") <= n).select(column)


def semi_join(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in ``keys`` (AQE splits a hot key on the row side)."""
    return df.join(keys.select(column), column, "left_semi")


def intersect_sample_keys(
    notes: DataFrame, codes: DataFrame, max_keys: int | None, seed, key: str = "hadm_id", check: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Restrict both tables to (a seeded sample of) the keys they share."""
    shared = notes.select(key).dropna().intersect(codes.select(key).dropna())
    keys = sample_keys(shared, key, max_keys, seed)
    if check:
        require_rows(keys, "admissions present in both tables")
    return semi_join(notes, keys, key), semi_join(codes, keys, key)


def split_overlaps(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Ids found in more than one split, with the key they belong to."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("id")) for k in keys
    ])).alias("e"), split).select("e.key", "e.id", split)
    spread = long.groupBy("key", "id").agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
    return spread.filter("first_split <> last_split")


def check_disjoint(df: DataFrame, keys: list[str], split: str = "split") -> None:
    """Raise when splits share a subject or an admission."""
    leak = split_overlaps(df, keys, split).first()
    if leak is not None:
        raise ValueError(f"{leak['key']} {leak['id']} is in {leak['first_split']} and {leak['last_split']}")
