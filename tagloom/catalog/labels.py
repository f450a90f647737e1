"""Queries over merged tables, label space, encoding and label counts."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.catalog import fixtures as fx
from tagloom.catalog.fixtures import CATEGORY, sql
from tagloom.functions import cleaning as cfx
from tagloom.functions import paths as px
from tagloom.operators import cleaning, labels, merge
from tagloom.plans import dataset
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


# --- Shared inputs ------------------------------------------------------------


def clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_notes(fx.notes(spark, d), None)


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return merge.aggregate_labels(cleaning.clean_codes(fx.codes(spark, d)))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_notes_labels(clean(spark, d), grouped(spark, d), policy="longest", order=False)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Merged ids and labels without the text (Catalyst prunes the column)."""
    return merged(spark, d).select("subject_id", "hadm_id", "labels")


def frequency(spark: SparkSession, d: str) -> DataFrame:
    return labels.train_label_frequency(labelled(spark, d))


def curve(spark: SparkSession, d: str) -> DataFrame:
    return labels.coverage_curve(frequency(spark, d))


# The merged rows a label map was built from, for as long as the map lives: the
# merge over the texts runs once per query, not once per step.
_ROWS: WeakKeyDictionary = WeakKeyDictionary()


def label_map(spark: SparkSession, d: str, k: int | None = None, texts: bool = False) -> DataFrame:
    """Label map of the merged rows, with their texts on request; both are stored, since later steps read them again."""
    rows = store_table(merged(spark, d) if texts else labelled(spark, d))
    mapping, _ = dataset.label_space(rows, k)
    _ROWS[mapping] = rows
    return mapping


def rows_of(mapping: DataFrame) -> DataFrame:
    return _ROWS[mapping]


def encoded(spark: SparkSession, d: str, mapping: DataFrame | None = None) -> DataFrame:
    mapping = mapping if mapping is not None else label_map(spark, d)
    return labels.encode_labels(rows_of(mapping).select("subject_id", "hadm_id", "labels"), mapping)


def joined(col: str):
    return F.concat_ws(",", F.transform(col, lambda x: x.cast("string"))).alias(col)


JOIN = "array_to_string({0}, ',') AS {0}"


# --- Cleaning -----------------------------------------------------------------


@query("filter_category", sql("SELECT note_id, subject_id, hadm_id FROM notes WHERE lower(trim(category)) = 'en'"))
def q_filter_category(spark, d):
    return cleaning.filter_category(fx.notes(spark, d), " EN ").select("note_id", "subject_id", "hadm_id")


@query(
    "filter_category_exact",
    sql("SELECT note_id, length(text) AS n_chars FROM notes WHERE category = 'en' AND text IS NOT NULL"),
)
def q_filter_category_exact(spark, d):
    return cleaning.filter_category_exact(fx.notes(spark, d), CATEGORY).select("note_id", F.length("text").alias("n_chars"))


@query(
    "select_required",
    sql("SELECT subject_id, hadm_id, md5(text) AS text_md5 FROM notes WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL AND text IS NOT NULL"),
)
def q_select_required(spark, d):
    rows = cleaning.select_required(fx.notes(spark, d), ["subject_id", "hadm_id", "text"])
    return rows.select("subject_id", "hadm_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# Line feeds of the documents become CR LF, CR, tabs and double spaces first,
# so that every rule of the normaliser has work to do.
_ROUGH = """concat(chr(10), ' ', replace(replace(replace(text, chr(10), chr(13) || chr(10)), '. ', '.' || chr(9) || ' '), ', ', ',' || chr(13)), ' ', chr(9), chr(10))"""


@query(
    "normalize_text",
    sql(rf"""SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT doc_id,
        regexp_replace(regexp_replace(regexp_replace({_ROUGH}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'),
            '^{fx.WS}+|{fx.WS}+$', '', 'g') AS t FROM documents)"""),
)
def q_normalize_text(spark, d):
    rough = fx.table(spark, d, "documents").select("doc_id", F.expr(_ROUGH).alias("text"))
    return cleaning.normalize_text(rough).select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars")
    )


@query("drop_short", sql("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) >= 50"))
def q_drop_short(spark, d):
    rows = cleaning.drop_short(fx.table(spark, d, "documents"))
    return rows.select("doc_id", F.length("text").alias("n_chars"))


@query("enforce_types", "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels")
def q_enforce_types(spark, d):
    text_ids = fx.table(spark, d, "labels").select(
        F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("doc_id"), F.col("quality").cast("string").alias("quality")
    )
    return cleaning.enforce_types(text_ids, ["doc_id", "quality"])


@query(
    "normalize_code",
    "SELECT upper(trim(p_brand)) AS code, count(*) AS n FROM part GROUP BY 1",
)
def q_normalize_code(spark, d):
    raw = fx.table(spark, d, "part").select(F.concat(F.lit("\t "), F.lower("p_brand"), F.lit(" \n")).alias("code"))
    return cleaning.normalize_code(raw).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# Label cells in every text shape the cleaner accepts, one shape per part key.
_CELL = """CASE p_partkey % 6
    WHEN 0 THEN '["' || p_type || '.' || p_brand || '", " ' || lower(p_brand) || ' ", ""]'
    WHEN 1 THEN ' ' || p_type || ' ,' || lower(p_brand) || ',, '
    WHEN 2 THEN '[' || p_brand
    WHEN 3 THEN '   '
    WHEN 4 THEN NULL
    ELSE '[oops ' || p_brand || ']' END"""
_TOKENS = """CASE p_partkey % 6
    WHEN 0 THEN [p_type || '.' || p_brand, ' ' || lower(p_brand) || ' ', '']
    WHEN 1 THEN [' ' || p_type || ' ', lower(p_brand), '', ' ']
    WHEN 2 THEN ['[' || p_brand]
    WHEN 5 THEN ['[oops ' || p_brand || ']']
    ELSE CAST([] AS VARCHAR[]) END"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select("p_partkey", F.expr(_CELL).alias("cell"))


@query(
    "normalize_labels",
    f"""SELECT p_partkey, array_to_string(list_filter(list_transform({_TOKENS},
        lambda t: upper(replace(trim(t), '.', ''))), lambda t: t <> ''), '|') AS labels FROM part""",
)
def q_normalize_labels(spark, d):
    clean_cell = cfx.normalize_labels(F.col("cell"), remove_dots=True)
    return _cells(spark, d).select("p_partkey", F.concat_ws("|", clean_cell).alias("labels"))


@query(
    "labels_any_to_list",
    f"""SELECT p_partkey, CASE p_partkey % 6
        WHEN 0 THEN array_to_string({_TOKENS}, '|') WHEN 4 THEN '' ELSE {_CELL} END AS labels FROM part""",
)
def q_labels_any_to_list(spark, d):
    return _cells(spark, d).select("p_partkey", F.concat_ws("|", cfx.labels_any_to_list(F.col("cell"))).alias("labels"))


@query(
    "labels_to_json",
    f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN trim({_CELL}) WHEN 4 THEN '[]'
        ELSE '["' || trim({_CELL}) || '"]' END AS labels FROM part""",
)
def q_labels_to_json(spark, d):
    return _cells(spark, d).select("p_partkey", cfx.labels_to_json(F.col("cell")).alias("labels"))


_INDEX_CELL = """CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN NULL
    WHEN 2 THEN '[' || l_partkey || ', ' || l_suppkey || ']' ELSE ' [' || l_partkey || '] ' END"""


@query(
    "coerce_index_cell",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 2 THEN l_partkey || ',' || l_suppkey
        WHEN 3 THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS idx FROM lineitem""",
)
def q_coerce_index_cell(spark, d):
    cells = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_INDEX_CELL).alias("cell"))
    return cells.withColumn("idx", cfx.coerce_index_cell(F.col("cell"))).select("l_orderkey", "l_linenumber", joined("idx"))


_ROOT = "https://site0.example"


@query(
    "sanitize_path_columns",
    r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'data/' || page_id || '.html'
        WHEN page_id % 3 = 1 THEN 'raw/' || page_id || '.html' ELSE page_id || '.html' END AS file_path,
        '/srv/keep/' || page_id AS note FROM pages""",
)
def q_sanitize_path_columns(spark, d):
    raw = fx.table(spark, d, "pages").select(
        "page_id",
        F.expr("""CASE WHEN page_id % 3 = 0 THEN 'data/' || page_id || '.html'
            WHEN page_id % 3 = 1 THEN '/srv/project/raw/' || page_id || '.html'
            ELSE '/elsewhere/' || page_id || '.html' END""").alias("file_path"),
        F.expr("'/srv/keep/' || page_id").alias("note"),
    )
    return cleaning.sanitize_path_columns(raw, "/srv/project")


@query(
    "assert_no_absolute",
    """SELECT count_if(position('://' IN url) BETWEEN 1 AND 99 AND position(':/' IN url) <= 4) AS url_path, count(*) AS n_rows
        FROM pages""",
)
def q_assert_no_absolute(spark, d):
    pages = fx.table(spark, d, "pages").select(F.col("url").alias("url_path"))
    return cleaning.absolute_violations(pages).withColumn("n_rows", pages.agg(F.count(F.lit(1))).scalar())


@query(
    "sanitize_json_paths",
    "SELECT page_id, 'in/' || page_id AS inside, 'x' || page_id AS outside, 'plain' AS plain FROM pages",
)
def q_sanitize_json_paths(spark, d):
    nested = fx.table(spark, d, "pages").select(
        "page_id",
        F.struct(
            F.array(F.expr("'/srv/project/in/' || page_id"), F.expr("'/tmp/x' || page_id")).alias("paths"),
            F.struct(F.lit("plain").alias("plain")).alias("inner"),
        ).alias("meta"),
    )
    fixed = cleaning.sanitize_json_paths(nested, "meta", "/srv/project")
    return fixed.select(
        "page_id", F.col("meta.paths")[0].alias("inside"), F.col("meta.paths")[1].alias("outside"), F.col("meta.inner.plain").alias("plain")
    )


@query(
    "check_invariants",
    sql("""SELECT CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS empty_table,
        count_if(length(text) < 1) AS empty_texts, count_if(len(labels) < 1) AS empty_label_lists,
        (SELECT count(*) FROM (SELECT hadm_id FROM merged GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys FROM merged"""),
)
def q_check_invariants(spark, d):
    return cleaning.invariant_violations(merged(spark, d))


@query("read_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def q_read_limit(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    return cleaning.read_limit(docs, 25, [F.desc("n_chars"), F.asc("doc_id")])


# --- Joins and dedupe ---------------------------------------------------------


@query(
    "merge_notes_labels",
    sql(f"SELECT subject_id, hadm_id, md5(text) AS text_md5, {JOIN.format('labels')} FROM merged"),
)
def q_merge_notes_labels(spark, d):
    rows = merge.merge_notes_labels(clean(spark, d), grouped(spark, d), policy="longest")
    return rows.select("subject_id", "hadm_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), joined("labels"))


# The default policy: all notes of an admission, joined in order.
CONCAT = ("concat_notes", """SELECT subject_id, hadm_id, string_agg(text, chr(10) || chr(10) ORDER BY note_id) AS text, count(*) AS n_notes
    FROM clean GROUP BY subject_id, hadm_id""")
CMERGED = ("cmerged", "SELECT c.subject_id, c.hadm_id, c.text, g.labels FROM concat_notes c JOIN grouped g USING (hadm_id)")


def merged_concat(spark: SparkSession, d: str, notes: DataFrame | None = None, coded: DataFrame | None = None) -> DataFrame:
    """Notes of an admission joined in order; the cleaned notes are stored, since their lengths are read first."""
    notes = notes if notes is not None else store_table(clean(spark, d), "clean-notes")
    return merge.merge_notes_labels(notes, coded if coded is not None else grouped(spark, d), order=False)


@query(
    "merge_notes_labels_concat",
    sql(f"SELECT subject_id, hadm_id, CAST(0 AS BIGINT) AS part, md5(text) AS text_md5, {JOIN.format('labels')} FROM cmerged", CONCAT, CMERGED),
)
def q_merge_notes_labels_concat(spark, d):
    rows = merged_concat(spark, d)
    return rows.select("subject_id", "hadm_id", "part", F.md5(F.col("text").cast("binary")).alias("text_md5"), joined("labels"))


@query(
    "encode_labels_concat",
    sql("""SELECT m.subject_id, m.hadm_id, md5(m.text) AS text_md5, array_to_string(list_sort(list(x.idx)), ',') AS labels_idx
        FROM (SELECT subject_id, hadm_id, text, unnest(labels) AS code FROM cmerged) m JOIN (
            SELECT code, CAST(row_number() OVER (ORDER BY count(*) DESC, code) - 1 AS INTEGER) AS idx
            FROM (SELECT unnest(labels) AS code FROM cmerged) GROUP BY code) x USING (code) GROUP BY m.subject_id, m.hadm_id, m.text""", CONCAT, CMERGED),
)
def q_encode_labels_concat(spark, d):
    """Notes joined in order → labels → label map → encoded rows, texts included."""
    rows = store_table(merged_concat(spark, d), "merged-concat")
    mapping, _ = dataset.label_space(rows)
    coded = labels.encode_labels(rows, mapping)
    return coded.select("subject_id", "hadm_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), joined("labels_idx"))


@query(
    "merge_raw",
    sql("""SELECT n.note_id, n.subject_id, n.hadm_id, c.code_counts, c.n_codes FROM notes n JOIN (
        SELECT hadm_id, string_agg(code || ':' || k, ',' ORDER BY code) AS code_counts, CAST(sum(k) AS BIGINT) AS n_codes
        FROM (SELECT hadm_id, code, count(*) AS k FROM codes GROUP BY ALL) GROUP BY hadm_id) c USING (hadm_id)
        WHERE n.category = 'en' AND n.text IS NOT NULL"""),
)
def q_merge_raw(spark, d):
    notes = cleaning.filter_category_exact(fx.notes(spark, d), CATEGORY)
    rows = merge.merge_raw(notes, fx.codes(spark, d))
    return rows.select(
        "note_id", "subject_id", "hadm_id",
        F.concat_ws(",", F.transform("code_counts", lambda e: F.concat_ws(":", e["code"], e["n"].cast("string")))).alias("code_counts"),
        F.aggregate("code_counts", F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"]).alias("n_codes"),
    )


@query("dedupe_keep_longest", sql("SELECT note_id, subject_id, hadm_id, md5(text) AS text_md5 FROM longest"))
def q_dedupe_keep_longest(spark, d):
    rows = merge.dedupe_keep_longest(clean(spark, d))
    return rows.select("note_id", "subject_id", "hadm_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "dedupe_concat",
    sql("""SELECT subject_id, hadm_id, CAST(0 AS BIGINT) AS part, md5(string_agg(text, chr(10) || chr(10) ORDER BY note_id)) AS text_md5,
        count(*) AS n_notes FROM clean GROUP BY subject_id, hadm_id"""),
)
def q_dedupe_concat(spark, d):
    rows = merge.dedupe_concat(clean(spark, d))
    return rows.select("subject_id", "hadm_id", "part", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_notes")


@query("aggregate_labels", sql(f"SELECT hadm_id, {JOIN.format('labels')} FROM grouped"))
def q_aggregate_labels(spark, d):
    return grouped(spark, d).select("hadm_id", joined("labels"))


_SAMPLE = 40
_SHARED = f"""SELECT hadm_id FROM (SELECT hadm_id FROM clean INTERSECT SELECT hadm_id FROM clean_codes)
    ORDER BY md5('7:' || hadm_id), hadm_id LIMIT {_SAMPLE}"""


@query(
    "intersect_sample_keys",
    sql("""SELECT 'notes' AS side, hadm_id, count(*) AS n FROM clean WHERE hadm_id IN (SELECT hadm_id FROM shared) GROUP BY ALL
        UNION ALL SELECT 'codes', hadm_id, count(*) FROM clean_codes WHERE hadm_id IN (SELECT hadm_id FROM shared) GROUP BY ALL""",
        ("shared", _SHARED)),
)
def q_intersect_sample_keys(spark, d):
    notes, codes = merge.intersect_sample_keys(
        clean(spark, d).select("hadm_id"), cleaning.clean_codes(fx.codes(spark, d)), _SAMPLE, 7
    )
    per = [t.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "hadm_id", "n")
           for s, t in (("notes", notes), ("codes", codes))]
    return per[0].unionByName(per[1])


@query(
    "semi_join_subjects",
    sql("SELECT note_id, subject_id FROM notes WHERE subject_id IN (SELECT subject_id FROM merged)"),
)
def q_semi_join_subjects(spark, d):
    subjects = labelled(spark, d).select("subject_id").distinct()
    return merge.semi_join(fx.notes(spark, d), subjects, "subject_id").select("note_id", "subject_id")


@query(
    "check_disjoint",
    sql("""SELECT key, id, min(split) AS first_split, max(split) AS last_split FROM (
        SELECT 'subject_id' AS key, CAST(subject_id AS VARCHAR) AS id, category AS split FROM notes
        UNION ALL SELECT 'hadm_id', CAST(hadm_id AS VARCHAR), category FROM notes)
        GROUP BY key, id HAVING min(split) <> max(split)"""),
)
def q_check_disjoint(spark, d):
    return merge.split_overlaps(fx.notes(spark, d), ["subject_id", "hadm_id"], "category")


# --- Frequencies and label space ----------------------------------------------


@query(
    "label_frequency",
    sql("""SELECT code, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM pairs) AS DOUBLE), 9) AS pct
        FROM pairs GROUP BY code ORDER BY n DESC, code LIMIT 10"""),
)
def q_label_frequency(spark, d):
    return labels.label_frequency(labelled(spark, d), 10).withColumn("pct", F.round("pct", 9))


@query("train_label_frequency", sql("SELECT code, n FROM freq"))
def q_train_label_frequency(spark, d):
    return frequency(spark, d)


_CURVE = """SELECT code, n, rnk AS rank, CAST(sum(n) OVER (ORDER BY rnk) AS BIGINT) AS cum_n,
    sum(n) OVER (ORDER BY rnk) / CAST((SELECT sum(n) FROM freq) AS DOUBLE) AS coverage FROM freq"""


@query("coverage_curve", sql("SELECT code, n, rank, cum_n, round(coverage, 9) AS coverage FROM curve", ("curve", _CURVE)))
def q_coverage_curve(spark, d):
    return curve(spark, d).select("code", "n", "rank", "cum_n", F.round("coverage", 9).alias("coverage"))


@query(
    "select_codes_fixed_k",
    sql("SELECT code, rank, round(coverage, 9) AS coverage FROM curve WHERE rank <= 12", ("curve", _CURVE)),
)
def q_select_codes_fixed_k(spark, d):
    return labels.select_codes_fixed_k(curve(spark, d), 12).select("code", "rank", F.round("coverage", 9).alias("coverage"))


@query(
    "select_codes_target_coverage",
    sql("""SELECT code, rank, round(coverage, 9) AS coverage FROM curve WHERE rank <= (SELECT min(rank) FROM curve
        WHERE cum_n >= CAST(0.6 AS DOUBLE) * (SELECT sum(n) FROM freq))""", ("curve", _CURVE)),
)
def q_select_codes_target_coverage(spark, d):
    chosen = labels.select_codes_target_coverage(curve(spark, d), 0.6)
    return chosen.select("code", "rank", F.round("coverage", 9).alias("coverage"))


@query("build_label_map", sql("SELECT code, idx FROM label_map WHERE idx < 20"))
def q_build_label_map(spark, d):
    return labels.build_label_map(labels.select_codes_fixed_k(curve(spark, d), 20), strict=True)


@query(
    "coverage_grid",
    sql("""SELECT g.k, least(g.k, (SELECT max(rank) FROM curve)) AS k_used, round(c.coverage, 9) AS coverage
        FROM (SELECT CAST(unnest([5, 10, 12, 50, 100, 200, 400, 600, 800, 1000]) AS INTEGER) AS k) g
        JOIN curve c ON c.rank = least(g.k, (SELECT max(rank) FROM curve))""", ("curve", _CURVE)),
)
def q_coverage_grid(spark, d):
    grid = labels.coverage_grid(curve(spark, d), 12, [5, 10, *labels.COVERAGE_GRID])
    return grid.withColumn("coverage", F.round("coverage", 9))


# --- Encoding -----------------------------------------------------------------

_TOP = 15  # a label space smaller than the codes, so that some codes are unknown


def partial_map(spark: SparkSession, d: str) -> DataFrame:
    return label_map(spark, d, _TOP)


_PMAP = ("pmap", f"SELECT code, idx FROM label_map WHERE idx < {_TOP}")
_PENC = ("penc", """SELECT m.subject_id, m.hadm_id, coalesce(x.l, CAST([] AS INTEGER[])) AS labels_idx FROM merged m LEFT JOIN (
    SELECT hadm_id, list_sort(list(DISTINCT idx)) AS l FROM pairs JOIN pmap USING (code) GROUP BY hadm_id) x USING (hadm_id)""")


@query(
    "lookup_label_idx",
    sql("SELECT p.hadm_id, p.code, m.idx FROM pairs p LEFT JOIN pmap m USING (code)", _PMAP),
)
def q_lookup_label_idx(spark, d):
    mapping = partial_map(spark, d)
    return labels.lookup_label_idx(rows_of(mapping), mapping, "hadm_id")


@query("encode_labels", sql(f"SELECT subject_id, hadm_id, {JOIN.format('labels_idx')} FROM penc", _PMAP, _PENC))
def q_encode_labels(spark, d):
    return encoded(spark, d, partial_map(spark, d)).select("subject_id", "hadm_id", joined("labels_idx"))


@query("multi_hot", sql("SELECT hadm_id, unnest(labels_idx) AS idx FROM penc", _PMAP, _PENC))
def q_multi_hot(spark, d):
    return labels.multi_hot(encoded(spark, d, partial_map(spark, d)), _TOP)


@query(
    "multi_hot_dense",
    sql(f"""SELECT hadm_id, array_to_string(list_transform(range({_TOP}), lambda i: CASE WHEN list_contains(labels_idx, i)
        THEN 1 ELSE 0 END), '') AS y FROM penc""", _PMAP, _PENC),
)
def q_multi_hot_dense(spark, d):
    dense = labels.multi_hot_dense(encoded(spark, d, partial_map(spark, d)), _TOP)
    return dense.select("hadm_id", F.concat_ws("", F.transform("y", lambda v: v.cast("string"))).alias("y"))


@query(
    "encoding_stats",
    sql(f"""SELECT n AS n_rows, nnz, {_TOP} AS n_labels, round(nnz / CAST(n * {_TOP} AS DOUBLE), 9) AS density,
        round(nnz / CAST(n AS DOUBLE), 9) AS labels_per_row, unknown, round(unknown / CAST(nnz + unknown AS DOUBLE), 9) AS unknown_rate
        FROM (SELECT count(*) AS n, CAST(sum(len(labels_idx)) AS BIGINT) AS nnz,
            (SELECT count(*) FROM pairs WHERE code NOT IN (SELECT code FROM pmap)) AS unknown FROM penc)""", _PMAP, _PENC),
)
def q_encoding_stats(spark, d):
    mapping = partial_map(spark, d)
    rows = rows_of(mapping)
    looked = labels.lookup_label_idx(rows, mapping, "hadm_id")
    stats = labels.encoding_stats(labels.encode_labels(rows, mapping), looked, _TOP)
    return stats.withColumns({c: F.round(c, 9) for c in ("density", "labels_per_row", "unknown_rate")})


@query(
    "encoding_samples",
    sql(f"""SELECT rn AS position, subject_id, hadm_id, {JOIN.format('labels_idx')} FROM (
        SELECT *, row_number() OVER (ORDER BY hadm_id) AS rn, count(*) OVER () AS n FROM penc)
        WHERE rn IN (1, (n - 1) // 2 + 1, n)""", _PMAP, _PENC),
)
def q_encoding_samples(spark, d):
    rows = labels.encoding_samples(encoded(spark, d, partial_map(spark, d)))
    return rows.select("position", "subject_id", "hadm_id", joined("labels_idx"))


@query(
    "unknown_codes_top",
    sql("SELECT code, count(*) AS n FROM pairs WHERE code NOT IN (SELECT code FROM pmap) GROUP BY code ORDER BY n DESC, code LIMIT 50", _PMAP),
)
def q_unknown_codes_top(spark, d):
    mapping = partial_map(spark, d)
    return labels.unknown_codes_top(labels.lookup_label_idx(rows_of(mapping), mapping, "hadm_id"))


# --- Counts and reports -------------------------------------------------------


@query(
    "subject_label_union",
    sql(f"""SELECT subject_id, array_to_string(list_sort(list(DISTINCT i)), ',') AS labels_idx
        FROM (SELECT subject_id, unnest(labels_idx) AS i FROM enc) GROUP BY subject_id"""),
)
def q_subject_label_union(spark, d):
    return labels.subject_label_union(encoded(spark, d)).select("subject_id", joined("labels_idx"))


@query(
    "label_counts",
    sql("SELECT m.idx, count(p.code) AS n FROM label_map m LEFT JOIN pairs p USING (code) GROUP BY m.idx"),
)
def q_label_counts(spark, d):
    mapping = label_map(spark, d)
    return labels.label_counts(encoded(spark, d, mapping), mapping)


@query(
    "label_counts_by_code",
    """SELECT replace(code, '.', '') AS code, count(*) AS n FROM (SELECT DISTINCT l.l_orderkey, p.p_type || '.' || p.p_brand AS code
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey) GROUP BY 1""",
)
def q_label_counts_by_code(spark, d):
    wide = merge.aggregate_labels(fx.codes(spark, d, wide=True))
    return labels.label_counts_by_code(wide)


# Labels of the merged records against the labels of all coded admissions.
_SIDES = ("sides", """SELECT code, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT code, count(*) AS a FROM pairs GROUP BY code)
    FULL JOIN (SELECT code, count(*) AS b FROM (SELECT DISTINCT hadm_id, code FROM clean_codes) GROUP BY code) USING (code)""")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return labels.label_counts_by_code(labelled(spark, d)), labels.label_counts_by_code(grouped(spark, d))


@query("align_counts", sql("SELECT code, a AS n_a, b AS n_b FROM sides", _SIDES))
def q_align_counts(spark, d):
    return labels.align_counts(*_sides(spark, d))


@query(
    "js_divergence",
    sql("""SELECT round(sum((p * ln((p + 1e-12) / (m + 1e-12)) + q * ln((q + 1e-12) / (m + 1e-12))) / 2), 9) AS jsd FROM (
        SELECT p, q, (p + q) / 2 AS m FROM (SELECT CAST(a AS DOUBLE) / sum(a) OVER () AS p, CAST(b AS DOUBLE) / sum(b) OVER () AS q
        FROM sides))""", _SIDES),
)
def q_js_divergence(spark, d):
    return labels.js_divergence(labels.align_counts(*_sides(spark, d))).select(F.round("jsd", 9).alias("jsd"))


@query(
    "dataset_report",
    sql(r"""SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT hadm_id) AS n_admissions,
        round(avg(c), 6) AS mean_chars, CAST(median(c) AS DOUBLE) AS median_chars, round(avg(w), 6) AS mean_words,
        CAST(median(w) AS DOUBLE) AS median_words, CAST(min(k) AS INTEGER) AS min_labels, round(avg(k), 6) AS mean_labels,
        CAST(max(k) AS INTEGER) AS max_labels FROM (SELECT subject_id, hadm_id, length(text) AS c, len(labels) AS k,
            len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS w FROM merged)"""),
)
def q_dataset_report(spark, d):
    report = labels.dataset_report(merged(spark, d))
    return report.withColumns({c: F.round(c, 6) for c in ("mean_chars", "mean_words", "mean_labels")})


@query("category_counts", sql("SELECT category, count(*) AS n FROM notes WHERE category IS NOT NULL GROUP BY category"))
def q_category_counts(spark, d):
    return labels.category_counts(fx.notes(spark, d))


@query(
    "codes_per_admission",
    sql("""SELECT count(*) AS n_admissions, round(avg(n), 9) AS mean_codes, CAST(median(n) AS DOUBLE) AS median_codes,
        (SELECT count(DISTINCT code) FROM codes) AS n_codes FROM (SELECT hadm_id, count(code) AS n FROM codes GROUP BY hadm_id)"""),
)
def q_codes_per_admission(spark, d):
    return labels.codes_per_admission(fx.codes(spark, d)).withColumn("mean_codes", F.round("mean_codes", 9))


@query(
    "labels_per_note_hist",
    sql("""SELECT b.n_labels, coalesce(h.n, 0) AS n FROM (SELECT CAST(unnest(range(0, (SELECT max(len(labels_idx)) FROM enc) + 1)) AS INTEGER) AS n_labels) b
        LEFT JOIN (SELECT len(labels_idx) AS n_labels, count(*) AS n FROM enc GROUP BY 1) h USING (n_labels)"""),
)
def q_labels_per_note_hist(spark, d):
    return labels.labels_per_note_hist(encoded(spark, d))


@query(
    "longtail_curve",
    sql("SELECT idx, n, row_number() OVER (ORDER BY n DESC, idx) AS rank FROM label_map JOIN freq USING (code)"),
)
def q_longtail_curve(spark, d):
    mapping = label_map(spark, d)
    return labels.longtail_curve(labels.label_counts(encoded(spark, d, mapping), mapping))


@query(
    "longtail_stats",
    sql("""SELECT count(*) AS n_rows, 25 AS n_labels, round(sum(len(labels_idx)) / CAST(count(*) * 25 AS DOUBLE), 9) AS density FROM enc"""),
)
def q_longtail_stats(spark, d):
    return labels.longtail_stats(encoded(spark, d), 25).withColumn("density", F.round("density", 9))


@query(
    "pos_weight",
    sql("""SELECT m.idx, round(CAST(CAST(least(greatest(((SELECT count(*) FROM merged) - f.n) / CAST(greatest(f.n, 1) AS DOUBLE), 1.0), 12.0)
        AS FLOAT) AS DOUBLE), 5) AS pos_weight FROM label_map m JOIN freq f USING (code)"""),
)
def q_pos_weight(spark, d):
    mapping = label_map(spark, d)
    weights = labels.pos_weight(encoded(spark, d, mapping), mapping)
    return weights.select("idx", F.round(F.col("pos_weight").cast("double"), 5).alias("pos_weight"))
