"""Queries over ranks, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog import fixtures as fx
from tagloom.catalog import labels as base
from tagloom.catalog.fixtures import sql
from tagloom.functions.hashing import seeded_key
from tagloom.operators import labels, merge, split
from tagloom.operators.rank import global_rank
from tagloom.plans import dataset
from tagloom.session import cut_lineage, scratch_path, store_table
from tagloom.sources import readers

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


SEED = 42
_TV = "CAST(0.15 AS DOUBLE)"


def _allocated(source: str, keys: str) -> str:
    """Positions r (1-based, per trial) → split, as SQL."""
    return f"""SELECT {keys}, labels_idx, CASE WHEN floor(r * {_TV}) > floor((r - 1) * {_TV}) THEN 'test'
        WHEN floor(q * ({_TV} / (1 - {_TV}))) > floor((q - 1) * ({_TV} / (1 - {_TV}))) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, r - CAST(floor(r * {_TV}) AS BIGINT) AS q FROM {source})"""


UNITS = ("units", """SELECT subject_id, list_sort(list(DISTINCT i)) AS labels_idx
    FROM (SELECT subject_id, unnest(labels_idx) AS i FROM enc) GROUP BY subject_id""")
UCOUNT = ("ucount", "SELECT i AS idx, count(*) AS n FROM (SELECT unnest(labels_idx) AS i FROM units) GROUP BY i")
URARE = ("urare", """SELECT subject_id, n AS sn, idx AS si FROM (SELECT u.subject_id, c.n, c.idx,
    row_number() OVER (PARTITION BY u.subject_id ORDER BY c.n, c.idx) AS rn
    FROM (SELECT subject_id, unnest(labels_idx) AS idx FROM units) u JOIN ucount c USING (idx)) WHERE rn = 1""")
URANK = ("urank", f"""SELECT t.trial, u.subject_id, u.labels_idx, row_number() OVER (PARTITION BY t.trial
    ORDER BY coalesce(sn, -1), coalesce(si, -1), md5('{SEED}:' || t.trial || ':' || u.subject_id), u.subject_id) AS r
    FROM units u LEFT JOIN urare USING (subject_id), (SELECT unnest(range(0, 5)) AS trial) t""")
UALLOC = ("ualloc", _allocated("urank", "trial, subject_id"))
UJSD = ("ujsd", """SELECT trial, split, sum((p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) / 2) AS jsd FROM (
    SELECT trial, split, idx, CAST(a AS DOUBLE) / sum(a) OVER (PARTITION BY trial, split) AS p, CAST(b AS DOUBLE) / sum(b) OVER (PARTITION BY trial, split) AS q FROM (
        SELECT g.trial, s.split, g.idx, g.a, coalesce(c.b, 0) AS b FROM (SELECT trial, i AS idx, count(*) AS a FROM (SELECT trial, unnest(labels_idx) AS i FROM ualloc) GROUP BY ALL) g
        CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS split) s
        LEFT JOIN (SELECT trial, split, i AS idx, count(*) AS b FROM (SELECT trial, split, unnest(labels_idx) AS i FROM ualloc) GROUP BY ALL) c
            ON c.trial = g.trial AND c.split = s.split AND c.idx = g.idx)) GROUP BY ALL""")
SSPLIT = ("ssplit", """SELECT subject_id, split FROM ualloc WHERE trial = (SELECT trial FROM (SELECT trial, max(jsd) AS worst FROM ujsd GROUP BY trial)
    ORDER BY round(worst, 12), trial LIMIT 1)""")
SROWS = ("srows", "SELECT e.*, s.split FROM enc e JOIN ssplit s USING (subject_id)")
_STEPS = (UNITS, UCOUNT, URARE, URANK, UALLOC, UJSD, SSPLIT, SROWS)


def subject_split(spark, d, rows=None):
    return split.split_subject_stratified(rows if rows is not None else base.encoded(spark, d), SEED)


@query("global_rank", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents")
def q_global_rank(spark, d):
    ids = fx.table(spark, d, "documents").select("doc_id").withColumn("__key", seeded_key(SEED, F.col("doc_id")))
    return global_rank(ids, [F.asc("__key"), F.asc("doc_id")]).select("doc_id", "rank")


@query("sample_keys", sql("SELECT DISTINCT subject_id, md5('42:' || subject_id) AS k FROM notes ORDER BY k, subject_id LIMIT 50"))
def q_sample_keys(spark, d):
    keys = merge.sample_keys(fx.notes(spark, d), "subject_id", 50, SEED)
    return keys.select("subject_id", seeded_key(SEED, F.col("subject_id")).alias("k"))


@query("split_subject_random", sql("""SELECT subject_id, CASE WHEN r <= n - nv - nt THEN 'train' WHEN r <= n - nt THEN 'val' ELSE 'test' END AS split FROM (
    SELECT *, greatest(1, CAST(floor(CAST(0.15 AS DOUBLE) * n) AS BIGINT)) AS nv, greatest(1, CAST(floor(CAST(0.15 AS DOUBLE) * n) AS BIGINT)) AS nt FROM (
        SELECT subject_id, row_number() OVER (ORDER BY md5('42:' || subject_id), subject_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM merged)))"""))
def q_split_subject_random(spark, d):
    return split.split_subject_random(base.labelled(spark, d), SEED)


RCOUNT = ("rcount", "SELECT i AS idx, count(*) AS n FROM (SELECT unnest(labels_idx) AS i FROM enc) GROUP BY i")
RRANK = ("rrank", f"""SELECT hadm_id, labels_idx, row_number() OVER (ORDER BY coalesce(sn, -1), coalesce(si, -1), md5('{SEED}:0:' || hadm_id), hadm_id) AS r
    FROM enc LEFT JOIN (SELECT hadm_id, n AS sn, idx AS si FROM (SELECT e.hadm_id, c.n, c.idx, row_number() OVER (PARTITION BY e.hadm_id ORDER BY c.n, c.idx) AS rn
    FROM (SELECT hadm_id, unnest(labels_idx) AS idx FROM enc) e JOIN rcount c USING (idx)) WHERE rn = 1) USING (hadm_id)""")


@query("split_rows_stratified", sql("SELECT hadm_id, split FROM ralloc", RCOUNT, RRANK, ("ralloc", _allocated("rrank", "hadm_id"))))
def q_split_rows_stratified(spark, d):
    return split.split_rows_stratified(base.encoded(spark, d), SEED)


@query("split_subject_stratified", sql("SELECT subject_id, split FROM ssplit", *_STEPS))
def q_split_subject_stratified(spark, d):
    return subject_split(spark, d)


@query("split_trial_scores", sql("SELECT trial, round(max(jsd), 9) AS worst_jsd FROM ujsd GROUP BY trial", *_STEPS))
def q_split_trial_scores(spark, d):
    units = labels.subject_label_union(base.encoded(spark, d))
    scores = split.trial_scores(split.stratified_trials(units, "subject_id", SEED, 0.15, 0.15, split.TRIALS))
    return scores.select(F.col("trial").cast("bigint").alias("trial"), F.round("worst_jsd", 9).alias("worst_jsd"))


def _worst(assigned):
    return split.label_balance(assigned).agg(F.max(F.abs(F.col("n") - F.col("desired"))).alias("worst")).first()["worst"]


def _balance(units, key, quota, systematic):
    """Sizes of the quota split, and whether its worst label is nearer to its share than the systematic split's."""
    even = store_table(quota)
    better = F.lit(_worst(even) < _worst(units.join(systematic, key)))
    n, aim = F.col("n"), F.col("aim")
    sizes = even.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("units"))
    total = even.count()
    share = F.when(F.col("split") == "train", 0.7).otherwise(0.15)
    return sizes.withColumn("aim", share * total).select(
        "split", (n == F.col("units")).alias("once"), (F.abs(n - aim) <= F.greatest(F.lit(3.0), 0.03 * F.lit(total))).alias("near_size"), better.alias("better"))


_EVEN = "SELECT unnest(['train', 'val', 'test']) AS split, true AS once, true AS near_size, true AS better"


@query("split_rows_iterative", _EVEN)
def q_split_rows_iterative(spark, d):
    rows = store_table(base.encoded(spark, d)).select("hadm_id", "labels_idx")
    return _balance(rows, "hadm_id", split.quota_split(rows, "hadm_id", SEED), split.split_rows_stratified(rows, SEED))


@query("split_subject_iterative", _EVEN)
def q_split_subject_iterative(spark, d):
    units = store_table(labels.subject_label_union(base.encoded(spark, d)))
    return _balance(units, "subject_id", split.quota_split(units, "subject_id", SEED),
                    split.stratified_trials(units, "subject_id", SEED, 0.15, 0.15).select("subject_id", "split"))


def _split_rows(spark, d):
    rows = cut_lineage(base.encoded(spark, d))
    return split.assign_splits(rows, subject_split(spark, d, rows))


RJSD = ("rjsd", """SELECT split, sum((p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) / 2) AS jsd FROM (
    SELECT split, CAST(a AS DOUBLE) / sum(a) OVER (PARTITION BY split) AS p, CAST(b AS DOUBLE) / sum(b) OVER (PARTITION BY split) AS q FROM (
        SELECT s.split, g.idx, g.a, coalesce(c.b, 0) AS b FROM (SELECT i AS idx, count(*) AS a FROM (SELECT unnest(labels_idx) AS i FROM srows) GROUP BY i) g
        CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS split) s
        LEFT JOIN (SELECT split, i AS idx, count(*) AS b FROM (SELECT split, unnest(labels_idx) AS i FROM srows) GROUP BY ALL) c ON c.split = s.split AND c.idx = g.idx)) GROUP BY split""")


@query("split_manifest", sql("""SELECT split, n_rows, n_subjects, n_admissions, round(jsd, 9) AS jsd FROM (SELECT split, count(*) AS n_rows,
    count(DISTINCT subject_id) AS n_subjects, count(DISTINCT hadm_id) AS n_admissions FROM srows GROUP BY split) JOIN rjsd USING (split)""", *_STEPS, RJSD))
def q_split_manifest(spark, d):
    return labels.split_manifest(_split_rows(spark, d)).withColumn("jsd", F.round("jsd", 9))


@query("top_labels_preview", sql("""SELECT m.idx, m.code, count(r.idx) AS n_all, count_if(r.split = 'train') AS train, count_if(r.split = 'val') AS val,
    count_if(r.split = 'test') AS test FROM label_map m LEFT JOIN (SELECT split, unnest(labels_idx) AS idx FROM srows) r USING (idx)
    GROUP BY m.idx, m.code ORDER BY n_all DESC, m.idx LIMIT 20""", *_STEPS))
def q_top_labels_preview(spark, d):
    mapping = base.label_map(spark, d)
    rows = cut_lineage(base.encoded(spark, d, mapping))
    return labels.top_labels_preview(split.assign_splits(rows, subject_split(spark, d, rows)), mapping)


MINI_SIZES = {"train": 60, "val": 15, "test": 15}
_PICKS = " UNION ALL ".join(
    f"""(SELECT '{name}' AS split, subject_id FROM (SELECT DISTINCT subject_id FROM srows WHERE split = '{name}')
    ORDER BY md5('{SEED + i + 1}:' || subject_id), subject_id LIMIT {n})""" for i, (name, n) in enumerate(MINI_SIZES.items())
)
MINI = ("mini", "SELECT r.* FROM srows r WHERE r.subject_id IN (SELECT subject_id FROM picks)")
PICKS = ("picks", _PICKS)


def _labelled_splits(spark, d):
    mapping = base.label_map(spark, d)
    rows = base.rows_of(mapping)
    assignment = subject_split(spark, d, labels.encode_labels(rows, mapping))
    return cut_lineage(split.assign_splits(rows, assignment))


@query("make_mini_splits", sql("SELECT split, subject_id, hadm_id, len(labels_idx) AS n_labels FROM mini", *_STEPS, PICKS, MINI))
def q_make_mini_splits(spark, d):
    mini = split.make_mini_splits(_labelled_splits(spark, d), SEED, MINI_SIZES)
    return mini.select("split", "subject_id", "hadm_id", F.size("labels").cast("bigint").alias("n_labels"))


_PAIR = """SELECT x.split, sum((p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) / 2) AS jsd FROM (
    SELECT split, CAST(a AS DOUBLE) / sum(a) OVER (PARTITION BY split) AS p, CAST(b AS DOUBLE) / sum(b) OVER (PARTITION BY split) AS q FROM (
    SELECT split, idx, count(*) AS a, count_if(in_mini) AS b FROM (SELECT split, subject_id IN (SELECT subject_id FROM picks) AS in_mini,
        unnest(labels_idx) AS idx FROM srows) GROUP BY split, idx)) x GROUP BY x.split"""


@query("mini_divergence", sql("SELECT split, round(jsd, 9) AS jsd, jsd > CAST(0.15 AS DOUBLE) AS warn FROM pairjsd", *_STEPS, PICKS, ("pairjsd", _PAIR)))
def q_mini_divergence(spark, d):
    rows = _labelled_splits(spark, d)
    mini = split.make_mini_splits(rows, SEED, MINI_SIZES)
    return split.mini_divergence(rows, mini).withColumn("jsd", F.round("jsd", 9))


@query("mini_density", sql("""SELECT split, round(avg(len(labels_idx)), 9) AS mean_labels, CAST(median(len(labels_idx)) AS DOUBLE) AS median_labels
    FROM mini GROUP BY split""", *_STEPS, PICKS, MINI))
def q_mini_density(spark, d):
    mini = split.make_mini_splits(_labelled_splits(spark, d), SEED, MINI_SIZES)
    return labels.mini_density(mini, split="split").withColumn("mean_labels", F.round("mean_labels", 9))


@query("sample_examples", sql("SELECT subject_id, hadm_id FROM merged ORDER BY md5('42:' || hadm_id), hadm_id LIMIT 50"))
def q_sample_examples(spark, d):
    return split.sample_examples(base.labelled(spark, d), 50, SEED).select("subject_id", "hadm_id")


@query("write_splits", sql(f"""SELECT s.split, m.subject_id, m.hadm_id, md5(m.text) AS text_md5, {base.JOIN.format('labels')}
    FROM cmerged m JOIN ssplit s USING (subject_id)""", base.CONCAT, base.CMERGED, *_STEPS))
def q_write_splits(spark, d):
    """Merged texts written as one file a split and read back.

    Notes and codes are cleaned once, for the merge that is split and the one that is written.
    """
    path = scratch_path(spark, "written-splits")
    notes, coded = store_table(base.clean(spark, d), "clean-notes"), store_table(base.grouped(spark, d), "grouped-codes")
    longest = merge.merge_notes_labels(notes, coded, policy="longest", order=False)
    rows = store_table(longest.select("subject_id", "hadm_id", "labels"))
    mapping, _ = dataset.label_space(rows)
    assignment = subject_split(spark, d, labels.encode_labels(rows, mapping))
    dataset.write_splits(base.merged_concat(spark, d, notes, coded).drop("part"), assignment, path)
    parts = None
    for name in labels.SPLITS:
        rows = readers.read_split(spark, f"{path}/{name}.jsonl").select(
            F.lit(name).alias("split"), "subject_id", "hadm_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), base.joined("labels"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts
