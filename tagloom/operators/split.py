"""Seeded, leakage-free train/val/test splits.

Order is ``md5(seed : id)``, so the same seed gives the same split on any
cluster and any partitioning. Stratified splits order units by stratum (their
rarest label) and allocate every position systematically. ``quota_split`` is
iterative stratification in rounds: it keeps count of what every label lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.hashing import seeded_key, unit_hash
from tagloom.operators.labels import align_counts, js_divergence, label_counts_by_code, split_divergence, subject_label_union
from tagloom.operators.merge import sample_keys, semi_join
from tagloom.operators.rank import global_rank
from tagloom.session import store_table

# Default fractions, trials, and sizes of the small splits.
VAL_FRACTION = 0.15
TEST_FRACTION = 0.15
TRIALS = 5
MINI_SIZES = {"train": 150, "val": 40, "test": 40}
MINI_WARN_JSD = 0.15
ROUNDS = 16


def _check_fractions(val_frac: float, test_frac: float) -> None:
    if not (0 < val_frac < 1 and 0 < test_frac < 1 and val_frac + test_frac < 1):
        raise ValueError("fractions must be positive and leave rows to train on")


def split_subject_random(
    df: DataFrame, seed, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION, subject: str = "subject_id"
) -> DataFrame:
    """(subject, split): shuffled subjects, train first, then val, then test."""
    _check_fractions(val_frac, test_frac)
    subjects = df.select(subject).dropna().distinct().withColumn("__key", seeded_key(seed, F.col(subject)))
    ranked = global_rank(subjects, [F.asc("__key"), F.asc(subject)], rank="__r", total="__n")
    n = F.col("__n")

    def size(frac: float) -> Column:
        floor = F.floor(F.lit(frac) * n)
        return F.when(n >= 3, F.greatest(F.lit(1), floor)).otherwise(floor)

    n_val, n_test = size(val_frac), size(test_frac)
    n_train = F.greatest(F.lit(0), n - n_val - n_test)
    split = F.when(F.col("__r") <= n_train, "train").when(F.col("__r") <= n_train + n_val, "val").otherwise("test")
    return ranked.select(subject, split.alias("split"))


def rarest_label(units: DataFrame, key: str) -> DataFrame:
    """key, labels_idx, stratum (rarest label, -1 without labels), its count."""
    cells = units.select(key, F.explode(F.array_distinct("labels_idx")).alias("idx"))
    counts = cells.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    rarest = cells.join(counts, "idx").groupBy(key).agg(F.min(F.struct("n", "idx")).alias("__rare"))
    return units.join(rarest, key, "left").select(
        key,
        "labels_idx",
        F.coalesce("__rare.n", F.lit(-1)).alias("stratum_n"),
        F.coalesce("__rare.idx", F.lit(-1)).alias("stratum"),
    )


def _allocate(position: Column, n: Column, val_frac: float, test_frac: float) -> Column:
    """Every position r of n: test when floor(r·t) steps up, val likewise on the rest.

    From three units on no split is empty: where a step never comes, the last
    unit is for the test and the one before it for validation.
    """

    def steps(r: Column, frac: float) -> Column:
        return F.floor(r * F.lit(frac)) > F.floor((r - 1) * F.lit(frac))

    share = val_frac / (1 - test_frac)
    rest = position - F.floor(position * F.lit(test_frac))
    no_test = (n >= 3) & F.lit(test_frac > 0) & (F.floor(n * F.lit(test_frac)) == 0)
    no_val = (n >= 3) & F.lit(val_frac > 0) & (F.floor((n - F.floor(n * F.lit(test_frac))) * F.lit(share)) == 0)
    return (
        F.when(steps(position, test_frac) | (no_test & (position == n)), "test")
        .when(steps(rest, share) | (no_val & (position == n - 1)), "val")
        .otherwise("train")
    )


def stratified_trials(
    units: DataFrame, key: str, seed, val_frac: float, test_frac: float, trials: int = 1
) -> DataFrame:
    """(trial, key, labels_idx, split) for every trial.

    One distributed rank over (trial, stratum, hash) serves all trials; a hot
    stratum is cut by the hash, since ranges are taken on the full order.
    """
    _check_fractions(val_frac, test_frac)
    strata = rarest_label(units, key)
    with_trial = strata.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    keyed = with_trial.withColumn("__key", seeded_key(seed, F.col("trial"), F.col(key)))
    order = [F.asc(c) for c in ("trial", "stratum_n", "stratum", "__key", key)]
    ranked = global_rank(keyed, order, rank="__r", total="__n")
    n = (F.col("__n") / trials).cast("bigint")
    position = F.col("__r") - F.col("trial") * n
    return ranked.select("trial", key, "labels_idx", _allocate(position, n, val_frac, test_frac).alias("split"))


def split_rows_stratified(
    encoded: DataFrame, seed, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION, key: str = "hadm_id"
) -> DataFrame:
    """(key, split) on row level, exact fractions, labels spread evenly."""
    return stratified_trials(encoded.select(key, "labels_idx"), key, seed, val_frac, test_frac).select(key, "split")


def quota_split(units: DataFrame, key: str, seed, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION) -> DataFrame:
    """(key, labels_idx, split): iterative stratification in rounds, rarest labels first.

    Every label has a desired count in each split. A unit belongs to its rarest
    label. A round takes the next labels by rarity, a ``ROUNDS``-th of them and
    counts within a factor of two at most, so there are at most ``ROUNDS`` and
    the binary digits of the largest count rounds, for any number of labels. A
    unit goes to the splits in the shares that its labels still lack, given what
    the rounds before have placed: one count of (label, split) a round. Within a
    label units are ordered by the rarest of their other labels, so that pairs of
    labels are spread alike, then by hash, from one distributed rank. Units
    without labels come last and even out the sizes. Labels are not negative.

    Labels, not units, come to the driver between rounds. Repeated keys are
    units of their own; null labels count as none. Stored when it returns.
    """
    _check_fractions(val_frac, test_frac)
    spark = units.sparkSession
    rows = units.select(key, F.array_distinct(F.coalesce("labels_idx", F.array().cast("array<int>"))).alias("labels_idx"))
    rows = store_table(rows.withColumn("__unit", F.monotonically_increasing_id()), "units")
    total = dict(rows.select(F.explode("labels_idx").alias("idx")).groupBy("idx").count().collect())
    counts = spark.createDataFrame([(i, n) for i, n in total.items()], "idx int, n long")
    cells = rows.select("__unit", F.explode("labels_idx").alias("idx")).join(F.broadcast(counts), "idx")
    rare = cells.groupBy("__unit").agg(F.min(F.struct("n", "idx")).alias("one"), F.sort_array(F.collect_list(F.struct("n", "idx"))).alias("all"))
    none = F.lit(-1)
    placed = rows.join(rare, "__unit", "left").select(
        "__unit", key, "labels_idx", F.coalesce("one.idx", none).alias("stratum"), F.coalesce("one.n", F.lit(0)).alias("__n"),
        F.coalesce(F.get("all", F.lit(1))["idx"], none).alias("__second"), seeded_key(seed, F.col(key)).alias("__key"))
    order = [F.asc(c) for c in ("stratum", "__second", "__key", "__unit")]
    ranked = store_table(global_rank(placed, order, rank="__r"), "strata")
    first = {r["stratum"]: r["low"] for r in ranked.groupBy("stratum").agg(F.min("__r").alias("low")).collect()}
    size, got, parts = rows.count(), {}, []
    ordered = sorted(total, key=lambda i: (total[i], i))
    width = max(1, -(-len(ordered) // ROUNDS))
    rounds: list[list[int]] = []
    for at, label in enumerate(ordered):
        if at % width and total[label].bit_length() == total[rounds[-1][0]].bit_length():
            rounds[-1].append(label)
        else:
            rounds.append([label])
    # The units without labels come under -1.
    for strata in [*rounds, [-1]]:
        known = [(label, first[label]) for label in strata if label in first]
        if not known:
            continue
        start = F.broadcast(spark.createDataFrame(known, "stratum int, __low long"))
        shares = _lacking(total, size, got, val_frac, test_frac)
        part = store_table(ranked.join(start, "stratum").select(key, "labels_idx", _by_share(seed, *shares).alias("split")), "placed")
        parts.append(part)
        seen = part.select(F.explode(F.concat("labels_idx", F.array(F.lit(-1)))).alias("idx"), "split").groupBy("idx", "split").count()
        for r in seen.collect():
            have = list(got.get(r["idx"], (0, 0, 0)))
            have[("train", "val", "test").index(r["split"])] += r["count"]
            got[r["idx"]] = tuple(have)
    out = parts[0] if parts else rows.select(key, "labels_idx", F.lit("train").alias("split")).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _lacking(total: dict, size: int, got: dict, val_frac: float, test_frac: float) -> tuple[str, str, str]:
    """SQL arrays by label, entry 0 for the units as a whole: weight, and what val and test lack of the units left."""
    entries = [(0.0, 0.0, 0.0)] * (max(total, default=-1) + 2)
    for label, n in [(-1, size), *total.items()]:
        have = got.get(label, (0, 0, 0))
        left = n - sum(have)
        if left > 0:
            lack = [min(1.0, max(0.0, f * n - h) / left) for f, h in zip((val_frac, test_frac), have[1:], strict=True)]
            entries[label + 1] = (1.0 / left, *lack)
    return tuple(f"array({', '.join(f'{e[at]!r}D' for e in entries)})" for at in range(3))


# Multiples of the golden ratio fall evenly into [0, 1), however few or many are taken.
_GOLDEN = 0.6180339887498949


def _by_share(seed, weight: str, val: str, test: str) -> Column:
    """Split by a unit's place in its stratum, in the shares that its labels lack.

    A label counts by the inverse of its units left: one that is nearly dealt out
    has little time to be evened out.
    """
    mine = "IF(size(labels_idx) = 0, array(0), transform(labels_idx, i -> i + 1))"
    share = [F.expr(f"aggregate({mine}, 0D, (s, i) -> s + {weight}[i] * {array}[i]) / aggregate({mine}, 0D, (s, i) -> s + {weight}[i])") for array in (val, test)]
    place = (F.col("__r") - F.col("__low")) * F.lit(_GOLDEN) + unit_hash(F.lit(str(seed)), F.col("stratum"))
    u = place - F.floor(place)
    return F.when(u < share[1], "test").when(u < share[0] + share[1], "val").otherwise("train")


def split_rows_iterative(
    encoded: DataFrame, seed, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION, key: str = "hadm_id"
) -> DataFrame:
    """(key, split) on row level by label quotas."""
    return quota_split(encoded.select(key, "labels_idx"), key, seed, val_frac, test_frac).select(key, "split")


def split_subject_iterative(
    encoded: DataFrame, seed, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION, subject: str = "subject_id"
) -> DataFrame:
    """(subject, split) by quotas of the labels found with each subject."""
    units = subject_label_union(encoded, subject=subject)
    return quota_split(units, subject, seed, val_frac, test_frac).select(subject, "split")


def label_balance(assigned: DataFrame, val_frac: float = VAL_FRACTION, test_frac: float = TEST_FRACTION) -> DataFrame:
    """(idx, split, n, desired): units of every label in every split, next to its share of the label's units."""
    names = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("train", "val", "test"))), F.array(*map(F.lit, (1 - val_frac - test_frac, val_frac, test_frac)))))
    cells = assigned.select("split", F.explode(F.array_distinct("labels_idx")).alias("idx")).groupBy("idx", "split").agg(F.count(F.lit(1)).alias("n"))
    every = cells.groupBy("idx").agg(F.sum("n").alias("all")).select("idx", "all", names.alias("split", "share"))
    return every.join(cells, ["idx", "split"], "left").select(
        "idx", "split", F.coalesce("n", F.lit(0)).alias("n"), (F.col("all") * F.col("share")).alias("desired"))


def split_subject_stratified(
    encoded: DataFrame,
    seed,
    val_frac: float = VAL_FRACTION,
    test_frac: float = TEST_FRACTION,
    trials: int = TRIALS,
    subject: str = "subject_id",
) -> DataFrame:
    """(subject, split) of the trial whose worst split is closest to the whole."""
    units = subject_label_union(encoded, subject=subject)
    # The assignments feed both the choice of the trial and the result.
    assigned = store_table(stratified_trials(units, subject, seed, val_frac, test_frac, trials))
    return assigned.filter(F.col("trial") == best_trial(trial_scores(assigned))).select(subject, "split")


def trial_scores(assigned: DataFrame) -> DataFrame:
    """Largest divergence of any split, per trial."""
    return split_divergence(assigned, group=("trial",)).groupBy("trial").agg(F.max("jsd").alias("worst_jsd"))


def best_trial(scores: DataFrame, digits: int = 12) -> Column:
    """Trial with the smallest worst divergence; the first one on ties."""
    return scores.agg(F.min_by("trial", F.struct(F.round("worst_jsd", digits), F.col("trial")))).scalar()


def assign_splits(rows: DataFrame, assignment: DataFrame, key: str = "subject_id") -> DataFrame:
    """All rows of the assigned units with their split."""
    return rows.join(assignment, key)


def mini_subjects(rows: DataFrame, seed: int, sizes: dict[str, int] | None = None, subject: str = "subject_id") -> DataFrame:
    """(split, subject): a seeded sample of subjects per split, seeds seed+1, +2, +3."""
    sizes = MINI_SIZES if sizes is None else sizes
    picked = None
    for i, (split, n) in enumerate(sizes.items()):
        one = sample_keys(rows.filter(F.col("split") == split), subject, n, seed + i + 1).select(F.lit(split).alias("split"), subject)
        picked = one if picked is None else picked.unionByName(one)
    return picked


def make_mini_splits(rows: DataFrame, seed: int, sizes: dict[str, int] | None = None, subject: str = "subject_id") -> DataFrame:
    """All rows of the sampled subjects."""
    return rows.join(mini_subjects(rows, seed, sizes, subject), ["split", subject], "left_semi")


def mini_divergence(rows: DataFrame, mini: DataFrame, warn_above: float = MINI_WARN_JSD) -> DataFrame:
    """JSD of each small split against its full split, with a warning flag."""
    out = None
    for split in MINI_SIZES:
        full = label_counts_by_code(rows.filter(F.col("split") == split))
        part = label_counts_by_code(mini.filter(F.col("split") == split))
        one = js_divergence(align_counts(full, part)).select(F.lit(split).alias("split"), "jsd")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("warn", F.col("jsd") > warn_above)


def sample_examples(df: DataFrame, n: int, seed, key: str = "hadm_id") -> DataFrame:
    """min(n, N) rows chosen by key."""
    return semi_join(df, sample_keys(df, key, n, seed), key)
