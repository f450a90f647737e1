"""Raw tables → merged table → label space → encoded table → splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators import cleaning, labels, merge, split
from tagloom.operators.cleaning import DataCheckError
from tagloom.session import broadcast_if_small, cut_lineage, scratch_path
from tagloom.sources import readers, writers


@dataclass(frozen=True)
class DatasetConfig:
    """Defaults of the preparation step."""

    category: str | None = "discharge summary"
    min_chars: int = cleaning.MIN_TEXT_CHARS
    policy: str = "concat"
    separator: str = merge.NOTE_SEPARATOR
    max_keys: int | None = None
    seed: int = 42
    top_k: int = 1000


def merged_table(notes: DataFrame, codes: DataFrame, config: DatasetConfig = DatasetConfig()) -> DataFrame:
    """Clean both tables, restrict them to sampled keys on request, merge."""
    columns = ["note_id", "subject_id", "hadm_id", "text"]
    clean = cleaning.clean_notes(notes, config.category, config.min_chars, columns)
    coded = cleaning.clean_codes(codes)
    if config.max_keys is not None:
        clean, coded = merge.intersect_sample_keys(clean, coded, config.max_keys, config.seed)
    return merge.merge_notes_labels(clean, merge.aggregate_labels(coded), config.policy, order=False)


def prepare_dataset(notes: DataFrame, codes: DataFrame, path: str, config: DatasetConfig = DatasetConfig()) -> DataFrame:
    """Merged table, checked and written as Parquet, CSV and JSON lines.

    All sinks and reports read the stored Parquet, so the merge runs once.
    """
    spark = notes.sparkSession
    merged = merged_table(notes, codes, config)
    part = ("part",) if "part" in merged.columns else ()
    writers.write_parquet(merged, f"{path}/merged.parquet", extra=part)
    stored = spark.read.parquet(f"{path}/merged.parquet")
    cleaning.check_invariants(stored, "hadm_id" if config.policy == "longest" else None)
    writers.write_csv_json_labels(stored.select(*part, *writers.MERGED), f"{path}/merged.csv")
    writers.write_jsonl(stored, f"{path}/merged.jsonl")
    labels.label_frequency(stored, config.top_k).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/label_frequency.csv")
    labels.dataset_report(stored).coalesce(1).write.mode("overwrite").json(f"{path}/report.json")
    return stored


def label_space(
    rows: DataFrame, k: int | None = None, target: float | None = None, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(label map, coverage curve) from the labels of ``rows``: fixed size or target coverage."""
    curve = cut_lineage(labels.coverage_curve(labels.train_label_frequency(rows)))
    if target is not None:
        chosen = labels.select_codes_target_coverage(curve, target, k)
    elif k is not None:
        chosen = labels.select_codes_fixed_k(curve, k)
    else:
        chosen = curve
    return cut_lineage(labels.build_label_map(chosen, strict)), curve


def prepare_split(spark: SparkSession, path: str, label_map: DataFrame) -> DataFrame:
    """One split file → subject_id, hadm_id, text, labels_idx."""
    return labels.encode_labels(readers.read_split(spark, path), label_map)


def write_splits(rows: DataFrame, assignment: DataFrame, path: str, key: str = "subject_id") -> DataFrame:
    """Rows with their split, one JSON-lines folder per split, and the sorted ids.

    The placed rows are stored once, a folder for each split, so that writing a
    split reads its own rows only, and a lost executor costs no second merge.
    Split names beyond train, val and test get a folder too; a null split is an error.
    """
    spark = rows.sparkSession
    stored = scratch_path(spark, "splits")
    assignment = cut_lineage(assignment)
    assigned = split.assign_splits(rows, broadcast_if_small(assignment), key)
    assigned.write.partitionBy("split").option("compression", "zstd").parquet(stored)
    placed = spark.read.schema(assigned.schema).parquet(stored)
    merge.check_disjoint(placed, ["subject_id", "hadm_id"] if key == "subject_id" else [key])
    found = {r["split"] for r in assignment.select("split").distinct().collect()}
    if None in found:
        raise DataCheckError("an id without a split")
    for name in [*labels.SPLITS, *sorted(found.difference(labels.SPLITS))]:
        writers.write_jsonl(placed.filter(placed["split"] == name), f"{path}/{name}.jsonl")
    writers.write_split_ids(assignment, f"{path}/ids", key)
    return placed
