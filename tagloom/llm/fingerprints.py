"""Document fingerprints: bottom-k sketches of shingle hashes, native to Spark.

A sketch is the sorted array of the ``k`` smallest 64-bit hashes of the distinct
shingles of ``width`` lower-cased words; a text of fewer words is one shingle, a
text without words none. Sketches of parts merge into the sketch of the whole.
They estimate resemblance, containment and the number of distinct shingles, and
give all three exactly while no sketch is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import let
from tagloom.operators.rank import global_rank

K = 128
WIDTH = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a whole text; null and empty texts have an empty one."""

    def hashes(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[w[i + j] for j in range(width)])
        return (
            F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), at))
            .when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return F.slice(F.sort_array(F.array_distinct(let(words_of(text), hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One merged sketch per group of ``by``.

    Ranks stop at ``k`` on the map side already, so a hot group sends ``k``
    hashes from each task. Groups whose sketches are all empty or null get an
    empty sketch.
    """
    groups = sketches.select(*by).distinct()
    hashes = sketches.select(*by, F.explode(column).alias("__h")).groupBy(*by, "__h").agg(F.count(F.lit(1)).alias("__n"))
    least = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= k)
    merged = least.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias("__s"))
    on = [F.col(f"__g.{c}").eqNullSafe(F.col(f"__m.{c}")) for c in by]
    joined = groups.alias("__g").join(merged.alias("__m"), on, "left")
    return joined.select(*[F.col(f"__g.{c}").alias(c) for c in by], F.coalesce("__s", F.array().cast("array<bigint>")).alias(column))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike, an empty and another are not."""
    least = merge(a, b, k)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(least))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    j = resemblance(a, b, k)
    common = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(common / distinct_shingles(a, k), F.lit(1.0)))


def as_text(s: Column) -> Column:
    """A sketch as one string, 16 hexadecimal digits a hash."""
    return F.concat_ws("", F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of every text, of its edited text and its likeness to that and to the next text.

    The edited text has the last third (rounded down) of its code points
    replaced by as many of the beginning of the next document's, or all of it if
    that is shorter. The next document has the next smaller key; the one with
    the greatest follows the last. Null texts count as empty. Rows that repeat a
    key are each fingerprinted; as a next document the least of their texts
    counts. Rows without a key are in no order: nothing replaces their last
    third, and ``near_next`` is null. An empty table gives no rows; other
    columns are not read.

    Only keys are ranked. The texts are shuffled once by key; what a text lends
    to the one before it, its beginning and its sketch, follows.
    """
    every = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    whole = every.where(F.col("__key").isNotNull())
    sized = whole.groupBy("__key").agg(F.max(F.expr("length(__text) div 3")).alias("__need"))
    ranked = global_rank(sized, [F.desc("__key")], rank="__rank", total="__total").select("__key", "__need", "__rank", "__total")
    wanted = ranked.select(F.col("__key").alias("__for"), "__need", (F.col("__rank") % F.col("__total") + 1).alias("__rank")).join(
        ranked.select("__key", "__rank"), "__rank").select("__key", "__for", "__need")
    sketched = whole.select("*", sketch(F.col("__text"), k, width).alias("__sketch"))
    heads = (
        sketched.join(wanted, "__key")
        .groupBy(F.col("__for").alias("__key"))
        .agg(F.min(F.struct(F.expr("substring(__text, 1, __need)").alias("head"), F.col("__sketch").alias("sketch"))).alias("__next"))
    )
    # Both sides of the joins read one exchange of the texts, so rows without a key stay apart.
    joined = sketched.join(heads, "__key", "left")
    unordered = every.where(F.col("__key").isNull()).select("*", sketch(F.col("__text"), k, width).alias("__sketch"))
    joined = joined.unionByName(unordered, allowMissingColumns=True)
    n = F.length("__text")
    third = F.expr("length(__text) div 3")
    head = F.coalesce(F.col("__next.head"), F.lit(""))
    edited = joined.select(
        "__key", "__sketch", "__next", n.cast("long").alias("__n"),
        F.concat(F.substring("__text", 1, n - third), F.substring(head, 1, third)).alias("__edited"))
    full = edited.select("*", sketch(F.col("__edited"), k, width).alias("__edited_sketch"))
    return full.select(
        F.col("__key").alias(key), F.col("__n").alias("n_chars"), F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("__sketch").alias("sketch"), F.col("__edited_sketch").alias("edited_sketch"),
        resemblance(F.col("__sketch"), F.col("__edited_sketch"), k).alias("near_edited"),
        F.when(F.col("__next").isNotNull(), resemblance(F.col("__sketch"), F.col("__next.sketch"), k)).alias("near_next"),
    )
