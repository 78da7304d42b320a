"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket (a partial sum, so a hot source
costs no more than another). Per source the buckets' running sum is cut at the
budget: buckets below it are taken whole, and only the one that it falls into
is summed again, by the next bits of the hash. Three such levels of 4096
buckets leave a threshold of 36 bits; a document is taken once more if its
hash is below its source's threshold. Nothing is sorted but the buckets.

A null text or one without words has size 0 and is never taken. A null source
is a source of its own, the last. Rows with equal hashes (repeated rows) are
numbered across all tasks, and all but the first get a hash of their number, so
that a source of equal rows comes as near its target as any other. Extra
columns are ignored by the query and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.merkle import GROUP, positions
from codequarry.runtime import materialize

LEVEL_BITS, LEVELS = 12, 3
SOURCE = ["source_key", "source_null"]
#: Weights that repeat over the sources in code-point order.
WEIGHTS = (3, 1, 2)
#: Rows of the table of sources that are broadcast at most; beyond, a salted join.
BROADCAST_SOURCES = 20_000
SALTS = 32


def size_of(text: Column) -> Column:
    """Number of words: maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(documents: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, source keys, size and the first 36 bits of a hash of each row, written once; and what is ``carried``."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.col("source").isNull().alias("source_null"),
        size_of(F.col("text")).alias("size"),
        place(F.col("doc_id"), F.col("text")).alias("place"),
        *carried,
    )
    return apart(materialize(rows, "sizes"))


def apart(rows: DataFrame) -> DataFrame:
    """Rows of which no two need share a place: of equal places all but one move to a place made of it and their number."""
    again = materialize(rows.groupBy("place").count().filter("count > 1").select("place"), "mixing-again")
    if again.isEmpty():
        return rows
    group = dict(zip(GROUP, (F.lit(True), F.col("place").cast("string"))))
    same = positions(rows.join(again, "place", "left_semi").withColumns(group), ["doc_id", "size"])
    moved = F.when(F.col("idx") == 0, F.col("place")).otherwise(_bits(F.xxhash64("place", "idx")))
    return materialize(rows.join(again, "place", "left_anti").select(rows.columns).unionByName(same.withColumn("place", moved).select(rows.columns)), "mixing-apart")


def _bits(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - LEVEL_BITS * LEVELS)


def place(doc_id: Column, text: Column) -> Column:
    return _bits(F.xxhash64(doc_id.cast("long"), text))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size and target.

    The budget is shared by weight; no target exceeds ``most`` times its
    source, and the excess is shared again by weight. Equivalently, targets
    are min(weight * level, most * size) at the level that spends the budget,
    found by one pass over the sources in the order in which they reach their
    limit. One row per source passes through the windows.
    """
    per = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy("source_null", "source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_null", "source_key")
    per = (
        per.withColumn("full", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("nth", F.row_number().over(order))
    )
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("nth", "level"))
    per = per.withColumn("found", F.min(fits).over(Window.partitionBy()))
    target = F.when(F.col("found").isNull(), F.col("limit")).otherwise(F.least(F.col("weight") * F.col("found.level"), F.col("limit")))
    return per.select(*SOURCE, "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size, target, copies of every document, and the threshold below which one more is taken."""
    plan = targets(sizes, share, most, weights)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("threshold", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = sizes
        if level:
            same = F.shiftrightunsigned("place", shift + LEVEL_BITS) == F.shiftrightunsigned("threshold", shift + LEVEL_BITS)
            inside = _with_sources(sizes, plan.select(*SOURCE, "threshold")).filter(same)
        sums = inside.groupBy(*SOURCE, F.shiftrightunsigned("place", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy(*SOURCE).orderBy("bucket"))
        cut = sums.withColumn("upto", running).join(plan.select(*SOURCE, "left"), SOURCE)
        last = level == LEVELS - 1
        over = F.col("upto") > F.col("left")
        if last:  # the bucket that the budget falls into is taken if that comes nearer
            over = F.col("upto") - F.col("left") > F.col("left") - (F.col("upto") - F.col("size"))
        cut = cut.groupBy(*SOURCE).agg(F.min(F.when(over, F.col("bucket"))).alias("cut"), F.max("bucket").alias("top"), F.sum(F.when(~over, F.col("size"))).alias("used"))
        plan = plan.join(cut, SOURCE, "left")
        bucket = F.coalesce(F.col("cut"), F.col("top") + 1)
        plan = materialize(
            plan.withColumn("threshold", F.coalesce(F.shiftleft(bucket, shift), F.col("threshold")))
            .withColumn("left", F.col("left") - F.coalesce("used", F.lit(0)))
            .drop("cut", "top", "used"),
            "mixing",
        )
    return plan.select(*SOURCE, "source_size", "target", "copies", "threshold")


def _with_sources(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows joined with their source's: by broadcast up to a checked size, else salted against hot sources."""
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per_source), SOURCE)
    salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int")).join(salted, [*SOURCE, "salt"]).drop("salt")


def planned(documents: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The sizes of all rows, written once, and the plan of each source."""
    sizes = sized(documents)
    return sizes, thresholds(sizes, **options)


def taken_copies() -> Column:
    return F.when(F.col("size") > 0, F.col("copies") + (F.col("place") < F.col("threshold")).cast("int")).otherwise(0)


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken (0, 1 or 2 times), columns unchanged."""
    rows = sized(documents, F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"))
    plan = thresholds(rows.drop("row"), **options)
    again = _with_sources(rows, plan).withColumn("n", taken_copies()).filter("n > 0")
    return again.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    sizes, plan = planned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _with_sources(sizes, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * taken_copies()).alias("taken"))
