"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Equal ranges of the key split each source into buckets of a bounded size (the
keys are uniform, so the ranges need no sampling), documents are sorted by key within their bucket, and running sums
over bucket totals plus running sums within a bucket give each document the words before it in its source. The
source's budget is cut exactly there; whole epochs come first where the budget is larger than the source.

Defined results: null text has size 0; null is a source of its own, last in order; null and repeated ids are mixed like
others; sources without words have target 0; an empty table gives none. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import Store, parts

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's place in code point order, repeating; words in the mix over words in the input; the most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Rows in a bucket, and the least number of buckets, so that also a source with most of few rows is spread over tasks.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64
#: Sources in a range whose places are counted in one task.
SOURCES = 100_000


def order_key(doc_id: F.Column, text_hash: F.Column) -> F.Column:
    """Hash-random and not negative; documents are taken in its order."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text_hash, F.lit("mix")), 1)


def targets(sources: DataFrame, store: Store, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Adds target (double) to (source, source_size), a saved table: share by weight, none above epochs times its size, the
    excess given to the others by weight.

    Places in code point order come from ranges of sources, so no task has all of them. The level up to which sources
    are filled, in words a weight, rises from round to round as sources that it fills are set aside; a round is a sum.
    """
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(parts(sources.count(), SOURCES), order).sortWithinPartitions(order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = store.save(ranged.select("source", "source_size", F.spark_partition_id().alias("part"), at.alias("at")), "ranged")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))  # a row per range
    place = ((F.col("before") + F.col("at")) % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), place)
    x = ranged.join(F.broadcast(offsets), "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(epochs))).alias("cap"))
    total, level = x.agg(F.sum("source_size")).first()[0], 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, rest = x.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        higher = ((total or 0) * share - capped) / rest if rest else math.inf
        if not rest or higher <= level:
            break
        level = higher
    target = F.least("cap", F.lit(level) * F.col("weight")) if rest else F.col("cap")
    return x.select("source", "source_size", target.alias("target"))


def source_key(source: str) -> F.Column:
    """A key that null has too."""
    return F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("="), source))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, before (the words before it in its
    source's order), full (whole epochs of its source), key (its place in that order), source.

    taken counts whole epochs plus, of the last epoch, what lies before the source's cut; one document a source may be cut.
    """
    store = Store(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    keyed = own.withColumn("skey", source_key("source")).withColumn("key", order_key(F.col("doc_id"), F.col("text_hash")))
    sized = store.save(keyed, "sized")
    buckets = min(parts(sized.count(), bucket_rows, LEAST_BUCKETS), 1 << 30)
    sized = sized.withColumn("bucket", F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(buckets), 31))
    sums = sized.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    sums = store.save(sums, "sums")
    sources = sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    each = targets(store.save(sources, "sources"), store, weights, share, epochs)
    each = each.withColumn("skey", source_key("source")).drop("source")
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))
    cuts = store.save(sums.select("skey", "bucket", before.alias("ahead")).join(each, "skey"), "cuts")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    x = sized.join(cuts, ["skey", "bucket"]).withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    x = x.withColumn("budget", F.round("target").cast("long")).withColumn("full", full)
    rest = F.col("budget") - F.col("full") * F.col("source_size") - F.col("before")
    taken = (F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(rest, "size"))).cast("long")
    return x.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "before", "full", "key", "source")


def cuts(mixed: DataFrame) -> DataFrame:
    """For mixes of whole documents: a row per source: source, full, cut. A document comes full times, and once more if its
    key is not above cut (null: none); the document that the budget cuts comes if half of it or more lies before the cut."""
    once_more = F.col("taken") - F.col("full") * F.col("size") >= F.greatest(F.col("size") / 2, F.lit(1))
    empty = (F.col("size") == 0) & (F.col("before") < F.round("target").cast("long") - F.col("full") * F.col("source_size"))
    return mixed.groupBy("source").agg(F.first("full").alias("full"), F.max(F.when(once_more | empty, F.col("key"))).alias("cut"))
