"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text form a group and go to one shard, unless the group's bytes exceed a shard's; such groups,
fewer than there are shards, are split by a hash of the id into pieces of a quarter of a shard. A group of many rows and
few bytes stays whole: bytes come out near equal, tokens and rows as near as whole groups allow. Groups of at least
1/LARGE of a shard, whose number the sum of all sizes bounds, are placed on the driver, largest first. The others are
dealt over tasks, and each task places its own, largest first, into its share of every shard's residual capacity.
Both place a group where the dot product of its size with the residual capacity is highest, dimensions in fractions
of their totals. A task's shards differ by about its smallest groups, so the sums over tasks stay near equal.

Defined results: null text has no bytes and its group is that of the empty text; null and repeated ids are placed
like others; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import Store, parts

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that a row counts besides its text; groups from 1/LARGE of a shard are placed first; groups a task places; rows of a shard that are numbered in one sort.
ROW_BYTES, LARGE, TASK_GROUPS, SLOT_ROWS = 16, 64, 50_000, 20_000
SIZES = ("size", "tokens", "n")


#: What a dimension's residual counts in the dot product: bytes are what must come out near equal.
WEIGHTS = (64.0, 1.0, 1.0)


def pack(sizes: np.ndarray, residual: np.ndarray, turn: int = 0, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each group, given in the order of placement. residual (shards x dimensions) is lowered in place; turn is the shard that wins ties."""
    order = np.roll(np.arange(len(residual)), -turn)
    left, own = residual[order].copy(), sizes * np.array(weights)
    out = np.empty(len(sizes), np.int32)
    for i, size in enumerate(sizes):
        k = int((left @ own[i]).argmax())
        left[k] -= size
        out[i] = order[k]
    residual[order] = left
    return out


def largest_first(sizes: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    return np.lexsort((*ties, -sizes.sum(axis=1)))


def place(residual: np.ndarray, totals: np.ndarray, share: np.ndarray, weights: tuple[float, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places the groups of a task; share: what all tasks together place, as a fraction of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(got)
        key, crc = table["gkey"].to_numpy(), table["text_crc32"].to_numpy()
        sizes = np.stack([table[c].to_numpy() for c in SIZES], axis=1) / totals
        order = largest_first(sizes, crc, key)
        mine = residual * (sizes.sum(axis=0) / np.where(share > 0, share, 1))
        shard = np.empty(len(sizes), np.int32)
        shard[order] = pack(sizes[order], mine, int(key.view("u8").sum() % len(residual)), weights)
        names = ["gkey", "text_crc32", "piece"]
        yield pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in names], pa.array(shard)], [*names, "shard"])

    return run


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    large: int = LARGE,
    task_groups: int = TASK_GROUPS,
    slot_rows: int = SLOT_ROWS,
    weights: tuple[float, ...] = WEIGHTS,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, tokens."""
    spark, store = docs.sparkSession, Store(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.encode(text, "UTF-8").alias("b")).select(
        "doc_id",
        (F.octet_length("t") + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32("b").alias("text_crc32"),
        F.xxhash64("t").alias("gkey"),
    )
    rows = store.save(sized, "rows")
    summed = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    groups = store.save(rows.groupBy("gkey", "text_crc32").agg(*summed), "groups")
    got = groups.agg(*[F.sum(c) for c in SIZES], F.count(F.lit(1))).first()
    if not got[3]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), "tokens")
    totals = np.maximum(np.array(got[:3], float), 1)
    full = F.col("size") / F.lit(float(totals[0]) / shards)  # in shards, by bytes
    over = lambda part: F.greatest(*[F.col(c) / F.lit(float(t) * part) for c, t in zip(SIZES, totals, strict=True)])
    hot = groups.where(full > 1).select("gkey", "text_crc32", F.ceil(full * 4).cast("int").alias("pieces")).collect()  # fewer than there are shards
    hot = spark.createDataFrame(hot, "gkey long, text_crc32 long, pieces int").coalesce(1)
    key = ["gkey", "text_crc32"]
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("piece")), "pieces"), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("piece", piece).drop("pieces")
    pieces = rows.join(F.broadcast(hot), key, "left_semi").groupBy(*key, "piece").agg(*summed)
    whole = groups.join(F.broadcast(hot), key, "left_anti").withColumn("piece", F.lit(0))
    items = whole.select(*key, "piece", *SIZES).unionByName(pieces.select(*key, "piece", *SIZES))

    is_large = over(1 / shards / large) >= 1
    big = items.where(is_large).toPandas()  # 3 x shards x large rows at most, for the sum of all sizes
    residual = np.full((shards, len(SIZES)), 1 / shards)
    sizes = big[list(SIZES)].to_numpy(float).reshape(-1, len(SIZES)) / totals
    order = largest_first(sizes, big["piece"].to_numpy(), big["text_crc32"].to_numpy(), big["gkey"].to_numpy())
    big = big.iloc[order].assign(shard=pack(sizes[order], residual, 0, weights))
    placed = spark.createDataFrame(big[[*key, "piece", "shard"]].astype("int64"), "gkey long, text_crc32 long, piece long, shard long")
    placed = placed.select(*key, *[F.col(c).cast("int").alias(c) for c in ("piece", "shard")]).coalesce(1)
    packing = place(residual, totals, 1 - sizes.sum(axis=0), weights)
    small = items.where(~is_large).repartition(parts(got[3], task_groups), "gkey")
    small = small.mapInArrow(packing, "gkey long, text_crc32 long, piece int, shard int")

    buckets = parts(int(got[2]), slot_rows * shards, 4)
    at = ["gkey", "text_crc32", "piece"]
    dealt = rows.join(F.broadcast(placed), at, "left").withColumnRenamed("shard", "big_shard")
    of_big = dealt.where(F.col("big_shard").isNotNull()).withColumnRenamed("big_shard", "shard")
    of_small = dealt.where(F.col("big_shard").isNull()).drop("big_shard").join(small, at)
    cols = ["doc_id", "size", "text_crc32", "shard", "tokens"]
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(buckets)).cast("int")
    dealt = store.save(of_big.select(*cols).unionByName(of_small.select(*cols)).withColumn("bucket", bucket), "dealt")
    store.drop("rows", "groups")
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    slot = (F.col("ahead") + F.row_number().over(within) - 1).cast("long").alias("slot")
    return dealt.join(counts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", slot, "tokens")
