"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the digests, one per task and merged by sum, give every digest that may hold more than
1/HEAVY of the rows. Exact counts verify them; the verified winners, HEAVY rows at most, are broadcast and their
copies decided in the map task. All other digests are grouped by an ordinary shuffle, in which no key is hot.

Defined results: null text counts as empty; empty texts are equal to each other; rows that repeat a doc_id with equal
text share one decision; null ids lose to any id, and stay where a group has no other; an empty table gives none.
Other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import Store

#: A digest with more than 1/HEAVY of the rows, and at least LEAST_ROWS, is hot. COUNTERS bounds a task's summary.
HEAVY, COUNTERS, LEAST_ROWS = 1024, 8192, 1000
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def misra_gries(counters: int):
    """A task's summary: what is left of each digest's count, and the rows it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                left[x["values"]] = left.get(x["values"], 0) + x["counts"]
            if len(left) > counters:
                cut = int(np.partition(np.fromiter(left.values(), "i8", len(left)), -counters - 1)[-counters - 1])
                left = {k: v - cut for k, v in left.items() if v > cut}
        yield pa.RecordBatch.from_pydict({"text_sha256": pa.array(list(left), pa.string()), "left": pa.array(list(left.values()), pa.int64())})

    return run


def hot_digests(digests: DataFrame, rows: int, heavy: int = HEAVY, counters: int = COUNTERS, least: int = LEAST_ROWS) -> DataFrame:
    """Digests with more than 1/heavy of the rows: exact group size and smallest id. At most heavy rows.

    A summary undercounts a digest by rows/(counters+1) at most over all tasks together, so none is missed.
    """
    floor = max(rows / heavy, least) - rows / (counters + 1)
    left = digests.select("text_sha256").mapInArrow(misra_gries(counters), "text_sha256 string, left long")
    maybe = left.groupBy("text_sha256").agg(F.sum("left").alias("left")).where(F.col("left") >= floor).select("text_sha256")
    counted = digests.join(F.broadcast(maybe), "text_sha256", "left_semi").groupBy("text_sha256")
    exact = counted.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return exact.where(F.col("group_size") >= max(rows / heavy, least))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS, least: int = LEAST_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    store = Store(docs.sparkSession, "exact_dedup")
    digests = store.save(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(normalised(text_col), "UTF-8"), 256).alias("text_sha256")), "digests")
    hot = store.save(hot_digests(digests, digests.count(), heavy, counters, least), "hot")
    group = Window.partitionBy("text_sha256")
    own = [F.min("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")]
    rest = digests.join(F.broadcast(hot), "text_sha256", "left_anti").select("doc_id", *own, "text_sha256")
    winners = digests.join(F.broadcast(hot), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    return winners.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
