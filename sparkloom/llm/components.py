"""Connected components of a graph given by its links, by alternating star operations (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import Store, parts

#: A node with more than 1/HOT of the links, and more than LEAST of them, is hot.
HOT, LEAST = 1024, 100
#: Links for each task that writes: rows of 16 bytes, so a small graph isn't written as a file for each shuffle partition.
TASK_LINKS = 500_000


def _with_least(links: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """links (a, b) with m, the least node that least (a, m, n) tells of a.

    The hot nodes, 2 x HOT at most (or 1/50 of few links), are broadcast, so their links are joined where they are; the
    others' are shuffled, and no key of that shuffle has many.
    """
    limit = max(LEAST, rows // HOT)
    hot = F.broadcast(least.where(F.col("n") > limit).select("a", "m"))
    cold = least.where(F.col("n") <= limit).select("a", "m")
    rest = links.join(hot.select("a"), "a", "left_anti").join(cold, "a")
    return links.join(hot, "a").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def _large_star(links: DataFrame, store: Store, rows: int, name: str) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, or to itself if it is smaller."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = store.save(least.coalesce(parts(rows, TASK_LINKS, 6)), f"{name}-least")
    met = _with_least(both.where("b > a"), least, rows)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, store: Store, rows: int, name: str) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = store.save(least.coalesce(parts(rows, TASK_LINKS, 6)), f"{name}-least")
    met = _with_least(down, least, rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return met.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, store: Store) -> DataFrame:
    """(node, root) for every node of links (a, b) but the roots; root is the smallest node of its component.

    Each star's links are written to the shared folder and read by the next one; the result is read from there too. A hot node is a key of sums that are
    combined before the shuffle, and of broadcast joins.
    """
    now, name = store.save(links.where("a <> b"), "links-0"), "links-0"
    state, n, rows = None, 0, now.count()
    while True:
        for star in (_large_star, _small_star):
            n += 1
            now = store.save(star(now, store, rows, f"links-{n}").coalesce(parts(rows, TASK_LINKS, 6)), f"links-{n}")
            store.drop(name, f"links-{n}-least")
            name = f"links-{n}"
        own = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if own == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, rows = own, own[0]
