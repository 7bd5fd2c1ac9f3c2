"""Language ID by bit-sliced Bloom filters over character n-grams.

Each slot of the filter is a bit mask with one bit per language, so the AND of an n-gram's slots gives all languages
that contain it at once; a mask has as many 64-bit words as the languages need, and there are SLOTS_A_GRAM slots or more
for each n-gram of the language that has most. Over a document's n-grams each language's bits are counted, the count is
corrected for the share of false positives that the language's filter has, and the largest corrected count decides.

Learning takes a bounded sample: about SAMPLE documents of each language, drawn by a hash, whole texts. A language
contains an n-gram if the share of its documents with it is at least NEAR times that of the language with most; so
lines in another language, or wrong labels, in a few documents don't make it a part of theirs. All languages are
learned, and all n-grams are held.

Defined results: null texts and texts without a letter are "und" with score 0; languages whose counts are equal
rank by their number of documents; with nothing to learn from all are "und"; repeated rows and null ids
are judged like others; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.store import bound_batches, tidy

SAMPLE, NEAR, UNKNOWN = 4000, 0.1, "und"
#: The share of its n-grams that a kept document's language contains at least.
LEAST = 0.4
#: Slots of a filter: so many for each n-gram, and at least this many.
SLOTS_A_GRAM, LEAST_SLOTS = 16, 1 << 16
ORDERS, HASHES = (3, 4), 3
#: Characters that are hashed at once, so that the arrays stay in a core's cache.
CHUNK = 1 << 16
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    """The lower-case text between two gaps, with 0 for each gap, that is, for what isn't a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[points], points, 0).astype(np.uint64)


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams whose gaps are first or last."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, order, np.uint64)
    whole = np.ones(n, bool)
    for k in range(order):
        own = points[k : k + n]
        h = (h ^ own) * np.uint64(ODD[k])
        h ^= h >> np.uint64(29)
        if 0 < k < order - 1:
            whole &= own > 0
    return h[whole]


def slots(h: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th slot of each hash, of n slots, a power of two."""
    return ((h * np.uint64(ODD[k] | 1)) >> np.uint64(65 - n.bit_length())).astype(np.int64)


@dataclass
class Filters:
    names: list[str]
    masks: np.ndarray
    false_share: np.ndarray

    @classmethod
    def build(cls, names: list[str], found: list[np.ndarray]) -> Filters:
        """found: the hashes of each language's n-grams."""
        n = 1 << (max(LEAST_SLOTS, SLOTS_A_GRAM * max(map(len, found), default=0)) - 1).bit_length()
        masks = np.zeros((n, max(1, -(-len(names) // 64))), np.uint64)
        for bit, h in enumerate(found):
            for k in range(HASHES):
                masks[slots(h, k, n), bit >> 6] |= np.uint64(1 << (bit & 63))
        fill = np.array([cls.bit(masks, b).mean() for b in range(len(names))])
        return cls(names, masks, fill**HASHES)

    @staticmethod
    def bit(masks: np.ndarray, b: int) -> np.ndarray:
        return (masks[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)

    def contained(self, h: np.ndarray) -> np.ndarray:
        """The mask of the languages that contain each n-gram."""
        got = self.masks.take(slots(h, 0, len(self.masks)), axis=0)
        for k in range(1, HASHES):
            got &= self.masks.take(slots(h, k, len(self.masks)), axis=0)
        return got

    def judge(self, text: str | None) -> tuple[str, float]:
        points = code_points(text or "")
        if not self.names or not points.any():
            return UNKNOWN, 0.0
        n, counts = 0, np.zeros(len(self.names))
        for start in range(0, len(points), CHUNK):
            for order in ORDERS:
                h = grams(points[start : start + CHUNK + order - 1], order)
                n += len(h)
                got = self.contained(h)
                counts += [int(self.bit(got, b).sum()) for b in range(len(self.names))]
        if not n:
            return self.names[0], 0.0
        sure = np.maximum(counts - n * self.false_share, 0) / (1 - np.minimum(self.false_share, 0.999))
        best = int(sure.argmax())
        return self.names[best], float(min(1.0, sure[best] / n))


def gram_counts(names: list[str]):
    """(lang, text) to (lang, gram, n): in how many of the documents each language's n-grams are."""
    place = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in names]
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points = code_points(text.as_py())
                held[place[lang]].append(np.unique(np.concatenate([grams(points, order) for order in ORDERS])))
            for name, found in zip(names, held, strict=True):
                if found:
                    gram, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE, near: float = NEAR) -> Filters:
    """docs: the (doc_id, text, lang) to learn from."""
    spark = docs.sparkSession
    bound_batches(spark)
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Filters.build([], [])
    names = [r["lang"] for r in counts]  # in this order where counts are equal
    each = [(r["lang"], min(1.0, sample / r["count"]), float(min(r["count"], sample))) for r in counts]
    sizes = F.broadcast(spark.createDataFrame(each, "lang string, share double, drawn double"))  # a row per language
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("language")), 11) / F.lit(float(1 << 53))
    drawn = usable.join(sizes, "lang").where(u < F.col("share")).select("lang", "text")
    found = drawn.mapInArrow(tidy(gram_counts(names)), "lang string, gram long, n long")
    table = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.col("drawn")
    most = F.max(rate).over(Window.partitionBy("gram"))  # a row per language at most
    kept = table.join(sizes, "lang").withColumn("most", most).where(rate >= near * F.col("most"))
    kept = kept.select("lang", "gram").toArrow().to_pandas()  # the n-grams of a bounded number of documents
    found = {name: own.to_numpy(np.int64).view(np.uint64) for name, own in kept.groupby("lang")["gram"]}
    return Filters.build(names, [found.get(name, np.zeros(0, np.uint64)) for name in names])


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the share of its n-grams that the language contains), and text_hash."""
    model = docs.sparkSession.sparkContext.broadcast(filters)  # of a bounded number of documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value.judge
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(2)]
            found = [pa.array([lang for lang, _ in got], pa.string()), pa.array([score for _, score in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["doc_id", "text_hash", "lang_pred", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return own.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, text_hash long, lang_pred string, score double")


def keep_known(docs: DataFrame, filters: Filters, text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that are in a learned language, which is written over lang_col.

    A text is in none if it has no letter, or if no language contains a share of `least` of its n-grams.
    """
    model, schema = docs.sparkSession.sparkContext.broadcast(filters), docs.schema
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.value.judge(x.as_py()) for x in batch.column(at)]
            langs = pa.array([lang for lang, _ in got], pa.string()).cast(batch.column(lang_at).type)
            cols = [langs if k == lang_at else x for k, x in enumerate(batch.columns)]
            known = pa.array([lang != UNKNOWN and score >= least for lang, score in got], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names).filter(known)

    return docs.mapInArrow(tidy(run), schema)


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
