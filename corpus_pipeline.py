"""A corpus pipeline over documents: language ID, near-dedup, decontamination, mixing and token files.

Each stage works on all rows that the one before kept, and its decisions take effect. Texts stay whole throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language, mixing, queries, simhash, token_files
from sparkloom.llm.store import Store, small_side

#: Columns of the documents that stages hand on, and their types where a table lacks one.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; one that the table lacks is null throughout."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's lang becomes the language found in its text, and documents in no learned language go: null texts,
    texts without a letter, and texts of which no language contains language.LEAST of the n-grams. Learns from documents
    whose crc32(doc_id) mod 5 isn't 0; where none of them has a lang, no language is learned and all go."""
    docs = _documents(docs)
    filters = language.learn(docs.where(~language.held_out("doc_id", 5, 0)).select("doc_id", "text", "lang"))
    return language.keep_known(docs, filters)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; of a group's rows that share it, one."""
    store, docs = Store(spark, "stage_near_dedup"), _documents(docs)
    found = simhash.near_dedup(docs)
    first = store.save(found.groupBy("component_id", "doc_id").agg(F.min("text_hash").alias("least"), F.count(F.lit(1)).alias("n")), "first")
    several = found.join(first.where("n > 1"), found["doc_id"].eqNullSafe(first["doc_id"]) & found["component_id"].eqNullSafe(first["component_id"])).where("text_hash <> least").select(found["doc_id"], "text_hash")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash")
    gone = store.save(gone.unionByName(several).toDF("gone_id", "gone_hash").distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash"))
    kept = docs.join(small_side(gone, store, "gone"), same, "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if first.where("n > 1").limit(1).count() else kept


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    store, docs = Store(spark, "stage_decontaminate"), _documents(docs)
    judged = decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), only_hits=True)
    bad = store.save(judged.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("dkey").alias("bad_key")).distinct(), "bad")
    same = docs["doc_id"].eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("bad_key"))
    return docs.join(small_side(bad, store, "bad"), same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; texts stay whole, so the one that a source's budget cuts comes if half of it or more is taken."""
    store, docs = Store(spark, "stage_mix"), _documents(docs)
    cuts = store.save(mixing.cuts(mixing.mix(docs)).withColumnRenamed("source", "of_source"), "cuts")
    x = docs.join(small_side(cuts, store, "cuts"), docs["source"].eqNullSafe(F.col("of_source")))
    once_more = F.coalesce(mixing.order_key(F.col("doc_id"), F.xxhash64("text")) <= F.col("cut"), F.lit(False))
    return x.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), (F.col("full") + once_more.cast("int")).cast("int"))).alias("copy")).drop("copy")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' place in the token files that are written: doc_id, start, n_tokens, ids_crc32; a copy has a row of its own."""
    x = token_files.encode_and_read(_documents(docs), queries.tokenizer_path(), queries.END_ID)
    return x.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: SQL can't express the hashes, models and files of these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's rows are written as Parquet and read again as the next one's documents."""
    store = Store(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
