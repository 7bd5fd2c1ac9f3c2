"""The queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, exact_dedup, language, licenses, mixing, sharding, simhash, token_files, toxicity, warc
from sparkloom.llm.license_texts import KNOWN

SHARDS, TOKENIZER, END_ID = 40, "byte_bpe_50k.json", 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.held_out("doc_id", 3, 1)
    x = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return x.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = token_files.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return x.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), language.held_out("doc_id", 5, 0)
    x = language.predict(docs, language.learn(docs.where(~out).select("doc_id", "text", "lang")))
    return x.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _ = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""

def canonical_sql(text: str) -> str:
    """licenses.canonical in DuckDB, said another way: by lists of lines and of words, and plain replacing of pairs of words."""
    lines = f"list_filter(string_split(lower({text}), chr(10)), lambda x: NOT regexp_matches(x, '^[ \\t]*((portions )?copyright\\b|[(]c[)]|©)'))"
    kept = f"regexp_replace(replace(array_to_string({lines}, chr(10)), 'https://', 'http://'), '\\ball rights reserved\\b', ' ', 'g')"
    words = f"regexp_extract_all(translate({kept}, '‘’“”‐‑‒–—―©', '           '), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    spelled = f"""list_transform({words}, lambda x: CASE
        WHEN x IN ('licence', 'licences', 'licenced', 'licencee', 'licencees') THEN 'license' || substr(x, 8)
        WHEN starts_with(x, 'favour') THEN 'favor' || substr(x, 7)
        WHEN x = 'whilst' THEN 'while'
        WHEN regexp_full_match(x, '(author|authori|organi|recogni)s(ation|ed|e|ing)') THEN regexp_replace(x, 's(ation|ed|e|ing)$', 'z\\1')
        ELSE x END)"""
    out = f"' ' || array_to_string({spelled}, '  ') || ' '"
    for pair, to in ((" sub  license", " sublicense"), (" non  infringement ", " noninfringement "), (" copyright  owner ", " copyright  holder "), (" copyright  owners ", " copyright  holders "), (" per  cent ", " percent ")):
        out = f"replace({out}, '{pair}', '{to}')"
    return f"trim(replace({out}, '  ', ' '), ' ')"


OP4_SQL = f"""
WITH k(license_id, text) AS (VALUES {", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in KNOWN.items())}),
known AS (SELECT license_id, sha256({canonical_sql("text")}) AS canonical_sha256 FROM k),
d AS (SELECT doc_id, sha256({canonical_sql("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known USING (canonical_sha256)"""

OP6_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (SELECT page_id, url, html, hex, [CAST('0x' || substr(hex, 10 * c + 1, 10) AS BIGINT) for c in [0, 1, 2, 3]] AS fives FROM p),
d AS (SELECT page_id, url, html, max(page_id) OVER (PARTITION BY hex) AS response_id, array_to_string(
    [array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1) for s in [35, 30, 25, 20, 15, 10, 5, 0]], '') for v in fives], '') AS payload_digest
    FROM digits)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to, url
FROM d"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[s + 1 : s + least(len(ws), 13)], ' ') AS win FROM b, range(0, greatest(len(ws) - 13, 0) + 1) t(s) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s + 1 : s + n], ' ') AS win FROM w, sizes, range(0, len(ws) - n + 1) t(s) WHERE len(ws) >= n),
hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, s + i AS p FROM hit, range(0, n) t(i)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id),
-- proximity: pairs of the three rarest places of each window that occur, within 13 words of each other
terms AS (SELECT doc_id, p, lower(ws[p]) AS t FROM w, range(1, len(ws) + 1) r(p)),
seen AS (SELECT t, count(*) AS n FROM terms GROUP BY t),
places AS (SELECT DISTINCT b.item_id, ws, s, i AS place, lower(ws[s + i]) AS t FROM b, range(0, greatest(len(ws) - 13, 0) + 1) x(s), range(1, least(len(ws), 13) + 1) y(i)),
ranked AS (SELECT item_id, ws, s, t, row_number() OVER (PARTITION BY item_id, ws, s ORDER BY n, place) AS r FROM places JOIN seen USING (t)),
pairs AS (SELECT DISTINCT a.item_id, least(a.t, z.t) AS t1, greatest(a.t, z.t) AS t2 FROM ranked a JOIN ranked z ON a.item_id = z.item_id AND a.ws = z.ws AND a.s = z.s AND a.r < z.r AND z.r <= 3),
rare AS (SELECT * FROM terms WHERE t IN (SELECT t1 FROM pairs UNION SELECT t2 FROM pairs)),
met AS (SELECT DISTINCT a.doc_id, least(a.t, z.t) AS t1, greatest(a.t, z.t) AS t2 FROM (SELECT doc_id, t, p + d AS p FROM rare, range(1, 14) g(d)) a JOIN rare z USING (doc_id, p)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM met JOIN pairs USING (t1, t2) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id LEFT JOIN near ON w.doc_id = near.doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_token_files, op4_license_scan, op5_language, op6_warc, op7_decontaminate, op8_simhash, op9_mixing, op10_exact_dedup)}
ORACLE: dict[str, str] = {"op4_license_scan": OP4_SQL, "op6_warc": OP6_SQL, "op7_decontaminate": OP7_SQL, "op10_exact_dedup": OP10_SQL}
