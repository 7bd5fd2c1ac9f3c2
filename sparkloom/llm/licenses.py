"""License scans by canonical digest, with DataFrame functions only.

Case, punctuation, copyright lines and equivalent spellings are normalised away in texts and in known licences alike,
and whole texts are hash-joined to the known digests. The known licences are a fixed list, so their side is broadcast.

Defined results: null text has no canonical text, digest or licence; a text whose canonical form is empty has a digest
but no licence; repeated rows and null ids are scanned like others; an empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.license_texts import KNOWN

#: Fixed values, applied in this order to the lower-cased text: what goes from it as written, and what doesn't count in it.
LINES: tuple[tuple[str, str], ...] = (
    (r"(?m)^[ \t]*((portions )?copyright\b|\(c\)|©)[^\n]*$", " "),
    (r"\ball rights reserved\b\.?", " "),
    (r"https://", "http://"),
)
PUNCTUATION = r"[\x{2018}\x{2019}\x{201C}\x{201D}\x{2010}-\x{2015}\x{00A9}\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spellings, once words stand with one space between them.
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"\blicence(s|d|e|es)?\b", r"license$1"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bcopyright owner(s?)\b", r"copyright holder$1"),
    (r"\b(author|organi|recogni|authori)s(ation|ed|e|ing)\b", r"$1z$2"),
    (r"\bfavour", "favor"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
)
#: A text without any of these is not changed by the lines above, or by the spellings; most texts have none.
HAS_LINES = r"copyright|\(c\)|©|all rights reserved|https://"
HAS_SPELLINGS = r"licence|sub licen|non infringement|copyright owner|authoris|authors|organis|recognis|favour|whilst|per cent"


def replaced(text: F.Column, steps: tuple[tuple[str, str], ...], hint: str) -> F.Column:
    out = text
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.when(text.rlike(hint), out).otherwise(text)


def canonical(text: F.Column) -> F.Column:
    out = F.regexp_replace(replaced(F.lower(text), LINES, HAS_LINES), PUNCTUATION, " ")
    return F.trim(replaced(out, SPELLINGS, HAS_SPELLINGS))


def known_licenses(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """(license_id, canonical_sha256)."""
    texts = spark.createDataFrame([*known.items()], "license_id string, text string").coalesce(1)
    return texts.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, canonical_sha256, license_id (null: not known). known: a bounded table like that of known_licenses()."""
    known = known_licenses(docs.sparkSession) if known is None else known
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    return digests.join(F.broadcast(known), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
