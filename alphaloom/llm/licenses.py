"""License scan: the canonical digest of an entire text, joined with the digests of known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import table
from alphaloom.llm.license_texts import DIGESTS, KNOWN

#: (pattern, replacement), in this order, over the lower-cased text. Without groups or look-around: the same in Java's and RE2's dialect.
RULES = (
    # Copyright lines: a holder, year or sign follows the word; "copyright notice" in running text stays.
    (r"(^|\n)[^a-z\n]*(portions )?copyright[ \t]*(\(c\)|©|:|[0-9<\[{]|by |holder:)[^\n]*", "\n"),
    (r"(^|\n)[^a-z\n]*(\(c\)|©)[ \t]*(copyright )?[0-9<\[{][^\n]*", "\n"),
    (r"(^|\n)[^a-z\n]*all rights reserved[^a-z\n]*", "\n"),
    # The publisher's address lines, which changed while the texts did not.
    (r"(^|\n)[^a-z\n]*(51 franklin st|59 temple pl|675 mass ave)[^\n]*", "\n"),
    # Equivalent spellings.
    (r"licence", "license"),
    (r"sub[ -]license", "sublicense"),
    (r"non[ -]?infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"per cent", "percent"),
    (r"copyright (owner|holder)s?", "copyright holder"),
    (r"&", " and "),
    (r"https://", "http://"),
    # Punctuation, list marks and white space.
    (r"(^|\n)[ \t]*(\(?[0-9a-z][.)]|[*-])[ \t]+", "\n"),
    (r"[^a-z0-9\x{80}-\x{10ffff}]+", " "),
)


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def known_digests(spark: SparkSession, known: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """license_id and digest: a row for each distinct canonical text, under its least name. known: texts by name, or a table of them (license_id, text); by default those
    of license_texts. As many rows as licences are known, whatever the input."""
    if known is None:
        known = KNOWN
        more = spark.createDataFrame([(v, k) for k, v in DIGESTS.items()], "digest string, license_id string")
    else:
        more = spark.createDataFrame([], "digest string, license_id string")
    texts = known.select("license_id", "text") if isinstance(known, DataFrame) else spark.createDataFrame(sorted(known.items()), "license_id string, text string")
    rows = texts.filter(canonical(F.col("text")) != "").select(F.md5(canonical(F.col("text"))).alias("digest"), "license_id").unionAll(more)
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_canonical (letters of the canonical text), digest, license_id (null: not an entire known text).

    Null and empty texts, and those of only punctuation, have the digest of empty text and no licence. Repeated rows and null ids each keep their row;
    an empty table gives none; other columns are left out. known is broadcast: its size is that of the licence list, not of the input.
    """
    text = docs.select("doc_id", canonical(F.col("text")).alias("c"))
    rows = text.select("doc_id", F.length("c").cast("long").alias("n_canonical"), F.md5("c").alias("digest"))
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "n_canonical", "digest", F.when(F.col("n_canonical") > 0, F.col("license_id")).alias("license_id"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')" if to != "\n" else f"regexp_replace({out}, '{pattern}', chr(10), 'g')"
    return f"trim({out}, ' ')"


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(KNOWN.items()))
    digests = ", ".join(f"({quote(v)}, {quote(k)})" for k, v in DIGESTS.items())
    return f"""
WITH known AS (SELECT digest, min(k) AS license_id FROM (SELECT md5({_sql_canonical("t")}) AS digest, k FROM (VALUES {values}) AS v(k, t) UNION ALL VALUES {digests}) GROUP BY 1),
texts AS (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents)
SELECT doc_id, length(c)::BIGINT AS n_canonical, md5(c) AS digest, CASE WHEN length(c) > 0 THEN license_id END AS license_id
FROM texts LEFT JOIN known ON md5(c) = digest"""


ORACLE_SQL = _oracle()
