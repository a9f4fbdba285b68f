"""Licence scans by canonical digest (DataFrame functions only).

A text's canonical form drops what doesn't matter for a licence: case, punctuation, white space,
copyright lines and spelling.  Whole texts are looked up by the digest of that form with equivalent
phrases made one, an equality join with the known licences' digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import UPPER, literal_table, lower_ascii
from spindrift.llm.license_texts import KNOWN, PHRASES, SPELLINGS, WHOLE

#: ASCII punctuation and controls become spaces.
_PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: A line that is a copyright notice: it starts with the word or a sign and has a year, or with both, or with a template's
#: year, or is "all rights reserved".  A line of a licence's prose that begins with "copyright holders" is none.
_SIGN = r"(?:©|\(c\))"
_YEAR = r"(?:(?:19|20)[0-9][0-9]|\[yyyy\]|\[year\]|<year>|\{yyyy\}|\{year\})"
_COPYRIGHT = rf"(^|\n)[^a-z0-9\n©]*(?:copyright[ \t]*{_SIGN}|(?:copyright|{_SIGN})[^\n]*{_YEAR}|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words between single spaces, variant spellings replaced; null: empty."""
    t = F.regexp_replace(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"\r\n?", "\n"), _COPYRIGHT, "\n")
    words = F.split(F.trim(F.regexp_replace(t, _PUNCTUATION, " ")), " ")
    table = F.create_map(*(F.lit(x) for pair in SPELLINGS for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def one_phrase(form: Column) -> Column:
    """A canonical form with the variant phrases replaced."""
    for variant, standard in PHRASES:
        form = F.regexp_replace(form, f"(?<![^ ]){variant}(?![^ ])", standard)
    return form


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id of the known texts; a digest that two licences share keeps the first by name."""
    rows = literal_table(spark, known or KNOWN + WHOLE, ["license_id", "license_text"])
    return rows.groupBy(F.sha2(one_phrase(canonical(F.col("license_text"))), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> id, digest, license_id, one row for each row; license_id is null unless the whole text is a known licence.

    digest is the canonical form's; the lookup's differs from it only in texts that hold a variant phrase.

    A text matches however its lines are broken, as only whole notice lines are left out.  Null and empty texts, and texts with nothing but punctuation and copyright lines, have the empty form's digest and
    match nothing.  Texts of any length are hashed whole; repeated rows each give a row; other columns are ignored.
    known(digest, license_id) has one row for each digest.
    """
    rows = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("_form")).select(id_col, "_form", F.sha2("_form", 256).alias("digest"))
    variant = F.col("_form").rlike(f"(?<![^ ])(?:{'|'.join(v for v, _ in PHRASES)})(?![^ ])")
    rows = rows.select(id_col, "digest", F.when(variant, F.sha2(one_phrase(F.col("_form")), 256)).otherwise(F.col("digest")).alias("_key"))
    empty = F.sha2(F.lit(""), 256)
    return rows.join(known.where(F.col("digest") != empty).select(F.col("digest").alias("_key"), "license_id"), "_key", "left").select(id_col, "digest", "license_id")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The query of scan_licenses over documents, for DuckDB."""
    form = f"list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(t, ''), '{UPPER}', '{UPPER.lower()}'), '\\r\\n?', chr(10), 'g'), '{_COPYRIGHT}', chr(10), 'g'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' '), lambda w: CASE w {' '.join(f'WHEN {_quote(a)} THEN {_quote(b)}' for a, b in SPELLINGS)} ELSE w END)"
    digest = f"sha256(array_to_string({form}, ' '))"
    known = ", ".join(f"({_quote(i)}, {_quote(x)})" for i, x in KNOWN)
    return f"""WITH known AS (SELECT {digest} AS digest, min(i) AS license_id FROM (VALUES {known}) v(i, t) GROUP BY 1),
docs AS (SELECT doc_id, {digest} AS digest FROM (SELECT doc_id, text AS t FROM documents))
SELECT doc_id, docs.digest, license_id FROM docs LEFT JOIN (SELECT * FROM known WHERE digest <> sha256('')) k ON docs.digest = k.digest"""
