"""Operator 2: licence scan by canonical digest lookup.

A text is normalised (case, copyright lines, equivalent spellings, punctuation,
white space) with string functions and hashed; equal digests join it to a
known licence.  Whole texts are compared: a licence with another text around it
does not match.  DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import text_or_empty
from riskspark.llm.licence_digests import WHOLE
from riskspark.llm.licence_texts import KNOWN

# Spellings taken as equal, after case and punctuation are gone (the public matching guidelines' list,
# but for pairs that part on punctuation alone).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("https", "http"),
)
# What follows "copyright" and "(c)" in the running text of the standard licences, where a line may begin
# with them; anything else that follows is a year, a sign or a holder.
_NO_HOLDER = (r"also|and|are|disclaimer|doctrines|(?:holder|owner|notice|statement)s?(?! *:)|if|interest|laws?|licen[cs]es?|like|line|of|on|or|ownership"
              r"|patent|permission|resulting|those|treaty|the (?:library|program|software)|the(?=[^\p{L}0-9\n]*(?:\n|$))")
_NO_SIGN = r"representations|under|you|the licenses|the(?=[^\p{L}0-9\n]*(?:\n|$))"
#: Lines that only state a copyright or reserve rights, in lower case.
COPYRIGHT_LINE = (r"(^|\n)[^\na-z0-9]*(copyright(?:[^\n\p{L}0-9]*(?:[0-9]|©|:|\(?c\))"
                  rf"|[^\n\p{{L}}0-9]++(?!(?:{_NO_HOLDER})(?![\p{{L}}0-9]))[\p{{L}}0-9])"
                  rf"|\(c\)[^\n\p{{L}}0-9]*+(?!(?:{_NO_SIGN})(?![\p{{L}}0-9]))[\p{{L}}0-9]|©|all rights reserved)[^\n]*")
# The same rule line by line for SQL, whose patterns have no look-ahead: a line goes that has a sign, or that has a word
# after one of the starts and that word is none of running text.
_AFTER = r"([^\p{L}0-9]|$)"
SQL_SIGNED = r"^[^a-z0-9]*(copyright[^\p{L}0-9]*([0-9]|©|:|\(?c\))|©|all rights reserved)"
SQL_STARTS = (
    (r"^[^a-z0-9]*copyright[^\p{L}0-9]+",
     r"((also|and|are|disclaimer|doctrines|if|interest|laws?|licen[cs]es?|like|line|of|on|or|ownership|patent|permission"
     rf"|resulting|those|treaty|the (library|program|software)){_AFTER}"
     r"|(holder|owner|notice|statement)s?( *[^\p{L}0-9 :]| +[\p{L}0-9]| *$)|the[^\p{L}0-9]*$)"),
    (r"^[^a-z0-9]*\(c\)[^\p{L}0-9]*", rf"((representations|under|you|the licenses){_AFTER}|the[^\p{{L}}0-9]*$)"),
)


def spellings_for(known: dict[str, str]) -> list[tuple[str, str]]:
    """The pairs that matter for these texts: a word that no known text has, in
    either spelling, keeps any text that has it from matching."""
    words = " " + " ".join(re.sub(r"[^a-z0-9]+", " ", text.lower()) for text in known.values()) + " "
    return [(old, new) for old, new in SPELLINGS if f" {old} " in words or f" {new} " in words]


def canonical(text: Column, spellings: Iterable[tuple[str, str]] = SPELLINGS) -> Column:
    """Lower case, no copyright lines, words parted by one space, equal spellings, no punctuation."""
    x = F.lower(F.regexp_replace(text, r"\r\n?", "\n"))
    # A removed line leaves the next one's start in place, so neighbours go in the same pass.
    x = F.regexp_replace(x, COPYRIGHT_LINE, "")
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[\x00-\x2f\x3a-\x60\x7b-\x7f‐-―‘-‟•©]+", " ")), F.lit(" "))
    for old, new in spellings:
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(x)


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """(digest, license_id), one row per known licence text."""
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text"), spellings_for(known)), 256).alias("digest")).agg(
        F.min(F.substring_index("license_id", "#", 1)).alias("license_id"))


def whole_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the long licences, whose texts are not kept; for the spellings of ``KNOWN``."""
    return spark.createDataFrame([(d, name) for name, found in sorted(WHOLE.items()) for d in found], "digest string, license_id string")


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, text_col: str = "text") -> DataFrame:
    """Every row with ``canonical_digest`` and ``license_id`` (NULL where no
    known licence has the digest); same-named columns are replaced.

    NULL text counts as empty; a text with nothing left after normalising matches
    none; repeated rows stay; an empty table gives an empty result.  The known texts
    are broadcast: their number is the parameter's, whatever the input.  With the
    default ones go the digests of the long licences."""
    keep = [f"`{c}`" for c in docs.columns if c not in ("canonical_digest", "license_id")]
    form = canonical(text_or_empty(f"`{text_col}`"), spellings_for(known))
    hashed = docs.select(*keep, F.when(form != "", F.sha2(form, 256)).alias("canonical_digest"))
    names = known_digests(docs.sparkSession, known)
    if known == KNOWN:
        names = names.unionByName(whole_digests(docs.sparkSession))
    return hashed.alias("h").join(F.broadcast(names).alias("k"), F.col("h.canonical_digest") == F.col("k.digest"), "left") \
                 .select("h.*", "k.license_id")


def licence_report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text")


def oracle_sql(known: dict[str, str] = KNOWN) -> str:
    def form(x: str) -> str:
        x = f"lower(regexp_replace({x}, '\\r\\n?', chr(10), 'g'))"
        gone = " OR ".join([f"regexp_matches(l, '{SQL_SIGNED}')",
                            *(f"(regexp_matches(l, '{start}[\\p{{L}}0-9]') AND NOT regexp_matches(l, '{start}{word}'))"
                              for start, word in SQL_STARTS)])
        x = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT ({gone})), chr(10))"
        x = f"' ' || trim(regexp_replace({x}, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f‐-―‘-‟•©]+', ' ', 'g')) || ' '"
        for old, new in spellings_for(known):
            x = f"replace({x}, ' {old} ', ' {new} ')"
        return f"trim({x})"

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(known.items()))
    whole = ", ".join(f"('{d}', '{name}')" for name, found in sorted(WHOLE.items()) for d in found)
    more = f"UNION ALL SELECT * FROM (VALUES {whole}) w(digest, license_id)" if known == KNOWN else ""
    return f"""
WITH k AS (SELECT sha256({form('t')}) AS digest, min(split_part(id, '#', 1)) AS license_id FROM (VALUES {values}) v(id, t) GROUP BY 1
           {more}),
d AS (SELECT doc_id, {form("coalesce(text, '')")} AS f FROM documents),
h AS (SELECT doc_id, CASE WHEN f <> '' THEN sha256(f) END AS canonical_digest FROM d)
SELECT doc_id, canonical_digest, license_id FROM h LEFT JOIN k ON canonical_digest = digest
"""
