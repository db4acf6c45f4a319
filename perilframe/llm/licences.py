"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, copyright lines left out, punctuation left out, equivalent spellings
made one, white space made single. Its digest is joined with the digests of known licence texts, a table of fixed size
that is broadcast. Each line is looked up the same way among short notices ("Released under the MIT License."), which
name a licence without its text.

Defined results: a null text counts as empty; an empty text, and one of copyright lines only, matches nothing; repeated
rows give equal rows; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilframe.llm.licence_texts import FORMS, LICENCES, NAMES, SPELLINGS, TITLES

#: A line that only states who holds the rights.
COPYRIGHT_LINE = (r"(?m)^[ \t#*/;%-]*(?:copyright[ \t]*(?:\(c\)|©|:|by\b|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)"
                  r"[^\n]*$")
#: Everything but letters of any script, digits and white space.
PUNCTUATION = r"[^\p{L}\p{N} \t\n\x0b\x0c\r]+"


def canonical_text(text: str) -> str:
    """The canonical form of one text; for the known licences, and for tests."""
    import regex

    bare = regex.sub(PUNCTUATION, "", regex.sub(COPYRIGHT_LINE, "", text.lower()))
    return " ".join(SPELLINGS.get(word, word) for word in re.split(r"[ \t\n\x0b\x0c\r]+", bare) if word)


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


@lru_cache(maxsize=1)
def known_licences() -> dict[str, str]:
    return ({digest(text): name for name, text in LICENCES.items()}
            | {digest(f"{title}\n\n{LICENCES[name]}"): name for name, title in TITLES.items()})


@lru_cache(maxsize=1)
def known_notices() -> dict[str, str]:
    return {digest(form.format(spelled)): name for name, spellings in NAMES.items() for spelled in spellings
            for form in FORMS}


def _canonical(text: Column) -> Column:
    """The canonical form with built-in functions. Words are looked up in a hash set before they are replaced."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), PUNCTUATION, "")
    words = F.filter(F.split(bare, "[ \\t\\n\\x0b\\x0c\\r]+"), lambda word: word != "")
    spelled = F.create_map(*[F.lit(part) for pair in SPELLINGS.items() for part in pair])
    one = F.transform(words, lambda word: F.when(word.isin(*SPELLINGS), F.element_at(spelled, word)).otherwise(word))
    return F.array_join(one, " ")


def _bare(line: Column) -> Column:
    """Lower case, without punctuation, white space made single."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), PUNCTUATION, ""), "[ \\t\\n\\x0b\\x0c\\r]+", " ")


def scanned(df: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, licence, notices`` per row: the licence the whole text is, and those its lines name.

    ``texts`` (``licence, text``) adds licences to the known ones, which win where digests are equal.
    """
    rows = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    notices = known_notices()
    named = F.create_map(*[F.lit(part) for pair in notices.items() for part in pair])
    # A notice is short: the longest known form bounds the lines that can match one.
    longest = max(len(form.format(spelled)) for spellings in NAMES.values() for spelled in spellings for form in FORMS)
    # White space counts as single, and words are looked for without punctuation, as in the canonical form.
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("\\S") & F.exists(F.array(_bare(line)), lambda bare: (
        F.length(bare) <= 2 * longest) & bare.rlike(HINT)))
    found = F.array_intersect(F.transform(lines, lambda line: F.sha2(_canonical(line), 256)),
                              F.array(*[F.lit(key) for key in notices]))
    made = rows.select(
        "doc_id", F.sha2(_canonical(F.col("text")), 256).alias("digest"),
        F.sort_array(F.array_distinct(F.transform(found, lambda key: F.element_at(named, key)))).alias("notices"))
    licences = df.sparkSession.createDataFrame(list(known_licences().items()), T.StructType([
        T.StructField("digest", T.StringType()), T.StructField("licence", T.StringType())]))
    if texts is not None:
        more = texts.select(F.sha2(_canonical(F.col("text")), 256).alias("digest"), "licence").join(
            F.broadcast(licences.select("digest")), "digest", "left_anti").groupBy("digest").agg(F.min("licence").alias("licence"))
        return made.join(licences.unionByName(more), "digest", "left").select("doc_id", "digest", "licence", "notices")
    # A fixed table of a few rows.
    return made.join(F.broadcast(licences), "digest", "left").select("doc_id", "digest", "licence", "notices")


#: Each notice has one of these words, so other lines cannot match one.
HINT = "released|licen[cs]e|distributed"


def oracle() -> str:
    def values(table: dict[str, str]) -> str:
        return ", ".join(f"('{key}', '{name}')" for key, name in table.items())

    spelled = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items()) + "}"
    line = COPYRIGHT_LINE.replace("(?m)", "")

    def canonical(text: str) -> str:
        bare = (f"regexp_replace(regexp_replace(lower({text}), '(?m){line}', '', 'g'), "
                f"'{PUNCTUATION}', '', 'g')")
        words = rf"list_filter(regexp_split_to_array({bare}, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '')"
        return f"coalesce(list_aggregate(list_transform({words}, lambda w: coalesce(s[w], w)), 'string_agg', ' '), '')"

    return rf"""
WITH known(digest, licence) AS (VALUES {values(known_licences())}),
notice(digest, name) AS (VALUES {values(known_notices())}),
spelling AS (SELECT {spelled} AS s),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT rid, doc_id, sha256({canonical('text')}) AS digest FROM docs, spelling),
lines AS (
  SELECT rid, sha256({canonical('line')}) AS digest
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs), spelling
),
named AS (SELECT rid, list_sort(list(DISTINCT name)) AS notices FROM lines JOIN notice USING (digest) GROUP BY rid)
SELECT doc_id, digest, licence, coalesce(notices, []) AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN named USING (rid)"""
