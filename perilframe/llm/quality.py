"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

`measured` adds the figures of a text, `verdict` turns a rule table into one boolean column. No user function runs and
no row leaves its task, so the work is one pass over the input without a shuffle.

Defined results: a null text counts as empty; an empty text has all figures 0 and fails the base rule; equal rows get
equal figures; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns may have
any name; where there is a text column ``lang``, it tells to which rows the rule of function words applies. Eight-word windows are compared by a 64-bit hash of their words, within one text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with", "on", "as", "by", "from", "this",
    "are", "be", "or", "an", "at", "not", "have", "which",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "par", "sur", "au",
    "avec", "est", "pas",
    "der", "die", "das", "und", "ein", "eine", "ist", "den", "von", "zu", "mit", "im", "für", "auf", "nicht", "sich",
    "dem", "auch", "als",
    "el", "los", "las", "y", "del", "se", "con", "por", "una", "para", "es", "su", "al", "lo", "no",
)


#: The languages of the list, and the column that is true for rows known to be in none of them.
LANGUAGES = ("en", "fr", "de", "es")
OTHER_LANGUAGE = "_other_language"


def other_language(df: DataFrame, lang: Column) -> Column:
    """Where ``lang`` is null or names no language of the list; false without such a column."""
    if dict(df.dtypes).get("lang") != "string":
        return F.lit(False)
    return ~F.coalesce(F.regexp_extract(F.lower(lang), "^[a-z]+", 0).isin(*LANGUAGES), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A ratio of two figures, per cent, with the range a kept text must lie in."""

    name: str
    part: str
    whole: str
    at_least: float | None = None
    at_most: float | None = None
    #: The languages the rule knows; rows of other or unknown languages pass.
    languages: tuple[str, ...] = ()

    def holds(self) -> Column:
        """100 * part against bound * whole, in exact integers where bounds are whole numbers."""
        part, checks = 100 * F.col(self.part), []
        if self.at_least is not None:
            checks.append(part >= F.lit(self.at_least) * F.col(self.whole))
        if self.at_most is not None:
            checks.append(part <= F.lit(self.at_most) * F.col(self.whole))
        verdict = checks[0]
        for check in checks[1:]:
            verdict = verdict & check
        if self.languages:
            verdict = verdict | F.col(OTHER_LANGUAGE)
        return verdict

    def sql(self) -> str:
        checks = []
        if self.at_least is not None:
            checks.append(f"100 * {self.part} >= {self.at_least} * {self.whole}")
        if self.at_most is not None:
            checks.append(f"100 * {self.part} <= {self.at_most} * {self.whole}")
        return " AND ".join(checks)


#: The threshold table. Every ratio is in per cent.
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=150, at_most=1500),
    Rule("symbols", "n_symbols", "n_words", at_most=20),
    Rule("shouting", "n_marks", "n_words", at_most=50),
    Rule("stop_words", "n_stop_words", "n_words", at_least=2, languages=LANGUAGES),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=50),
    Rule("cut_lines", "n_cut_lines", "n_lines", at_most=50),
)

CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _long(column: Column) -> Column:
    return column.cast("long")


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the figures of ``text``.

    Each step below is read more than once by the next, so it is its own projection; Spark runs them in one task.
    """
    passed = [F.col(name) for name in keep]
    whole = df.select(*passed, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    trimmed = whole.withColumn("_bare", F.btrim("_text", F.lit(SPACES)))
    parts = trimmed.select(
        *passed, "_text",
        F.when(F.col("_bare") == "", F.array().cast("array<string>"))
        .otherwise(F.split("_bare", f"[{SPACES}]+")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
    )
    ones = parts.withColumn("_one", F.transform("_words", lambda word: F.xxhash64(word)))
    pairs = ones.withColumn("_two", _joined("_one", 1))
    fours = pairs.withColumn("_four", _joined("_two", 2))
    size = F.size("_words")
    windows = fours.withColumn("_eight", F.when(
        size >= WINDOW, F.slice(_joined("_four", 4), F.lit(1), size - (WINDOW - 1))
    ).otherwise(F.array().cast("array<long>")))
    # Places are sorted by window only in texts where some window occurs twice.
    twice = windows.withColumn("_placed", F.when(
        F.size(F.array_distinct("_eight")) < F.size("_eight"),
        F.sort_array(F.transform("_eight", lambda window, at: F.struct(window.alias("window"), at.alias("at"))))
    ).otherwise(F.array().cast("array<struct<window:bigint,at:int>>")))
    placed = twice.withColumn("_again", F.sort_array(F.transform(
        F.filter("_placed", lambda here, i: _same("_placed", i - 1, here) | _same("_placed", i + 1, here)),
        lambda here: here["at"])))
    return placed.select(
        *passed,
        _long(size).alias("n_words"),
        _long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        _long(F.regexp_count("_text", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.aggregate(
            F.transform("_again", lambda at, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get("_again", i + 1) - at, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, width: total + width).alias("n_repeat_words"),
        _long(F.regexp_count("_text", F.lit("!"))).alias("n_marks"),
        _long(F.size(F.filter("_words", lambda word: F.lower(word).isin(*STOP_WORDS)))).alias("n_stop_words"),
        _long(F.size("_lines")).alias("n_lines"),
        _long(F.size(F.filter("_lines", lambda line: F.rtrim(line).endswith("...")))).alias("n_cut_lines"),
    )


def _joined(hashes: str, step: int) -> Column:
    """Hash of each window and the window ``step`` places on; the tail, where none follows, is cut off later."""
    following = F.slice(F.col(hashes), F.lit(1 + step), F.greatest(F.size(hashes) - step, F.lit(0)))
    return F.zip_with(F.col(hashes), following, lambda first, second: F.xxhash64(first, second))


def _same(array: str, index: Column, here: Column) -> Column:
    other = F.when(index >= 0, F.get(array, index))
    return F.coalesce(other["window"] == here["window"], F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    kept = ~base_failed()
    for rule in rules:
        kept = kept & rule.holds()
    return kept


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Figures, ``base_failed``, ``kept`` and one boolean per rule."""
    marked = df.withColumn(OTHER_LANGUAGE, other_language(df, F.col("lang") if "lang" in df.columns else F.lit(None)))
    figures = measured(marked, keep=(*keep, OTHER_LANGUAGE))
    return figures.select(
        *[name for name in figures.columns if name != OTHER_LANGUAGE], base_failed().alias("base_failed"), verdict(rules).alias("kept"),
        *[rule.holds().alias(f"rule_{rule.name}") for rule in rules])


def kept(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df``, all columns, that pass."""
    whole = df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"))
    lang = F.col("row.lang") if "lang" in df.columns else F.lit(None)
    figures = measured(whole.select("row", F.col("row.text").alias("text"), other_language(df, lang).alias(OTHER_LANGUAGE)),
                       keep=("row", OTHER_LANGUAGE))
    # A column that depends on the row's place keeps the figures out of the filter, where the optimizer would write
    # them out once for every use.
    placed = figures.withColumn("place", F.monotonically_increasing_id())
    return placed.where(verdict(rules) & (F.col("place") >= 0)).select("row.*")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    stops = ", ".join(f"'{word}'" for word in STOP_WORDS)
    kept = " AND ".join(rule.sql() for rule in rules)
    gram = " || ' ' || ".join(["w", *[f"lead(w, {place}) OVER following" for place in range(1, WINDOW)]])
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), placed AS (
  SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM parts
), windows AS (
  SELECT rid, pos, {gram} AS gram FROM placed
  WINDOW following AS (PARTITION BY rid ORDER BY pos) QUALIFY gram IS NOT NULL
), again AS (
  SELECT rid, pos FROM windows QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n FROM again, unnest(range(0, 8)) AS v(k) GROUP BY rid
), figures AS (
  SELECT p.doc_id, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(regexp_extract_all(t, '!')) AS n_marks,
         len(list_filter(words, lambda w: lower(w) IN ({stops}))) AS n_stop_words,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda l: rtrim(l, ' ') LIKE '%...')) AS n_cut_lines
  FROM parts p LEFT JOIN covered c USING (rid)
), judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {kept}) AS kept
FROM judged"""
