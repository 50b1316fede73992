"""Quality rules: line-first cleaning.

Rules on punctuation, navigation and boilerplate look at each line; lines that fail are
removed, and a document that loses too large a share of its words is rejected. All of it is
DataFrame functions inside one scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
# Phrases of site furniture, in lower case.
BOILERPLATE = [
    "all rights reserved", "click here", "cookie policy", "cookies to improve", "enable javascript", "follow us on", "licensed under",
    "log in to", "lorem ipsum", "powered by", "privacy policy", "share this", "sign up for", "skip to content", "terms of service", "terms of use",
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when the lines that stay hold less than this share of its words.
MIN_KEPT_SHARE = 0.5
#: Words of a line that may carry a symbol or be a menu separator, as a share; characters that may be capitals.
MAX_SYMBOL_SHARE, MAX_SEPARATOR_SHARE, MAX_CAPITAL_SHARE = 0.2, 0.2, 0.4
SEPARATORS = "|»›>·•/"
#: A line of so many words or more must have some sentence mark; longer ones are no site furniture.
LONG_LINE_WORDS, FURNITURE_WORDS = 30, 40
#: Repeated windows that are searched one by one.
SHORT = 64


def words_of(text: Column) -> Column:
    """The runs of other characters than [\\x20\\x09-\\x0D]."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that are found twice or more.

    Most texts have no two windows with one 64-bit hash, and need no more. Else the places
    whose hash repeats are taken, their windows sorted with the places, equal neighbours
    kept, and the words covered counted without counting one twice.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def counted(h: Column) -> Column:
        again = let(F.sort_array(h), lambda o: F.array_distinct(F.filter(o, lambda x, i: x == F.get(o, i - 1))))
        # a short list is searched for each place; where much repeats, all windows are sorted
        places = let(again, lambda r: F.when(F.size(r) <= SHORT, F.filter(starts, lambda i: F.array_contains(r, F.get(h, i)))).otherwise(starts))
        placed = F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
        twice = let(
            placed,
            lambda p: F.sort_array(
                F.transform(F.filter(p, lambda x, i: (x["w"] == F.get(p, i + 1)["w"]) | (x["w"] == F.get(p, i - 1)["w"])), lambda x: x["i"])
            ),
        )
        return let(
            twice,
            lambda t: F.aggregate(F.transform(t, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(t, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x),
        )

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), counted(h)).otherwise(F.lit(0)))
    return F.when(n < 4, F.lit(0)).otherwise(some).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    spoken = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long"),
        "n_dup_lines": let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def line_fault(line: Column) -> Column:
    """Name of the first rule that the line fails, or null.

    navigation: menu separators between words; punctuation: too many words with symbols, a line in capitals, or a long
    line without a sentence mark; boilerplate: a phrase of site furniture. Cheap tests of the whole line come first, so
    that few lines are cut into words.
    """
    has = lambda marks: F.rlike(line, F.lit(f"[{marks}]"))
    n = F.size(words_of(line))
    over = lambda rule, most: let(words_of(line), lambda w: (F.size(w) >= 3) & (F.size(F.filter(w, rule)) > F.size(w) * F.lit(most)))
    capitals = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    small = F.lower(line)
    phrases = F.lit(False)
    for phrase in BOILERPLATE:
        phrases = phrases | F.contains(small, F.lit(phrase))
    return (
        F.when(has(SEPARATORS) & over(lambda w: w.isin(*SEPARATORS), MAX_SEPARATOR_SHARE), "navigation")
        .when(has(SYMBOLS) & over(lambda w: F.rlike(w, F.lit(f"[{SYMBOLS}]")), MAX_SYMBOL_SHARE), "punctuation")
        .when((capitals > F.lit(MAX_CAPITAL_SHARE) * F.length(line)) & (n >= 5), "punctuation")
        .when(~has(".!?…;:") & (n >= LONG_LINE_WORDS), "punctuation")
        .when(phrases & (n <= FURNITURE_WORDS), "boilerplate")
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, then the base columns and what the line rules find.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed;
    line_faults map<rule, lines that failed it>, kept_words (words of the lines that stay),
    clean_text (those lines, joined), kept. A null text has no words and fails; an empty one
    too. Columns of docs with one of these names are replaced. Rows are judged each by
    itself, so repeated rows and ids get equal results.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_faults", "kept_words", "clean_text", "kept"}
    own = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col("_d")[text_col], F.lit(""))
    d = docs.select(F.struct(*own).alias("_d")).withColumn("_words", words_of(text))
    d = d.select("_d", *[c.alias(k) for k, c in base_columns(text, F.col("_words")).items()])
    judged = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), line_fault(x).alias("fault")))
    d = d.withColumn("_lines", judged)
    good = F.filter("_lines", lambda x: x["fault"].isNull())
    bad = F.filter("_lines", lambda x: x["fault"].isNotNull())
    count = lambda rule: F.size(F.filter("_lines", lambda x: x["fault"] == rule))
    d = d.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.when(F.size(bad) > 0, F.create_map(*[x for rule in ("punctuation", "navigation", "boilerplate") for x in (F.lit(rule), count(rule))])).alias("line_faults"),
        F.when(F.size(bad) == 0, text).otherwise(F.array_join(F.transform(good, lambda x: x["line"]), "\n")).alias("clean_text"),
    )
    d = d.withColumn("kept_words", F.when(F.col("line_faults").isNull(), F.col("n_words")).otherwise(F.size(words_of(F.col("clean_text")))).cast("long"))
    kept = ~F.col("base_failed") & (F.col("kept_words") >= MIN_KEPT_SHARE * F.col("n_words"))
    return d.select(*[F.col("_d")[c].alias(c) for c in own], *[c for c in d.columns if c[0] != "_"], kept.alias("kept"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words"
    )


_WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_PHRASES = " OR ".join(f"contains(small, '{p}')" for p in BOILERPLATE)
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(translate(coalesce(text, ''), {_WS}, repeat(' ', 6)), ' '), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c >= 2
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, list_filter(string_split(translate(line, {_WS}, repeat(' ', 6)), ' '), lambda x: x <> '') AS lw
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), counted AS (
  SELECT *, len(lw) AS n, lower(line) AS small, length(line) - length(regexp_replace(line, '\p{{Lu}}', '', 'g')) AS up FROM lines
), judged AS (
  SELECT doc_id, line, n, n > 0 AND (
      (n >= 3 AND len(list_filter(lw, lambda x: contains('{SEPARATORS}', x) AND length(x) = 1)) > n * {MAX_SEPARATOR_SHARE}::DOUBLE)
      OR (n >= 3 AND len(list_filter(lw, lambda x: translate(x, '{SYMBOLS}', '') <> x)) > n * {MAX_SYMBOL_SHARE}::DOUBLE)
      OR (n >= 5 AND up > {MAX_CAPITAL_SHARE}::DOUBLE * length(line))
      OR (n >= {LONG_LINE_WORDS} AND translate(line, '.!?…;:', '') = line)
      OR (n <= {FURNITURE_WORDS} AND ({_PHRASES}))) AS bad
  FROM counted
), by_doc AS (
  SELECT doc_id, sum(n) FILTER (WHERE NOT bad) AS kept_words, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(translate(t, {_WS}, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words
  FROM d JOIN by_doc b ON d.doc_id = b.doc_id LEFT JOIN repeats r ON d.doc_id = r.doc_id
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND kept_words >= {MIN_KEPT_SHARE}::DOUBLE * n_words AS kept
FROM base
"""
