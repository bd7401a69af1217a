"""Line-first quality cleaning in DataFrame functions alone.

Each line is judged by itself: punctuation (symbols, shouting, short lines without an end mark), navigation (lists
of short entries between separators) and boilerplate (stock phrases that make up much of the line, repeats of an
earlier line).  Failing lines are taken out, and a document is rejected when too much of its text went with
them.  Everything is one narrow projection over the text: no shuffle, no Python, and no state beyond one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import WHITE_SPACE, text_or_empty

#: Least number of words of a document, and the largest share (percent) of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line fails with more symbols than this per word, or a larger share of capitals among its letters (from MIN_CAPS letters on).
MAX_SYMBOLS_PER_WORD, MAX_CAPS, MIN_CAPS = 0.3, 0.7, 10
#: A line without an end mark fails when it is shorter than this in words and in characters (headings, menu entries, captions).
OPEN_WORDS, OPEN_CHARS = 10, 60
#: A line is navigation with this many separators and entries of so many words at most on average.
MIN_SEPARATORS, ENTRY_WORDS = 3, 5
#: A line is boilerplate when stock phrases make up this share of it.
STOCK_SHARE = 0.25
#: A document is rejected when more than this share of its word characters is in failing lines.
MAX_LOST = 0.4
SYMBOLS = "#*$%&|<>"
ENDS, CLOSERS = ".!?…:;。！？；：।۔", "\"'”’»)]}）」』"
SPACES = " \t\n\x0b\x0c\r"
SEPARATOR = r"[\x20\x09][|/»›·•>→-][\x20\x09]"
BOILERPLATE = r"(?i)\b(all rights reserved|terms (of use|of service|and conditions)|privacy policy|cookie(s)? (policy|settings)|accept (all )?cookies|(we|site) uses? cookies|enable javascript|click here|read more|sign (in|up)|log ?in|subscribe|newsletter|follow us|share (this|on)|lorem ipsum|skip to content)\b"


def let(value: F.Column, body) -> F.Column:
    """``body`` of ``value``, which is evaluated once (a reference inside a lambda would be inlined again and again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, WHITE_SPACE), "")


def has_word(line: F.Column) -> F.Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def repeat_words(words: F.Column) -> F.Column:
    """Words in 3-word windows that the text holds twice or more: windows sorted by hash, equal neighbours compared word by word."""

    def marked(ws):
        hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)))

        def covered(s):
            same = lambda a, b: (a["h"] == b["h"]) & (F.slice(ws, a["i"], 3) == F.slice(ws, b["i"], 3))
            pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(same(a, b), F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
            return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))).cast("long")

        def counted(hs):
            # Texts whose windows all differ, which are most, need no sorting.
            windows = F.transform(hs, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
            return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), covered))

        return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(hashes, counted))

    return let(words, marked)


def repeat_flags(lines: F.Column) -> F.Column:
    """For each line, whether an earlier one equals it; by sorting, so that many lines cost no square."""

    def flagged(s):
        marks = F.transform(s, lambda a, k: F.struct(a["i"].alias("i"), F.coalesce((k > 0) & (F.get(s, k - 1)["x"] == a["x"]), F.lit(False)).alias("again")))
        return F.transform(F.sort_array(marks), lambda a: a["again"])

    return let(F.sort_array(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), flagged)


def line_failures(line: F.Column) -> F.Column:
    """Whether one line fails by what it says itself."""
    words = F.size(words_of(line))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    capitals = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}+", ""))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    ended = F.substring(F.rtrim(line, F.lit(SPACES + CLOSERS)), -1, 1).isin(list(ENDS))
    separators = F.size(F.split(line, SEPARATOR)) - 1
    stock = F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))
    return (
        ((F.length(line) < OPEN_CHARS) & ~ended & (words < OPEN_WORDS))
        | ((symbols > 0) & (symbols > MAX_SYMBOLS_PER_WORD * words))
        # The first test only spares most lines the second pattern.
        | ((capitals > MAX_CAPS * MIN_CAPS) & (letters >= MIN_CAPS) & (capitals > MAX_CAPS * letters))
        | let(separators, lambda n: (n >= MIN_SEPARATORS) & (words <= ENTRY_WORDS * (n + 1)))
        | (stock >= STOCK_SHARE * F.length(line))
    )


def kept_lines(lines: F.Column) -> F.Column:
    """Those of ``lines`` that pass, in order.  Lines without a word stay as they are."""
    return let(lines, lambda ls: let(repeat_flags(ls), lambda again: F.filter(ls, lambda x, i: ~has_word(x) | ~(F.get(again, i) | line_failures(x)))))


def measured(rows: DataFrame) -> DataFrame:
    """``rows(row, text)`` with the measures of the text.  Words and lines are split once."""
    chars = lambda ls: F.length(F.regexp_replace(F.array_join(ls, "\n"), WHITE_SPACE, "")).cast("long")
    parts = rows.select("row", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    counted = parts.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        chars(kept_lines(F.col("lines"))).alias("kept_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 1 - F.col("kept_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    return counted.withColumn("base_failed", failed).withColumn("lost", lost).withColumn("kept", ~F.col("base_failed") & (F.col("word_chars") - F.col("kept_chars") <= MAX_LOST * F.col("word_chars")))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost.

    Words are ``[^\\x20\\x09-\\x0D]+``.  base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT percent of them in
    3-word windows found twice or more.  kept: not base_failed, and at most MAX_LOST of the word
    characters are in lines that fail.  Null and empty texts have no words and fail.  Repeated rows are judged
    alike; a null id is carried; an empty table gives an empty result; other columns are ignored.
    """
    found = measured(docs.select(F.col(id_col).alias("row"), text_or_empty(text_col).alias("text")))
    return found.select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "lost", "kept")


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each text reduced to its passing lines.

    Null stays null and an empty text empty; repeated rows are reduced alike; an empty table gives an empty
    result; all other columns are carried, whatever their names.
    """
    return docs.withColumn(text_col, F.array_join(kept_lines(F.split(F.col(f"`{text_col}`"), "\n")), "\n"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes (``kept`` of ``measure``), unchanged and with all their columns.

    Rows with a null or empty text go; repeated rows stay or go together; null ids don't matter; an
    empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(f"`{text_col}`").alias("text"))
    return measured(rows).where("kept").select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
), repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
         len(regexp_split_to_array(line, '[\x20\x09][|/»›·•>→-][\x20\x09]')) - 1 AS separators
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT doc_id, again, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    again
    OR (length(line) < 60 AND words < 10
        AND NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D"''”’»)\]}）」』]+$', ''), '[.!?…:;。！？；：।۔]$'))
    OR length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > 0.3 * words
    OR (length(regexp_replace(line, '[^\p{L}]+', '', 'g')) >= 10 AND length(regexp_replace(line, '[^\p{Lu}]+', '', 'g')) > 0.7 * length(regexp_replace(line, '[^\p{L}]+', '', 'g')))
    OR (separators >= 3 AND words <= 5 * (separators + 1))
    OR length(line) - length(regexp_replace(line, '(?i)\b(all rights reserved|terms (of use|of service|and conditions)|privacy policy|cookie(s)? (policy|settings)|accept (all )?cookies|(we|site) uses? cookies|enable javascript|click here|read more|sign (in|up)|log ?in|subscribe|newsletter|follow us|share (this|on)|lorem ipsum|skip to content)\b', '', 'g')) >= 0.25 * length(line) AS bad
  FROM lines
), per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, sum(chars) FILTER (WHERE bad) AS lost FROM judged GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(p.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(p.lost, 0) AS lost
  FROM d LEFT JOIN repeats r USING (doc_id) LEFT JOIN per_doc p USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.4 * word_chars AS kept
FROM base
"""
