"""Page text into stable lines, and what can be read off lines alone, as native expressions on one page at a time.

Null texts give null, empty ones the empty text; nothing here shuffles.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.normalise import clean

# A short line, the share of the usual width from which a line runs on, the quantile of that width, and the share of capitals of a heading.
SHORT, RUNS_ON, QUANTILE, CAPITALS, PROFILE_PAGES, MIN_PAGE = 45, 0.72, 0.9, 0.6, 25, 20
# Ends of sentences, bullets and lines that open with a figure.
SENTENCE_END = r"[.!?:;][\"'’”\)]?$"
BULLET = r"^\s*(?:[-•‣▪*·]|\(?\d{1,2}[.)]|[a-z][.)])\s+"
FIGURE = r"^\s*[-−(]?\s*(?:US\$|Rs\.?|INR|USD|EUR|GBP|[₹$€£¥])?\s*\d"
LEADER_LINE = r"(?i)(?:\.{3,}|…{2,}|_{3,}|-{4,})\s*(?:[ivxlcdm]+|\d+)\s*$"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip_controls(text: Column) -> Column:
    """A text in composed form without control and format characters; the composing runs in Arrow batches."""
    return clean(_composed(text))


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks, tabs and no-break spaces as one blank."""
    return F.regexp_replace(text, "[ \t ]+", " ")


def trimmed_lines(text: Column) -> Column:
    """The lines of a text without blanks around them."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", ""))


def wrap_width(lines: Column) -> Column:
    """The usual full width of a page's lines: a quantile of those longer than ten characters."""
    long = F.array_sort(F.filter(F.transform(lines, F.length), lambda n: n > 10))
    return F.coalesce(F.get(long, F.least(F.floor(F.size(long) * QUANTILE).cast("int"), F.size(long) - 1)), F.lit(SHORT)).cast("double")


def is_heading(line: Column) -> Column:
    """Whether a line reads as a heading: two words or more, mostly capital, without the end of a sentence."""
    words = F.regexp_extract_all(line, F.lit(r"([A-Za-z][A-Za-z'-]*)"), 1)
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return ~line.rlike(SENTENCE_END) & (F.size(words) >= 2) & (capital >= F.size(words) * CAPITALS)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reflow(text: Column) -> Column:
    """Lines that a page's width broke are joined into paragraphs, words broken at such a place too; other lines stay.

    Whether a line runs on hangs on itself and the line before only, so no fold over the page is needed.
    """

    def joins(lines: Column, floor: Column, i: Column) -> Column:
        line, before = F.get(lines, i), F.coalesce(F.get(lines, i - 1), F.lit(""))
        runs = (line != "") & (before != "") & (F.length(before) >= floor) & ~before.rlike(SENTENCE_END) & ~is_heading(before) & ~line.rlike(BULLET) & ~((F.length(line) < SHORT) & line.rlike(FIGURE))
        return F.when((i > 0) & runs, F.when(before.endswith("-") & line.rlike(r"^[\p{Ll}\d]"), "").otherwise(" "))

    def joined(lines: Column, marks: Column) -> Column:
        cut = lambda x, i: F.concat(F.coalesce(F.get(marks, i), F.lit("\n")), F.when(F.get(marks, i + 1) == "", F.regexp_replace(x, "-$", "")).otherwise(x))
        return F.regexp_replace(F.array_join(F.filter(F.transform(lines, cut), lambda x: x != "\n"), ""), r"^\n", "")

    def paragraphs(lines: Column) -> Column:
        return let(wrap_width(lines) * RUNS_ON, lambda floor: let(F.transform(lines, lambda x, i: joins(lines, floor, i)), lambda marks: joined(lines, marks)))

    return let(trimmed_lines(collapse_blanks(clean(text))), paragraphs)


def canonical_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with reflowed text, its length and whether it is empty, beside their other columns."""
    out = pages.withColumn(text, reflow(F.col(text)))
    return out.withColumn("char_length", F.length(text)).withColumn("is_empty", F.coalesce(F.trim(F.col(text)) == "", F.lit(True)))


def lines_with_offsets(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no (from 0), line, line_start, prev_line and next_line, without blank lines; neighbours are the lines that stay."""
    def kept_lines(lines: Column) -> Column:
        sizes = lambda ns: F.transform(ns, lambda n, i: F.aggregate(F.slice(ns, 1, i), F.lit(0), lambda a, b: a + b))
        starts = let(F.transform(lines, lambda x: F.length(x) + 1), sizes)
        return let(starts, lambda at: F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.get(at, i).alias("line_start"))), lambda x: F.trim(x["line"]) != ""))

    kept = let(F.split(F.col(text), "\n", -1), kept_lines)
    with_kept = pages.where(F.col(text).isNotNull()).select(*keys, kept.alias("_kept"))
    return with_kept.select(*keys, F.posexplode("_kept").alias("line_no", "_x"), "_kept").select(
        *keys, "line_no", F.col("_x.line").alias("line"), F.col("_x.line_start").alias("line_start"),
        F.coalesce(F.get("_kept", F.col("line_no") - 1)["line"], F.lit("")).alias("prev_line"), F.coalesce(F.get("_kept", F.col("line_no") + 1)["line"], F.lit("")).alias("next_line"),
    )


def table_cells(line: Column) -> Column:
    """The cells of a line that reads as a row of a table, else the line alone."""
    number = r"[-−(]?\s*[\d,]+(?:\.\d+)?%?\)?"
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    header = line.rlike(r"(?i)(?:Q[1-4]\s*(?:FY\d{2,4})?|FY\d{2,4}|YoY|QoQ|H[1-2])") & (F.size(words) >= 3)
    wide = F.filter(F.split(line, r"\s{2,}|\t"), lambda w: w != "")
    numbers = F.size(F.regexp_extract_all(line, F.lit(f"({number})"), 1)) >= 3
    row = rf"^(.*?)((?:\s+{number})+)$"
    label, values = F.trim(F.regexp_extract(line, row, 1)), F.split(F.trim(F.regexp_extract(line, row, 2)), r"\s+")
    cells = F.when(label == "", values).otherwise(F.concat(F.array(label), values))
    return F.when(header, F.when(F.size(wide) >= 3, wide).otherwise(words)).when(numbers & line.rlike(row), cells).when(numbers, wide).otherwise(F.array(line))


def table_blocks(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, block_no, is_table, first line and the number of rows of each block: runs of two rows or more are tables."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), (F.size(table_cells(x)) >= 3).alias("row")))
    row = lambda xs, i: F.coalesce(F.get(xs, i)["row"], F.lit(False))
    paired = let(marked, lambda xs: F.transform(xs, lambda x, i: F.struct(x["line"].alias("line"), (x["row"] & (row(xs, i - 1) | row(xs, i + 1))).alias("row"))))
    opens = let(paired, lambda xs: F.filter(F.transform(xs, lambda x, i: F.struct(i.alias("first_row"), x["row"].alias("is_table"), x["line"].alias("first_line"), (~(x["row"] & row(xs, i - 1))).alias("opens"))), lambda x: x["opens"]))
    # a block ends where the next one opens, the last one with the page
    sized = let(opens, lambda xs: F.transform(xs, lambda x, i: F.struct(x["first_row"].alias("first_row"), x["is_table"].alias("is_table"), x["first_line"].alias("first_line"), F.get(xs, i + 1)["first_row"].alias("next"))))
    each = pages.where(F.col(text).isNotNull()).select(*keys, F.size(lines).alias("_n"), F.inline(sized))
    return each.select(*keys, "first_row", "is_table", "first_line", (F.coalesce("next", "_n") - F.col("first_row")).alias("rows"))
