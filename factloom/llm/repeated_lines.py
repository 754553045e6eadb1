"""Lines that recur within one source, found by a fixed-depth token tree and checked letter by letter.

The lower-cased letters of a line are cut into tokens of a fixed width, so that lines of equal letters have equal tokens
however they are spaced, numbered or marked.  A tree of fixed depth parts lines by their source, the number of their
letters and their first ``DEPTH`` tokens; what follows is a wildcard slot of the leaf's template.  Every task counts its
own leaves, the trees are merged by path, and leaves that cover too few pages are cut: no line in them can recur often
enough.  Within the leaves that are left an exact count of pages for each sequence of letters decides.

Null sources, pages and texts are left out; a repeated page counts once; blank lines and lines with fewer than
``min_letters`` letters are never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.joins import lookup_join
from factloom.plans.staging import Stage

#: Tokens on the way to a leaf and their width in letters.
DEPTH, WIDTH = 3, 5
#: Tasks over which the lines of one leaf are spread where leaves are looked up by a shuffle.
SALTS = 8


def letters(line: Column) -> Column:
    """The letters of a line, lower-cased, everything else dropped."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def template(letter_sequence: Column) -> Column:
    """The path to a line's leaf: the number of its letters, its first tokens and a wildcard slot for the rest."""
    tokens = [F.substring(letter_sequence, 1 + i * WIDTH, WIDTH) for i in range(DEPTH)]
    return F.concat_ws(" ", F.length(letter_sequence).cast("string"), *tokens, F.lit("*"))


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """line_no (from 1) and line for each line of each page, blank ones included."""
    return pages.select("*", F.posexplode(F.split(text, "\n", -1)).alias("_pos", "line")).withColumn("line_no", (F.col("_pos") + 1).cast("int")).drop("_pos", text)


def merged_leaves(lines: DataFrame, source: str, page: str) -> DataFrame:
    """source, template and the number of pages of every leaf of the merged trees."""
    own = lines.select(source, "template", page).distinct()
    return own.groupBy(source, "template").agg(F.count("*").alias("pages"))


def repeated_lines(pages: DataFrame, source: str, page: str, text: str = "text", min_letters: int = 15, min_pages: int = 5, min_share: float = 0.05) -> DataFrame:
    """source, page, line_no and line of each line on at least ``min_pages`` pages and ``min_share`` of its source's pages."""
    stage = Stage(pages.sparkSession, "lines")
    once = stage.cut(pages.select(source, page, text).where(F.col(source).isNotNull() & F.col(page).isNotNull()).dropDuplicates([page]), "pages")
    sizes = once.groupBy(source).agg(F.count("*").alias("_of"))
    wide = lambda counted: lookup_join(counted.where(F.col("pages") >= min_pages), sizes, source, "inner", salts=SALTS).where(F.col("pages") >= F.col("_of") * min_share)
    lines = page_lines(once.where(F.col(text).isNotNull()), text).withColumn("letters", letters(F.col("line"))).where(F.length("letters") >= min_letters).withColumn("template", template(F.col("letters")))
    leaves = stage.cut(wide(merged_leaves(lines, source, page)).select(source, "template"), "leaves")
    kept = stage.cut(lookup_join(lines, leaves, [source, "template"], "left_semi", salts=SALTS).select(source, page, "line_no", "line", F.md5("letters").alias("key")), "kept")
    exact = kept.select(source, "key", page).distinct().groupBy(source, "key").agg(F.count("*").alias("pages"))
    return lookup_join(kept, stage.cut(wide(exact).select(source, "key"), "found"), [source, "key"], "left_semi", salts=SALTS).select(source, page, "line_no", "line")


def without_lines(pages: DataFrame, found: DataFrame, page: str, text: str = "text") -> DataFrame:
    """Each page once, with the found lines taken out; pages of which nothing is left keep an empty text."""
    once = pages.where(F.col(page).isNotNull()).dropDuplicates([page])
    numbers = found.groupBy(page).agg(F.collect_set("line_no").alias("_out"))  # the lines of one page
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_out", (i + 1).cast("int")))
    return once.join(numbers, page, "left").withColumn(text, F.when(F.col("_out").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_out")
