"""Documents as files: discovery, checks, hashes, and pages through any decoder.

A file that can't be used never fails the job: it has ``status`` ``failed`` and an ``error_message``, and no pages.
Spark's reader leaves empty files out, so these have no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 100 << 20
PAGES = "document_id string, page_number int, text string, extract_error string"


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row a file below a folder: document_id, filename, file_path, file_size_bytes, file_hash, title, status, error_message, content.

    document_id comes from the content, so the same bytes under two names are one document.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    digest = F.sha2("content", 256)
    error = F.when(F.col("length") > max_bytes, "the file is too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "the file is no PDF")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), r"^\d+[-_\s]*", ""), "[-_]+", " ")
    return files.select(
        F.concat(F.lit("doc_"), F.left(digest, F.lit(16))).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes"), digest.alias("file_hash"),
        F.initcap(F.trim(stem)).alias("title"), F.when(error.isNull(), "pending").otherwise("failed").alias("status"), error.alias("error_message"), "content",
    )


def new_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """One file for each content that no stored document has, the first by path."""
    first = found.groupBy("file_hash").agg(F.min("file_path").alias("file_path"))
    return found.join(first, ["file_hash", "file_path"], "left_semi").join(stored.where("file_hash is not null").select("file_hash"), "file_hash", "left_anti").select(*found.columns)


def pages_of(files: DataFrame, decode: Callable[[bytes], list[str]], max_pages: int = 0) -> DataFrame:
    """The pages of all usable files.  decode: the texts of a file's pages; an error gives one empty page that states it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, content in zip(pdf["document_id"], pdf["content"]):
                try:
                    texts = decode(bytes(content))
                    rows += [(key, n, t, None) for n, t in enumerate(texts[: max_pages or None], 1)]
                except Exception as error:  # a decoder may fail in any way; the job goes on
                    rows.append((key, 1, "", str(error)))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "text", "extract_error"])

    return files.where("status = 'pending'").select("document_id", "content").mapInPandas(run, PAGES)


def plain_text(content: bytes) -> list[str]:
    """A decoder for PDF files whose page streams are not compressed: the strings that each stream shows, a line for each."""
    import re

    pages = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*Tj", stream)
        if shown:
            pages.append("\n".join(re.sub(rb"\\(.)", rb"\1", s).decode("latin-1") for s in shown))
    if not pages:
        raise ValueError("the file has no page with text")
    return pages
