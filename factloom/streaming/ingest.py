"""Folding pages into the store as they arrive.

Every micro-batch writes its facts, issues and pages under its own batch number, so that a batch that runs twice after a
failure leaves the same rows once; relationships are rebuilt from all facts when asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.compare import compare_all
from factloom.operators.extract import facts_and_issues, read_pages
from factloom.operators.pages import canonical_pages
from factloom.operators.profile import profile_documents

PAGES = "document_id string, page_number int, text string"


def fold_in_pages(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over the page files of a folder that ends when all present files are read.

    A file holds whole documents, since a document's subject and period are learned from its own pages.
    """

    def fold(batch: DataFrame, number: int) -> None:
        pages = canonical_pages(batch)
        facts, issues = facts_and_issues(read_pages(pages, profile_documents(pages)))
        for name, rows in (("pages", pages), ("facts", facts), ("issues", issues)):
            rows.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")

    stream = spark.readStream.schema(PAGES).parquet(incoming)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store."""
    return spark.read.parquet(f"{store}/{name}").drop("batch")


def relationships(spark: SparkSession, store: str) -> DataFrame:
    """The relationships of all stored facts."""
    return compare_all(stored(spark, store, "facts"))
