"""Readers for the input tables and the small dimension tables around them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Categories of the labelled table used by the queries (columns of ``labels``), in order.
DEFAULT_CATEGORIES = ("quality", "toxic")
NONE_CATEGORY = "none"

LABELLED_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("doc_id", T.LongType(), True),
    T.StructField("sentence_pre", T.StringType(), True),
    T.StructField("sentence", T.StringType(), True),
    T.StructField("sentence_post", T.StringType(), True),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes columns and pushes filters into the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled_rows(spark: SparkSession, sf_dir: str, categories=DEFAULT_CATEGORIES) -> DataFrame:
    """The labelled table: one row per labelled document, wide 0/1 category columns.

    ``row_id`` is the source key (``doc_id``), never a generated position. The text is
    the whole document. Only ``doc_id`` and ``text`` are read from ``documents``.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", *categories)
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("sentence"))
    return (labels.join(docs, "doc_id", "inner")
            .select(F.col("doc_id").alias("row_id"), "doc_id", "sentence", *categories))


def category_dimension(spark: SparkSession, categories=DEFAULT_CATEGORIES,
                       with_none: bool = False) -> DataFrame:
    """``(ordinal, category)``; ``with_none`` puts ``none`` first with ordinal 0."""
    cats = list(categories)
    rows = [(i + 1, c) for i, c in enumerate(cats)]
    if with_none:
        rows = [(0, NONE_CATEGORY)] + rows
    return spark.createDataFrame(rows, "ordinal int, category string")
