"""Readers and writers: labelled CSV in, metric / prediction / model tables out.

Writers partition by the columns the reference used as file names (approach, category,
kind, variant, date), so readers prune partitions instead of opening one file per name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import METRICS

# The strings pandas' CSV reader treats as missing by default.
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Column names of the metric tables on disk.
SINK_NAMES = {m: m.replace("_", " ") for m in METRICS} | {"train_size": "training size"}

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType,
                      na_values=PANDAS_NA) -> DataFrame:
    """CSV with a header row and a declared schema (no inference); quoted multi-line fields.

    Spark takes one ``nullValue``; every pandas missing-value word is mapped to null here.
    """
    df = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*na_values), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite",
              spaced_metric_names: bool = True, categories=None) -> None:
    """CSV sink; metric columns get the reference's spaced names (``f1 macro``,
    ``training size``) here only.

    With ``categories`` the rows are written in category order (the only place an order
    matters); the sort runs inside each output partition, not as a global sort.
    """
    out = df
    if categories is not None and "category" in df.columns:
        ordinal = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
        # the partition columns first: the writer would sort by them again and lose the rest
        out = out.sortWithinPartitions(*partition_by, ordinal,
                                       *[c for c in ("fold", "train_size") if c in df.columns])
    if spaced_metric_names:
        out = out.select(*[F.col(c).alias(SINK_NAMES.get(c, c)) for c in df.columns])
    (out.write.mode(mode).options(**CSV_OPTIONS).options(**_replacing(partition_by))
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .partitionBy(*partition_by).csv(path))


def _replacing(partition_by) -> dict:
    """Overwriting replaces the partitions that are written and leaves the others as they are
    (one category's run keeps the rest); a table without partitions is replaced whole. New files
    are moved in when the job commits, which Spark marks with ``_SUCCESS``."""
    return {"partitionOverwriteMode": "dynamic"} if partition_by else {}


def read_metrics_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reads a metric CSV written by ``write_csv`` back to snake-case columns."""
    spaced = T.StructType([T.StructField(SINK_NAMES.get(f.name, f.name), f.dataType, f.nullable)
                           for f in schema.fields])
    back = {v: k for k, v in SINK_NAMES.items()}
    df = spark.read.schema(spaced).options(**CSV_OPTIONS).option("basePath", path).csv(path)
    return df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])


def write_predictions(df: DataFrame, path: str,
                      partition_by=("approach", "kind", "category", "variant", "run_date"),
                      mode: str = "overwrite") -> None:
    """Prediction tables as gzip parquet, partitioned like the reference's file names."""
    (df.write.mode(mode).option("compression", "gzip").options(**_replacing(partition_by))
     .partitionBy(*partition_by).parquet(path))


def read_predictions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def save_table_model(weights: DataFrame, bias: DataFrame, path: str, partition_by=("category",)) -> None:
    """A bag-of-words model (weights + bias tables) as parquet, one folder per model key."""
    parts = [c for c in partition_by if c in weights.columns]
    weights.write.mode("overwrite").options(**_replacing(parts)).partitionBy(*parts).parquet(f"{path}/weights")
    bias.write.mode("overwrite").parquet(f"{path}/bias")


def load_table_model(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/bias")


def read_review_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw review reports, one file per review: ``(doc_id, path, text)``.

    Each file is read whole (``wholetext``), so a review is one row whatever its line
    structure; ``doc_id`` is a stable 64-bit hash of the file path.
    """
    df = spark.read.text(path, wholetext=True)
    p = F.input_file_name()
    return df.select(F.xxhash64(p).alias("doc_id"), p.alias("path"), F.col("value").alias("text"))
