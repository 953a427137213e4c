"""Fitted bag-of-words models by key: one folder per (approach, category, fold).

A model is its weights (``token, weight``) and one row of the manifest (``bias, n_weights``).
Saving replaces the models that are saved and no others; loading reads the folders of the
models asked for. A row of the manifest is written after the weights it counts, so a model
whose save was cut short is seen as missing or incomplete, never used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("approach", "category", "fold")
WEIGHTS = "token string, weight double, approach string, category string, fold int"
MANIFEST = "bias double, n_weights long, approach string, category string, fold int"


def save(weights: DataFrame, bias: DataFrame, path: str) -> None:
    """``weights (approach, category, fold, token, weight)`` and ``bias (approach, category, fold, bias)``
    of any number of models, in one job each."""
    _write(weights.select("token", "weight", *KEYS), f"{path}/weights")
    written = weights.sparkSession.read.schema(WEIGHTS).parquet(f"{path}/weights")
    counted = written.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_weights"))
    rows = (bias.select("bias", *KEYS).join(counted, list(KEYS), "left")
            .select("bias", F.coalesce("n_weights", F.lit(0).cast("long")).alias("n_weights"), *KEYS))
    _write(rows, f"{path}/manifest")


def _write(df: DataFrame, path: str) -> None:
    (df.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*KEYS).parquet(path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(approach, category, fold, bias, n_weights)``: the models that are there."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select(*KEYS, "bias", "n_weights")


def load(spark: SparkSession, path: str, keys: list[tuple[str, str, int]]):
    """``(weights, bias)`` of the models ``keys``; only their folders are read. Raises KeyError for a
    model that is missing or incomplete."""
    wanted = F.lit(False)
    for key in keys:
        one = F.lit(True)
        for column, value in zip(KEYS, key):
            one = one & (F.col(column) == F.lit(value))
        wanted = wanted | one
    weights = spark.read.schema(WEIGHTS).parquet(f"{path}/weights").where(wanted).select(*KEYS, "token", "weight")
    found = manifest(spark, path).where(wanted)
    stored = {tuple(r): n for *r, n in weights.groupBy(*KEYS).count().collect()}
    listed = {(r["approach"], r["category"], r["fold"]): r["n_weights"] for r in found.collect()}  # a row a model
    bad = [k for k in keys if k not in listed or listed[k] != stored.get(k, 0)]
    if bad:
        raise KeyError(f"no whole model for {bad}")
    return weights, found.select(*KEYS, "bias")
