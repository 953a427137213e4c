"""Review prevalence as a Structured Streaming job.

New review files are read as they arrive; each micro-batch goes through the same batch
operators (language gate, cleaning, sentence split, scoring, share per review). A review
is one input row, so all its sentences are in the same micro-batch and the per-review
shares are exact without streaming state. Each batch is written to its own ``batch_id``
partition with dynamic overwrite, so a replayed batch (after a failure) replaces its
output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lang as LG
from ..operators import prevalence as PV
from ..operators import sentences as SO

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def review_source(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def batch_prevalence(docs: DataFrame, weights: DataFrame, bias: DataFrame, categories) -> DataFrame:
    en, _ = LG.language_gate(docs.select("doc_id", "text"))
    sents = SO.sentences(SO.clean_documents(en))
    return PV.prevalence(PV.score_sentences(sents, weights, bias, categories))


def start_prevalence_stream(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str,
                            weights: DataFrame, bias: DataFrame, categories,
                            trigger_available_now: bool = True, max_files_per_trigger: int | None = None):
    """Starts the query; returns the ``StreamingQuery``. ``checkpoint`` must be shared storage."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = batch_prevalence(batch, weights, bias, categories).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    w = (review_source(spark, source_path, max_files_per_trigger=max_files_per_trigger)
         .writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint))
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
