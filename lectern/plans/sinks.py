"""Registered source/sink queries: write to the shared folder, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bayes as NB
from ..operators import metrics as M
from ..operators.ranking import materialize
from ..session import scratch_path
from ..sources import io as IO
from ..sources import model_store as MS
from ..sources import tables as ST
from . import models as MD
from . import splits as Q
from .registry import register

CATS = Q.CATS
RUN_DATE = "2024-11-25"  # run tag as a parameter, so reruns write the same partition

CSV_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("sentence_pre", T.StringType()), T.StructField("sentence", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@register("csv_roundtrip", """
SELECT l.doc_id AS row_id, l.doc_id, CAST(NULL AS VARCHAR) AS sentence_pre, d.text AS sentence,
       CASE WHEN l.quality = 0 THEN NULL ELSE 'ok' END AS note, l.quality, l.toxic
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")
def csv_roundtrip(spark, sf_dir):
    """Labelled table -> CSV (quoted multi-line text, a pandas NA word, a null) -> read back."""
    rows = ST.labelled_rows(spark, sf_dir, CATS).select(
        "row_id", "doc_id", F.lit(None).cast("string").alias("sentence_pre"), "sentence",
        F.when(F.col("quality") == 0, F.lit("NA")).otherwise(F.lit("ok")).alias("note"), *CATS)
    path = scratch_path(spark, "labelled-csv")
    IO.write_csv(rows, path, spaced_metric_names=False)
    return IO.read_labelled_csv(spark, path, CSV_SCHEMA)


_METRIC_SCHEMA = T.StructType([T.StructField(m, T.DoubleType()) for m in M.METRICS]
                              + [T.StructField("category", T.StringType())])


@register("metric_sink_roundtrip", MD.SQL_BIN + "," + MD.sql_metrics("bs", ["category"]))
def metric_sink_roundtrip(spark, sf_dir):
    """Test metrics written as CSV with the reference's column names, one folder per category."""
    metrics = MD.rounded(M.eval_metrics(MD.binary_scores(spark, sf_dir), ["category"]), M.METRICS)
    path = scratch_path(spark, "metrics-csv")
    IO.write_csv(metrics, path, partition_by=("category",), categories=CATS)
    return IO.read_metrics_csv(spark, path, _METRIC_SCHEMA)


def _metric_roundtrip(spark, metrics, name, extra=()):
    """Writes a metric table as one ordered CSV file per category and reads it back, with each
    row's place in its file (the sort has to survive the trip)."""
    path = scratch_path(spark, name)
    one = metrics.repartition("category")  # a category's few rows in one file
    IO.write_csv(one, path, partition_by=("category",), categories=CATS)
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in extra] + list(_METRIC_SCHEMA.fields))
    return IO.read_metrics_csv(spark, path, schema).withColumn("_at", F.monotonically_increasing_id())


def _placed(df, order):
    """``file_order_kept``: are a category's rows in ``order`` as they lie in the file?"""
    from pyspark.sql import Window
    by_file = F.row_number().over(Window.partitionBy("category").orderBy("_at"))
    by_key = F.row_number().over(Window.partitionBy("category").orderBy(order))
    return df.withColumn("file_order_kept", by_file == by_key).drop("_at")


def _with_flag(sql: str) -> str:
    return f"SELECT *, true AS file_order_kept FROM ({sql})"


@register("cv_sink_roundtrip", _with_flag(MD.SQL_CV + "," + MD.sql_metrics("cs", ["category", "fold"])))
def cv_sink_roundtrip(spark, sf_dir):
    """Per-fold metrics as CSV, one file per category in fold order."""
    metrics = MD.rounded(M.eval_metrics(MD.cv_scores(spark, sf_dir), ["category", "fold"]), M.METRICS)
    return _placed(_metric_roundtrip(spark, metrics, "cv-csv", ["fold"]), "fold")


@register("cv_average_sink_roundtrip", MD._sql_average(MD.SQL_CV))
def cv_average_sink_roundtrip(spark, sf_dir):
    """Fold averages as CSV, one row per category."""
    per_fold = M.eval_metrics(MD.cv_scores(spark, sf_dir), ["category", "fold"])
    metrics = MD.rounded(M.fold_average(per_fold, ["category"]), M.METRICS)
    return _metric_roundtrip(spark, metrics, "cv-average-csv").drop("_at")


@register("curve_sink_roundtrip", _with_flag(MD.SQL_CURVE + "," + MD.sql_metrics("lc", ["category", "train_size"])))
def curve_sink_roundtrip(spark, sf_dir):
    """Learning-curve metrics as CSV with the column ``training size``, smallest subset first."""
    metrics = MD.rounded(M.eval_metrics(MD.curve_scores(spark, sf_dir), ["category", "train_size"]), M.METRICS)
    return _placed(_metric_roundtrip(spark, metrics, "curve-csv", ["train_size"]), "train_size")


@register("csv_full_agreement", "WITH " + Q.SQL_LONG + Q.SQL_VOTES + """,
wd AS (SELECT row_id, max(CASE WHEN category = 'quality' THEN label END) AS quality,
              max(CASE WHEN category = 'toxic' THEN label END) AS toxic,
              bool_or(CASE WHEN category = 'quality' THEN full_agree END) AS full_agree_quality,
              bool_or(CASE WHEN category = 'toxic' THEN full_agree END) AS full_agree_toxic FROM mv GROUP BY row_id)
SELECT wd.row_id, wd.row_id AS doc_id, d.text AS sentence, wd.quality, wd.toxic, full_agree_quality, full_agree_toxic
FROM wd JOIN documents d ON wd.row_id = d.doc_id
""")
def csv_full_agreement(spark, sf_dir):
    """Labelled CSV with a ``full_agree_<category>`` flag per category, written and read back."""
    votes = Q.majority(spark, sf_dir)
    wide = votes.groupBy("row_id", "doc_id").pivot("category", CATS).agg(
        F.first("label").alias("label"), F.first("full_agree").alias("agree"))
    wide = wide.select("row_id", "doc_id", *[F.col(f"{c}_label").alias(c) for c in CATS],
                       *[F.col(f"{c}_agree").alias(f"full_agree_{c}") for c in CATS])
    docs = ST.documents(spark, sf_dir).select("doc_id", F.col("text").alias("sentence"))
    rows = wide.join(docs, "doc_id").select("row_id", "doc_id", "sentence", *CATS, *[f"full_agree_{c}" for c in CATS])
    path = scratch_path(spark, "agreement-csv")
    IO.write_csv(rows, path, spaced_metric_names=False)
    return IO.read_labelled_csv(spark, path, rows.schema)


_PRED_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("approach", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("variant", T.StringType()),
    T.StructField("run_date", T.DateType())])


@register("prediction_sink_roundtrip", MD.SQL_ML + f"""
, pk AS (SELECT 'class' AS kind, row_id, category, CAST(pred AS DOUBLE) AS value FROM ms
         UNION ALL SELECT 'prob', row_id, category, round(prob, {MD.DIGITS}) FROM ms)
SELECT 'multilabel' AS approach, kind, category, 'main' AS variant, '{RUN_DATE}' AS run_date,
       row_id, row_id AS doc_id, value
FROM pk
""")
def prediction_sink_roundtrip(spark, sf_dir):
    """Class and probability predictions, gzip parquet partitioned by approach/kind/category/variant/date."""
    s = MD.multilabel_scores(spark, sf_dir)
    base = s.select("row_id", F.col("row_id").alias("doc_id"), "category", "pred", "prob")
    cls = base.select("row_id", "doc_id", "category", F.lit("class").alias("kind"),
                      F.col("pred").cast("double").alias("value"))
    prob = base.select("row_id", "doc_id", "category", F.lit("prob").alias("kind"),
                       F.round("prob", MD.DIGITS).alias("value"))
    out = (cls.unionByName(prob)
           .withColumn("approach", F.lit("multilabel")).withColumn("variant", F.lit("main"))
           .withColumn("run_date", F.lit(RUN_DATE).cast("date")))
    path = scratch_path(spark, "predictions")
    IO.write_predictions(out, path)
    back = IO.read_predictions(spark, path, _PRED_SCHEMA)
    return back.select("approach", "kind", "category", "variant",
                       F.col("run_date").cast("string").alias("run_date"), "row_id", "doc_id", "value")


@register("model_store_roundtrip", MD.SQL_CV + f"""
SELECT row_id, category, fold, label, round(prob, {MD.DIGITS}) AS prob, pred FROM cs
""")
def model_store_roundtrip(spark, sf_dir):
    """All fold models saved under their keys, category by category, loaded back and applied."""
    kf = materialize(Q.kfold(spark, sf_dir).select("row_id", "category", "label", "fold"))
    tf = MD.terms(spark, sf_dir)
    rows, weights, bias = MD.fold_models(tf, kf, CATS)
    names = [f"{c}/{f}" for c in CATS for f in range(1, Q.K + 1)]

    def keyed(df):
        part = F.split("category", "/")
        return df.select(F.lit("binary").alias("approach"), F.get(part, F.lit(0)).alias("category"),
                         F.get(part, F.lit(1)).cast("int").alias("fold"), *[c for c in df.columns if c != "category"])

    long_weights, long_bias = materialize(keyed(NB.long_weights(weights, names))), materialize(keyed(NB.long_bias(bias, names)))
    path = scratch_path(spark, "model-store")
    for c in CATS:  # a later save leaves the earlier models alone
        MS.save(long_weights.where(F.col("category") == c), long_bias.where(F.col("category") == c), path)
    w, b = MS.load(spark, path, [("binary", c, f) for c in CATS for f in range(1, Q.K + 1)])
    named = F.concat_ws("/", "category", "fold").alias("category")
    s = NB.score(tf, rows.select("row_id", "category", "label", "fold", F.col("cell").alias("m")),
                 NB.wide_weights(w.select(named, "token", "weight"), names), NB.wide_bias(b.select(named, "bias"), names), len(names))
    return MD.rounded(s.select("row_id", "category", "fold", "label", "prob", "pred"), ["prob"])


@register("model_roundtrip", MD.SQL_BIN + f"""
SELECT row_id, category, label, round(prob, {MD.DIGITS}) AS prob, pred FROM bs
""")
def model_roundtrip(spark, sf_dir):
    """Final per-category models saved as tables, loaded back, applied to the test rows."""
    weights, bias = MD.final_models(spark, sf_dir)
    path = scratch_path(spark, "nb-model")
    IO.save_table_model(NB.long_weights(weights, CATS), NB.long_bias(bias, CATS), path)
    w, b = IO.load_table_model(spark, path)
    test = Q.holdout(spark, sf_dir).where(F.col("split") == "test")
    rows = MD.numbered(test, CATS).select("row_id", "category", "label", F.col("cell").alias("m"))
    s = NB.score(MD.terms(spark, sf_dir), rows, NB.wide_weights(w, CATS), NB.wide_bias(b, CATS), len(CATS))
    return MD.rounded(s.select("row_id", "category", "label", "prob", "pred"), ["prob"])
