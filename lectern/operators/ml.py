"""Spark ML classifiers as plug-ins: one shared feature pipeline, one logistic head per category.

Features (hashed term counts -> IDF) are fitted once on all training rows and shared by every
head, as in the multi-label and multi-task set-ups. Hashing needs no vocabulary, so no token
is left out and nothing vocabulary-sized reaches the driver. Each head is a
``LogisticRegression`` fitted on its category's training rows; heads are independent Spark
jobs submitted from a small driver thread pool (the category list is bounded).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bayes as NB


def feature_pipeline(n_features: int = 1 << 18) -> Pipeline:
    return Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features),
        IDF(inputCol="tf", outputCol="features")])


def with_tokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.select("row_id", NB.model_tokens(text_col).alias("tokens"))


def fit_features(texts: DataFrame, train_rows: DataFrame, **kw) -> PipelineModel:
    rows = with_tokens(texts).join(train_rows.select("row_id").distinct(), "row_id", "left_semi")
    return feature_pipeline(**kw).fit(rows)


def featurize(model: PipelineModel, texts: DataFrame) -> DataFrame:
    return model.transform(with_tokens(texts)).select("row_id", "features")


def fit_heads(train: DataFrame, categories, max_iter: int = 20, reg_param: float = 0.0,
              parallelism: int = 4) -> dict:
    """``{category: LogisticRegressionModel}`` from staged long rows ``(category, label, features)``."""
    def one(cat):
        rows = train.where(F.col("category") == cat).select(F.col("label").cast("double"), "features")
        return cat, LogisticRegression(maxIter=max_iter, regParam=reg_param, labelCol="label",
                                       featuresCol="features").fit(rows)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(categories)))) as pool:
        return dict(pool.map(one, list(categories)))


def score_heads(heads: dict, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(row_id, category, label, prob, pred)`` for the long ``rows`` (with ``features``)."""
    out = None
    for cat, model in heads.items():
        scored = model.transform(rows.where(F.col("category") == cat)).select(
            "row_id", "category", "label",
            vector_to_array(F.col("probability")).getItem(1).alias("prob"))
        out = scored if out is None else out.unionByName(scored)
    return out.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def save_heads(feature_model: PipelineModel, heads: dict, path: str) -> None:
    """One directory per fitted model; nothing is overwritten between folds or categories."""
    feature_model.write().overwrite().save(f"{path}/features")
    for cat, m in heads.items():
        m.write().overwrite().save(f"{path}/head={cat}")


def load_heads(path: str, categories):
    from pyspark.ml.classification import LogisticRegressionModel
    return (PipelineModel.load(f"{path}/features"),
            {c: LogisticRegressionModel.load(f"{path}/head={c}") for c in categories})
