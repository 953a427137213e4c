"""External scorers: any text classifier applied as an Arrow-batched iterator pandas UDF.

``load`` runs once per Python worker (not per row or batch) and returns a function from a
list of texts to a list of per-class score lists, like a classification pipeline with
all scores returned. The result column is ``array<struct<label, score>>``; everything
after it (pick the ``yes`` score, threshold, metrics) is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                   T.StructField("score", T.DoubleType())]))


def scorer_udf(load: Callable[[], Callable[[list[str]], list]], nested: bool = False):
    """``nested``: the model returns one score list per category for every text."""
    @F.pandas_udf(T.ArrayType(SCORES) if nested else SCORES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), index=texts.index)
    return run


def batched_scorer(load: Callable[[], Callable[[list[str]], list]], n_labels: int, batch_size: int = 64):
    """The same kind of model in batches of a fixed size: ``predict_batch_udf`` loads it once per
    worker and regroups the rows of Arrow batches. Gives ``array<double>``, the scores of
    ``n_labels`` categories and both classes one after the other."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        import numpy as np

        model = load()

        def predict(texts):
            texts = ["" if t is None else t for t in np.ravel(texts).tolist()]
            scores = model(texts)
            return np.array([[c["score"] for category in s for c in category] for s in scores],
                            dtype=np.float64).reshape(len(texts), 2 * n_labels)
        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)


def with_batched_scores(df: DataFrame, text_col: str, load, n_labels: int, out: str, batch_size: int = 64) -> DataFrame:
    """``df`` with ``out array<array<struct<label, score>>>`` like a nested :func:`external_scores`."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    flat = df.withColumn(out, batched_scorer(load, n_labels, batch_size)(F.coalesce(F.col(text_col), F.lit(""))))

    def pair(i):
        return F.array(*[F.struct(F.lit(name).alias("label"), F.get(out, 2 * i + k).alias("score"))
                         for k, name in enumerate(("no", "yes"))])

    return flat.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), pair))


def external_scores(text: Column, load, nested: bool = False) -> Column:
    from ..session import ship_package
    ship_package()
    return scorer_udf(load, nested)(text)
