"""Many categories at once give what each gives alone."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import bayes as NB

WORDS = "red blue green plain dark light warm cold old new".split()


def test_many_models_equal_single_fits(spark):
    n_cats, folds = 13, 3
    texts = [(i, " ".join(WORDS[(i * k + k) % 10] for k in range(1, 2 + i % 7))) for i in range(60)] + [(60, None), (61, "")]
    rows = [(i, c * folds + i % folds, (i // (c + 1)) % 2) for i, _ in texts for c in range(n_cats)]
    tf = NB.term_counts(spark.createDataFrame(texts, "row_id long, text string"))
    # a row without a label and one of a cell that does not exist count for nothing
    labelled = spark.createDataFrame(rows + [(1, 0, None), (2, n_cats * folds, 1)], "row_id long, cell int, label int")
    trains = [[c * folds + g for g in range(folds) if g != f] for c in range(n_cats) for f in range(folds)]
    assert len(trains) > 2 * NB.WIDTH
    weights, bias = NB.fit(tf, labelled, n_cats * folds, trains)
    asked = spark.createDataFrame([(i, m) for i, _ in texts for m in range(len(trains))], "row_id long, m int")
    got = {(r.row_id, r.m): r.margin for r in NB.score(tf, asked, weights, bias, len(trains)).collect()}
    assert len(got) == len(texts) * len(trains)
    for m in (0, 17, 38):
        w, b = NB.fit(tf, labelled.where(F.col("cell").isin(trains[m])).withColumn("cell", F.lit(0)), 1, [[0]])
        alone = NB.score(tf, asked.where(F.col("m") == m).withColumn("m", F.lit(0)), w, b, 1).collect()
        for r in alone:
            assert got[r.row_id, m] == pytest.approx(r.margin, abs=1e-9)


def test_models_without_rows(spark):
    tf = NB.term_counts(spark.createDataFrame([(1, "a b")], "row_id long, text string"))
    none = spark.createDataFrame([], "row_id long, cell int, label int")
    weights, bias = NB.fit(tf, none, 2, [[0], [1]])
    assert weights.count() == 0 and list(bias.first()["bias"]) == [0.0, 0.0]
