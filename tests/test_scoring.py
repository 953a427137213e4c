import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import scoring as SC
from lectern.operators import prevalence as PV


def test_softmax_argmax_sigmoid(spark):
    df = spark.createDataFrame([([0.0, 2.0], 2.0), ([1.0, 1.0], 0.0)], "z array<double>, x double")
    rows = df.select(SC.softmax("z").alias("p"), SC.argmax("z").alias("a"), SC.sigmoid("x").alias("s")).collect()
    assert rows[0]["p"][1] == pytest.approx(1 / (1 + math.exp(-2)))
    assert rows[0]["s"] == pytest.approx(rows[0]["p"][1])
    assert rows[0]["a"] == 1 and rows[1]["a"] == 0  # first wins ties
    assert rows[1]["p"] == [0.5, 0.5]


def test_score_list_and_pick(spark):
    df = spark.createDataFrame([([0.3, 0.7],)], "p array<double>")
    r = df.select(SC.score_list("p").alias("l")).select(SC.score_of(F.col("l")).alias("y"), "l").first()
    assert r["y"] == 0.7 and r["l"][0]["label"] == "no"


def test_excluded_category_is_not_scored(spark):
    sents = spark.createDataFrame([(1, 0, "good day")], "doc_id long, pos int, sentence string")
    w = spark.createDataFrame([("good", [1.0, 5.0])], "token string, w array<double>")
    b = spark.createDataFrame([([0.0, 0.0],)], "bias array<double>")
    out = PV.score_sentences(sents, w, b, ["a", "rationale"]).collect()
    assert [r["category"] for r in out] == ["a"] and out[0]["is_yes"]
