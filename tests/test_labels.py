from pyspark.sql import functions as F

from lectern.functions import labels as LF
from lectern.operators import labels as LO

CATS = ["a", "b", "c"]


def test_none_label_and_list(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (0, None, 0)], "a int, b int, c int")
    rows = df.select(LF.none_label(CATS).alias("n"), LF.label_list(CATS).alias("l")).collect()
    assert [r["n"] for r in rows] == [1, 0, 1]
    assert [r["l"] for r in rows] == [[], ["a", "c"], []]


def test_multi_hot_round_trip(spark):
    df = spark.createDataFrame([(["c", "a"],), ([],)], "names array<string>")
    hot = LF.multi_hot(F.col("names"), CATS)
    rows = df.select(hot.alias("h"), LF.names_from_multi_hot(hot, CATS).alias("back")).collect()
    assert rows[0]["h"] == [1.0, 0.0, 1.0] and rows[0]["back"] == ["a", "c"]
    assert rows[1]["h"] == [0.0, 0.0, 0.0] and rows[1]["back"] == []


def test_class_maps_invert(spark):
    r = spark.range(1).select(LF.class_to_id(CATS).alias("f"), LF.id_to_class(CATS).alias("g")).first()
    assert r["f"] == {"a": 0, "b": 1, "c": 2} and r["g"] == {0: "a", 1: "b", 2: "c"}


def test_insert_after(spark):
    df = spark.createDataFrame([(1, "s", 0, 1)], "row_id long, sentence_post string, a int, b int")
    out = LO.add_none(df, ["a", "b"], after="sentence_post")
    assert out.columns == ["row_id", "sentence_post", "none", "a", "b"]


def test_majority_vote_ties_and_agreement(spark):
    votes = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "a", 0), (2, "a", 1), (2, "a", 0),
                                   (3, "a", 0), (3, "a", 0)], "row_id long, category string, vote int")
    rows = {r["row_id"]: r for r in LO.majority_vote(votes).collect()}
    assert rows[1]["label"] == 1 and not rows[1]["full_agree"]
    assert rows[2]["label"] == 0  # tie
    assert rows[3]["label"] == 0 and rows[3]["full_agree"]
