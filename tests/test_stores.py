import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import metrics as M
from lectern.sources import io as IO
from lectern.sources import model_store as MS

PREDICTIONS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("value", T.DoubleType()),
                            *[T.StructField(c, T.StringType()) for c in ("approach", "kind", "category", "variant", "run_date")]])


def predictions(spark, category, value):
    return spark.createDataFrame([(i, value, "binary", "prob", category, "main", "d1") for i in range(3)], PREDICTIONS)


def test_a_second_run_replaces_its_own_category_only(spark, tmp_path):
    path = f"{tmp_path}/predictions"
    IO.write_predictions(predictions(spark, "quality", .1).unionByName(predictions(spark, "toxic", .2)), path)
    IO.write_predictions(predictions(spark, "toxic", .3), path)
    got = {(r.category, r.value) for r in IO.read_predictions(spark, path, PREDICTIONS).collect()}
    assert got == {("quality", .1), ("toxic", .3)}


def test_metric_tables_keep_other_categories(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    schema = T.StructType([T.StructField("f1_macro", T.DoubleType()), T.StructField("category", T.StringType())])
    for rows in ([(.5, "quality"), (.6, "toxic")], [(.7, "toxic")]):
        IO.write_csv(spark.createDataFrame(rows, schema), path, partition_by=("category",))
    assert {(r.f1_macro, r.category) for r in IO.read_metrics_csv(spark, path, schema).collect()} == {(.5, "quality"), (.7, "toxic")}
    IO.write_csv(spark.createDataFrame([(.1, "none")], schema), f"{path}-flat")  # without partitions: replaced whole
    IO.write_csv(spark.createDataFrame([(.2, "none")], schema), f"{path}-flat")
    assert [r.f1_macro for r in IO.read_metrics_csv(spark, f"{path}-flat", schema).collect()] == [.2]


def models(spark, shift=0.0, approach="binary", cats=("quality", "toxic"), folds=(1, 2, 3, 4, 5)):
    weights = [(approach, c, f, f"t{k}", shift + k + f / 10) for c in cats for f in folds for k in range(f)]
    bias = [(approach, c, f, shift - f) for c in cats for f in folds]
    return (spark.createDataFrame(weights, "approach string, category string, fold int, token string, weight double"),
            spark.createDataFrame(bias, "approach string, category string, fold int, bias double"))


def test_models_by_key(spark, tmp_path):
    path = f"{tmp_path}/store"
    MS.save(*models(spark), path)
    MS.save(*models(spark, shift=100.0, cats=("toxic",), folds=(2,)), path)   # one model again
    w, b = MS.load(spark, path, [("binary", c, f) for c in ("quality", "toxic") for f in range(1, 6)])
    assert b.count() == 10 and w.count() == 2 * 15
    new = w.where("category = 'toxic' and fold = 2")
    assert sorted(r.weight for r in new.collect()) == [100.2, 101.2]
    assert MS.load(spark, path, [("binary", "quality", 2)])[0].agg(F.max("weight")).first()[0] == 1.2
    one = MS.load(spark, path, [("binary", "quality", 3)])[0]
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [" in one._jdf.queryExecution().toString()
    assert "category#" in one._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]
    with pytest.raises(KeyError):
        MS.load(spark, path, [("multilabel", "quality", 1)])


def test_an_incomplete_model_is_not_loaded(spark, tmp_path):
    path = f"{tmp_path}/store"
    w, b = models(spark, folds=(3,))
    MS.save(w, b, path)
    # weights replaced without their manifest row, as after a save that was cut short
    MS._write(w.where("category = 'toxic' and token = 't0'").select("token", "weight", *MS.KEYS), f"{path}/weights")
    assert MS.load(spark, path, [("binary", "quality", 3)])[0].count() == 3
    with pytest.raises(KeyError):
        MS.load(spark, path, [("binary", "toxic", 3)])


SCORED = [("a", 1, 1, 1, .9), ("a", 1, 0, 1, .6), ("a", 2, 1, 0, .2), ("a", 2, 0, 0, .1), ("a", 2, 1, 1, .8), ("b", 1, 1, 1, .7), ("b", 2, None, 1, None)]


def test_user_metrics_merge(spark):
    df = spark.createDataFrame(SCORED, "category string, fold int, label int, pred int, prob double")
    own = [M.MATTHEWS, M.BRIER]
    whole = {r.category: r for r in M.finish_states(M.metric_states(df, ["category"], own), ["category"], own).collect()}
    parts = M.metric_states(df, ["category", "fold"], own)
    merged = {r.category: r for r in M.finish_states(M.merge_states(parts, ["category"]), ["category"], own).collect()}
    assert whole["a"].mcc == merged["a"].mcc == pytest.approx((2 * 1 - 1 * 1) / math.sqrt(3 * 3 * 2 * 2))
    assert whole["a"].brier == pytest.approx(merged["a"].brier) == pytest.approx((.01 + .36 + .64 + .01 + .04) / 5)
    assert merged["b"].mcc == 0.0 and merged["b"].brier == pytest.approx(.09)


def test_user_metrics_beside_the_fourteen(spark):
    df = spark.createDataFrame(SCORED[:5], "category string, fold int, label int, pred int, prob double")
    far = M.UserMetric("far", lambda t, p, q: {"n": (F.abs(q - t) > .5).cast("int")}, lambda s: s["n"].cast("double"))
    plain, both = M.eval_metrics(df, ["category"]).first(), M.eval_metrics(df, ["category"], user=[far, M.BRIER]).first()
    assert all(both[m] == plain[m] for m in M.METRICS) and both["far"] == 2.0 and both["brier"] > 0
