import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from lectern.operators import bayes as NB
from lectern.operators import linear as LI
from lectern.operators import metrics as M
from lectern.plans import linear as PL
from lectern.plans import models as MD

TEXTS = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9)) + (" good" if i % 3 == 0 else " bad") + (" red" if i % 5 < 2 else ""))
         for i in range(60)] + [(60, None), (61, "")]


@pytest.fixture(scope="module")
def small(spark):
    tf = NB.term_counts(spark.createDataFrame(TEXTS, "row_id long, text string")).cache()
    tasks = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(62)] + [(i, 1, int(i % 5 < 2)) for i in range(0, 60, 2)]
                                  + [(i, 2, int(i % 3 == 0)) for i in range(20)], "row_id long, head int, label int")
    idf = LI.document_frequencies(tf, tasks, 64)
    return tf, tasks, idf, LI.features(tf, idf).cache()


def dense(feats, n):
    rows = {r.row_id: r for r in feats.collect()}
    x = np.zeros((62, n))
    for i, r in rows.items():
        x[i, r["at"]] = r["value"]
    return x


def test_features_have_length_one(small):
    _, _, idf, feats = small
    length = np.linalg.norm(dense(feats, len(idf)), axis=1)
    assert np.allclose(length[:60], 1) and not length[60:].any()


def test_gradients_against_dense(spark, small):
    _, tasks, idf, feats = small
    rows = LI.training_rows(feats, tasks)
    rng = np.random.default_rng(0)
    x = dense(feats, len(idf))
    t = tasks.collect()
    for encoder in (None, rng.normal(size=(64, 4))):
        for weight in (None, np.array([1.0, 2.0, .5])):
            model = LI.Model(idf, rng.normal(size=(64 if encoder is None else 4, 3)), rng.normal(size=3), encoder, weight)
            hidden = x if encoder is None else x @ encoder
            p = 1 / (1 + np.exp(-(hidden @ model.coef + model.bias)))
            rest, curve = np.zeros_like(p), np.zeros(3)
            for r in t:
                rest[r.row_id, r.head] += p[r.row_id, r.head] - r.label
                curve[r.head] += p[r.row_id, r.head] * (1 - p[r.row_id, r.head])
            rest = rest if weight is None else rest * weight
            got = LI.gradients(rows, model)
            assert np.allclose(got["bias"], rest.sum(axis=0)) and np.allclose(got["curve"], curve)
            assert np.allclose(got["coef"], hidden.T @ rest)
            if encoder is not None:
                assert np.allclose(got["encoder"], x.T @ (rest @ model.coef.T))


def test_joint_fit_equals_separate_fits(small):
    _, tasks, idf, feats = small
    joint = LI.fit(LI.training_rows(feats, tasks), idf, 3, steps=15)
    for h in range(3):
        alone = LI.fit(LI.training_rows(feats, tasks.where(F.col("head") == h).withColumn("head", F.lit(0))), idf, 1, steps=15)
        assert np.abs(alone.coef[:, 0] - joint.coef[:, h]).max() < 1e-6 and abs(alone.bias[0] - joint.bias[h]) < 1e-6


def test_fit_reaches_the_optimum(small):
    _, tasks, idf, feats = small
    rows = LI.training_rows(feats, tasks)
    model = LI.fit(rows, idf, 3, steps=150, l2=1e-2)
    g = LI.gradients(rows, model)
    n = LI.head_sizes(rows, 3)
    assert np.abs(g["coef"] / n + 1e-2 * model.coef).max() < 1e-3 and np.abs(g["bias"]).max() < 1e-6


def test_one_tasks_rows_change_the_others_projection(small):
    _, tasks, idf, feats = small
    both = LI.fit_shared(LI.training_rows(feats, tasks.where("head < 2")), idf, 2, rank=3, rounds=4)
    changed = tasks.where("head < 2").withColumn("label", F.when(F.col("head") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    other = LI.fit_shared(LI.training_rows(feats, changed), idf, 2, rank=3, rounds=4)
    assert np.abs(both.encoder - other.encoder).max() > 1e-3   # the encoder is shared
    assert np.abs(both.coef[:, 0] - other.coef[:, 0]).max() > 1e-4  # so head 0 moves with task 1's labels


def test_scores_and_empty_tables(spark, small):
    tf, tasks, idf, feats = small
    model = LI.fit(LI.training_rows(feats, tasks), idf, 3, steps=5)
    x = dense(feats, len(idf))
    exp = 1 / (1 + np.exp(-(x @ model.coef + model.bias)))
    for r in LI.score(feats, tasks, model).collect():
        assert r.prob == pytest.approx(exp[r.row_id, r.head]) and r.pred == int(r.prob >= .5)
    none = tasks.where("head > 9")
    empty = LI.fit(LI.training_rows(feats, none), idf, 2, steps=2)
    assert not empty.coef.any() and not empty.bias.any()
    with pytest.raises(ValueError):
        LI.gradients(LI.training_rows(feats, none), LI.Model(idf, np.lib.stride_tricks.as_strided(np.zeros(1), (1 << 20, 64), (0, 0)), np.zeros(64)))


def by_category(scored, keys=("category",)):
    return {tuple(r[k] for k in keys): r.asDict() for r in M.eval_metrics(scored, list(keys)).collect()}


def test_logistic_against_bayes(spark):
    """Two unlike models on the same rows: their accuracies are close, and well over chance where
    the category can be learnt."""
    lr, nb = by_category(PL.multilabel_lr(spark, SF_CHECK)[0]), by_category(MD.multilabel_scores(spark, SF_CHECK))
    assert lr.keys() == nb.keys()
    for c in lr:
        assert lr[c]["accuracy"] > nb[c]["accuracy"] - .08, c
    assert lr[("quality",)]["balanced_accuracy"] > .9
    shared = by_category(PL.multitask_lr(spark, SF_CHECK, rounds=15)[0])
    assert shared[("quality",)]["accuracy"] > .8


def test_counts_are_sent_by_row_once(spark, small):
    tf, tasks, idf, feats = small
    cells = LI.hashed(tf, len(idf))
    assert np.allclose(LI.hashed_frequencies(cells, tasks, len(idf)), idf)
    again = LI.hashed_features(cells, idf)
    assert np.allclose(dense(again, len(idf)), dense(feats, len(idf)))
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()


def test_rows_with_and_without_their_zeros(spark, small, monkeypatch):
    _, tasks, idf, feats = small
    rows = LI.training_rows(feats, tasks)
    assert dict(rows.dtypes)["at"] == dict(rows.dtypes)["value"] == "binary"
    rng = np.random.default_rng(1)
    model = LI.Model(idf, rng.normal(size=(64, 3)), rng.normal(size=3))
    got = []
    for full in (1 << 30, 0):  # always, never
        monkeypatch.setattr(LI, "FULL", full)
        assert [f for *_, f in LI._ranges(np.array([3, 0, 5]), 3, 64)] == [bool(full)]
        batch = next(LI._packed([rows_as_arrow(feats, tasks)]))
        shared = type("Shared", (), {"value": model})
        got.append(np.frombuffer(next(LI._gradient_pass(shared)([batch])).column("data")[0].as_py()))
    assert np.allclose(*got) and got[0].any()


def rows_as_arrow(feats, tasks):
    import pyarrow as pa

    listed = tasks.groupBy("row_id").agg(F.collect_list(F.struct("head", "label")).alias("t"))
    found = listed.join(feats, "row_id", "left").collect()
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([r.row_id for r in found]), pa.array([r["at"] or [] for r in found], ints),
         pa.array([r["value"] or [] for r in found], pa.list_(pa.float64())),
         pa.array([[x["head"] for x in r.t] for r in found], ints), pa.array([[x["label"] for x in r.t] for r in found], ints)],
        ["row_id", "at", "value", "heads", "labels"])
