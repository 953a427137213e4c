import math
from collections import Counter

import pytest

from lectern.operators import bayes as NB

TEXTS = [(1, "good fine good"), (2, "bad awful"), (3, "good bad"), (4, "fine fine"), (5, "awful good new")]
LABELS = {1: 1, 2: 0, 3: 1, 4: 1, 5: 0}


def brute(train_ids, text):
    cnt = {0: Counter(), 1: Counter()}
    docs = Counter()
    for i in train_ids:
        lab = LABELS[i]
        docs[lab] += 1
        cnt[lab].update(dict(TEXTS)[i].split())
    vocab = set(cnt[0]) | set(cnt[1])
    t1, t0 = sum(cnt[1].values()), sum(cnt[0].values())
    m = math.log((docs[1] + 1) / (docs[0] + 1))
    for tok in text.split():
        if tok in vocab:
            m += math.log((cnt[1][tok] + 1) / (t1 + len(vocab))) - math.log((cnt[0][tok] + 1) / (t0 + len(vocab)))
    return 1 / (1 + math.exp(-m))


def frames(spark, rows):
    tx = spark.createDataFrame(TEXTS, "row_id long, text string")
    return NB.term_counts(tx), spark.createDataFrame(rows, "row_id long, cell int, label int")


def test_fit_score_matches_brute_force(spark):
    tf, train = frames(spark, [(i, 0, LABELS[i]) for i in (1, 2, 3, 4)])
    w, b = NB.fit(tf, train, 1, [[0]])
    rows = spark.createDataFrame([(5, 0)], "row_id long, m int")
    got = NB.score(tf, rows, w, b, 1).first()["prob"]
    assert got == pytest.approx(brute([1, 2, 3, 4], "awful good new"))


def test_fold_models_sum_the_other_folds(spark):
    folds = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    tf, rows = frames(spark, [(i, folds[i], LABELS[i]) for i in folds])
    w, b = NB.fit(tf, rows, 3, [[1, 2], [0, 2], [0, 1]])
    scored = NB.score(tf, rows.withColumnRenamed("cell", "m"), w, b, 3)
    s = {r["row_id"]: r["prob"] for r in scored.collect()}
    for i, f in folds.items():
        train = [j for j, g in folds.items() if g != f]
        assert s[i] == pytest.approx(brute(train, dict(TEXTS)[i]))


def test_margins_are_not_clamped(spark):
    texts = [(1, "up " * 400), (2, "down " * 400), (3, "up " * 500), (4, "up " * 900), (5, "")]
    tf = NB.term_counts(spark.createDataFrame(texts, "row_id long, text string"))
    train = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "row_id long, cell int, label int")
    w, b = NB.fit(tf, train, 1, [[0]])
    s = {r["row_id"]: r for r in NB.score(tf, spark.createDataFrame([(3, 0), (4, 0), (5, 0)], "row_id long, m int"),
                                          w, b, 1).collect()}
    assert 50 < s[3]["margin"] < s[4]["margin"] and s[3]["prob"] == 1.0
    assert s[5]["margin"] == pytest.approx(0.0) and s[5]["prob"] == 0.5  # no token: the bias alone


def test_ties_follow_the_comparison(spark):
    tf, train = frames(spark, [(1, 0, 1), (2, 0, 0)])
    w, b = NB.fit(tf, train, 1, [[0]])
    rows = spark.createDataFrame([(99, 0)], "row_id long, m int")  # no text: exactly 0.5
    assert NB.score(tf, rows, w, b, 1).first()["pred"] == 1
    assert NB.score(tf, rows, w, b, 1, strict=True).first()["pred"] == 0


def test_shared_mix_changes_a_head(spark):
    tf, rows = frames(spark, [(1, 0, 1), (2, 0, 0), (3, 1, 1), (5, 1, 0)])
    mix = spark.createDataFrame([(1, 0), (3, 0), (3, 0)], "row_id long, view int")
    plain, _ = NB.fit(tf, rows, 2, [[0], [1]])
    shared, _ = NB.fit(tf, rows, 2, [[0], [1]], mix=mix, views=[0, 0])
    a = {r["token"]: r["w"] for r in plain.collect()}
    b = {r["token"]: r["w"] for r in shared.collect()}
    # by hand: token "good" in head 0; mix texts 1, 3, 3: good 4 of 7 tokens; vocabulary of 5 tokens
    v, p = 5, (4 + 1) / (7 + 5)
    assert set(b) == {"good", "fine", "bad", "awful", "new"}
    assert b["good"][0] == pytest.approx(math.log((2 + v * p) / (3 + v)) - math.log((0 + v * p) / (2 + v)))
    assert b["good"][0] != pytest.approx(a["good"][0])


def test_weights_by_model_and_back(spark):
    tf, rows = frames(spark, [(1, 0, 1), (2, 0, 0), (3, 1, 1), (5, 1, 0)])
    w, b = NB.fit(tf, rows, 2, [[0], [1]])
    back = NB.wide_weights(NB.long_weights(w, ["x", "y"]), ["x", "y"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, w.collect()))
    assert NB.wide_bias(NB.long_bias(b, ["x", "y"]), ["x", "y"]).first() == b.first()


def test_multitask_differs_from_binary(spark):
    from conftest import SF_CHECK
    from lectern.plans import models as MD

    key = lambda df: {(r["row_id"], r["category"]): round(r["margin"], 6) for r in df.collect()}
    two, mt = key(MD.binary_scores(spark, SF_CHECK)), key(MD.multitask_scores(spark, SF_CHECK))
    both = two.keys() & mt.keys()
    assert both and sum(two[k] != mt[k] for k in both) > len(both) / 2
    assert max(abs(m) for m in two.values()) > 50  # no clamp


def test_only_the_test_rows_counts_meet_the_weights(spark, monkeypatch):
    from lectern.plans import models as MD
    tf, _ = frames(spark, [])
    h = spark.createDataFrame([(i, f"d{i}", "quality", LABELS[i], "test" if i in (2, 5) else "train") for i in range(1, 6)],
                              "row_id long, doc_id string, category string, label int, split string")
    seen, score = [], NB.score

    def spy(counts, *args, **kwargs):
        seen.append({r.row_id for r in counts.select("row_id").distinct().collect()})
        return score(counts, *args, **kwargs)

    monkeypatch.setattr(NB, "score", spy)
    got = {r.row_id: r.prob for r in MD.per_category(tf, h, ["quality"]).collect()}
    assert seen == [{2, 5}]
    assert got == pytest.approx({i: brute([1, 3, 4], dict(TEXTS)[i]) for i in (2, 5)})
