import random

import pytest

from lectern.operators import metrics as M


def brute(t, p):
    """Reference semantics written out: per-class counts, zero division -> 0."""
    def prf(c):
        tp = sum(1 for a, b in zip(t, p) if a == c and b == c)
        pp = sum(1 for b in p if b == c)
        tt = sum(1 for a in t if a == c)
        prec = tp / pp if pp else 0.0
        rec = tp / tt if tt else 0.0
        f1 = 2 * tp / (pp + tt) if (pp + tt) else 0.0
        return prec, rec, f1
    n = len(t)
    acc = sum(1 for a, b in zip(t, p) if a == b) / n
    present = sorted(set(t) | set(p))
    in_truth = sorted(set(t))
    p1, r1, f1 = prf(1)
    p0, r0, f0 = prf(0)
    per = {1: (p1, r1, f1), 0: (p0, r0, f0)}
    mean = lambda i, cls: sum(per[c][i] for c in cls) / len(cls) if cls else 0.0
    return {"accuracy": acc, "balanced_accuracy": mean(1, in_truth),
            "f1_macro": mean(2, present), "f1_micro": acc, "f1_label1": f1, "f1_label0": f0,
            "precision_macro": mean(0, present), "precision_micro": acc,
            "precision_label1": p1, "precision_label0": p0,
            "recall_macro": mean(1, present), "recall_micro": acc, "recall_label1": r1, "recall_label0": r0}


def run(spark, cases):
    rows = [(g, a, b) for g, (t, p) in enumerate(cases) for a, b in zip(t, p)]
    df = spark.createDataFrame(rows, "g int, label int, pred int")
    return {r["g"]: r.asDict() for r in M.eval_metrics(df, ["g"]).collect()}


def test_edge_cases(spark):
    out = run(spark, [([0, 0], [0, 0]), ([1], [0])])
    assert out[0]["accuracy"] == 1.0 and out[0]["f1_label1"] == 0.0 and out[0]["f1_macro"] == 1.0
    assert out[1]["accuracy"] == 0.0 and out[1]["f1_label1"] == 0.0 and out[1]["f1_label0"] == 0.0
    assert out[1]["balanced_accuracy"] == 0.0


def test_against_brute_force(spark):
    rnd = random.Random(7)
    cases = []
    for _ in range(40):
        n = rnd.randint(1, 12)
        cases.append(([rnd.randint(0, 1) for _ in range(n)], [rnd.randint(0, 1) for _ in range(n)]))
    out = run(spark, cases)
    for g, (t, p) in enumerate(cases):
        exp = brute(t, p)
        for m in M.METRICS:
            assert out[g][m] == pytest.approx(exp[m]), (g, m, t, p)


def test_micro_equals_accuracy_and_fold_average(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 1, 1), (2, 0, 0)], "fold int, label int, pred int")
    per = M.eval_metrics(df, ["fold"])
    avg = M.fold_average(per, []).first()
    assert avg["accuracy"] == pytest.approx(0.75)
    for r in per.collect():
        assert r["precision_micro"] == r["recall_micro"] == r["f1_micro"] == r["accuracy"]
