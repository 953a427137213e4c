"""Evaluation: one confusion aggregate per group, fourteen metrics as column arithmetic.

scikit-learn conventions: zero denominators give 0.0; macro averages run over the classes
present in truth or prediction; balanced accuracy averages recall over the classes
present in truth; micro averages equal accuracy (one label per row).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output columns, in the reference's order (spaces become underscores; see io.to_csv).
METRICS = ["accuracy", "balanced_accuracy",
           "f1_macro", "f1_micro", "f1_label1", "f1_label0",
           "precision_macro", "precision_micro", "precision_label1", "precision_label0",
           "recall_macro", "recall_micro", "recall_label1", "recall_label0"]
TRAINER_METRICS = ["accuracy", "f1", "precision", "recall"]


def confusion(df: DataFrame, keys, truth: str = "label", pred: str = "pred") -> DataFrame:
    """``tp, fp, fn, tn`` per group (class 1 positive); partial aggregation map-side."""
    t, p = F.col(truth), F.col(pred)

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return df.groupBy(*keys).agg(
        cnt((t == 1) & (p == 1)).alias("tp"), cnt((t == 0) & (p == 1)).alias("fp"),
        cnt((t == 1) & (p == 0)).alias("fn"), cnt((t == 0) & (p == 0)).alias("tn"))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _mean_present(v1: Column, v0: Column, has1: Column, has0: Column) -> Column:
    k = has1.cast("int") + has0.cast("int")
    s = F.when(has1, v1).otherwise(0.0) + F.when(has0, v0).otherwise(0.0)
    return F.when(k > 0, s / k).otherwise(0.0)


def metric_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> list[Column]:
    tp, fp, fn, tn = (F.col(x) for x in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    acc = _div(tp + tn, n)
    p1, p0 = _div(tp, tp + fp), _div(tn, tn + fn)
    r1, r0 = _div(tp, tp + fn), _div(tn, tn + fp)
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fn + fp)
    seen1, seen0 = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    true1, true0 = (tp + fn) > 0, (tn + fp) > 0
    vals = {
        "accuracy": acc,
        "balanced_accuracy": _mean_present(r1, r0, true1, true0),
        "f1_macro": _mean_present(f1, f0, seen1, seen0),
        "f1_micro": acc, "f1_label1": f1, "f1_label0": f0,
        "precision_macro": _mean_present(p1, p0, seen1, seen0),
        "precision_micro": acc, "precision_label1": p1, "precision_label0": p0,
        "recall_macro": _mean_present(r1, r0, seen1, seen0),
        "recall_micro": acc, "recall_label1": r1, "recall_label0": r0,
    }
    return [vals[m].alias(m) for m in METRICS]


@dataclass(frozen=True)
class UserMetric:
    """A metric of one's own as a state that can be merged.

    ``state`` maps a row's truth, prediction and probability to named numbers, which are added
    up within a group; ``finish`` turns the sums into the metric. States of parts of the data
    (partitions, days, folds) merge by adding, so a metric never needs its rows again.
    """

    name: str
    state: Callable[[Column, Column, Column], dict[str, Column]]
    finish: Callable[[dict[str, Column]], Column]


def _state_columns(metrics, row: tuple[Column, Column, Column]) -> dict[str, Column]:
    return {f"{m.name}__{k}": c for m in metrics for k, c in m.state(*row).items()}


def metric_states(df: DataFrame, keys, metrics, truth: str = "label", pred: str = "pred", prob: str | None = "prob") -> DataFrame:
    """One row of summed states per group; ``prob`` may be absent (None) for metrics that ignore it."""
    row = (F.col(truth), F.col(pred), F.col(prob) if prob else F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in _state_columns(metrics, row).items()])


def merge_states(states: DataFrame, keys) -> DataFrame:
    """States of finer groups, or of several tables united, added up to ``keys``."""
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in states.columns if "__" in c])


def finish_states(states: DataFrame, keys, metrics) -> DataFrame:
    """``(keys…, one column a metric)``."""
    def of(m):
        prefix = f"{m.name}__"
        return m.finish({c[len(prefix):]: F.col(c) for c in states.columns if c.startswith(prefix)}).alias(m.name)

    return states.select(*keys, *[of(m) for m in metrics])


def _cells(t: Column, p: Column, _: Column) -> dict[str, Column]:
    cell = lambda a, b: ((t == a) & (p == b)).cast("long")
    return {"tp": cell(1, 1), "fp": cell(0, 1), "fn": cell(1, 0), "tn": cell(0, 0)}


def _matthews(s: dict[str, Column]) -> Column:
    tp, fp, fn, tn = (s[k].cast("double") for k in ("tp", "fp", "fn", "tn"))
    return _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


MATTHEWS = UserMetric("mcc", _cells, _matthews)
BRIER = UserMetric("brier", lambda t, _, p: {"sq": (p - t) * (p - t), "n": F.when(p.isNotNull() & t.isNotNull(), 1).otherwise(0)},
                   lambda s: _div(s["sq"], s["n"]))


def eval_metrics(df: DataFrame, keys, truth: str = "label", pred: str = "pred", user=(), prob: str = "prob") -> DataFrame:
    """Fourteen metrics per group of ``keys`` from one confusion aggregate; ``user`` metrics
    are computed by the same aggregate."""
    if not user:
        return confusion(df, keys, truth, pred).select(*keys, *metric_columns())
    states = metric_states(df, keys, [UserMetric("conf", _cells, _matthews), *user], truth, pred, prob)
    cells = [f"conf__{k}" for k in ("tp", "fp", "fn", "tn")]
    done = finish_states(states, [*keys, *cells], user)
    return done.select(*keys, *metric_columns(*cells), *[m.name for m in user])


def trainer_metrics(df: DataFrame, keys, truth: str = "label", pred: str = "pred") -> DataFrame:
    """The training-loop summary: accuracy and class-1 F1, precision, recall."""
    conf = confusion(df, keys, truth, pred)
    m = dict(zip(METRICS, metric_columns()))
    return conf.select(*keys, m["accuracy"].alias("accuracy"), m["f1_label1"].alias("f1"),
                       m["precision_label1"].alias("precision"), m["recall_label1"].alias("recall"))


def fold_average(metrics: DataFrame, keys, cols=METRICS) -> DataFrame:
    """Unweighted mean over folds (one row per group of ``keys``)."""
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def round_columns(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def compare(metrics: DataFrame, approaches, metric: str = "f1_macro",
            key: str = "category", approach: str = "approach") -> DataFrame:
    """One row per category, one column per approach, for one metric."""
    return metrics.groupBy(key).pivot(approach, list(approaches)).agg(F.first(metric))
