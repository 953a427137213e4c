"""Column expressions over model outputs: sigmoid, softmax, argmax, thresholds, score lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x) -> Column:
    """Stable at any size: only ever takes ``exp`` of a negative number."""
    e = F.exp(-F.abs(_c(x)))
    return F.when(_c(x) >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def softmax(logits) -> Column:
    """Array of probabilities from an array of logits (max-shifted for stability)."""
    z = _c(logits)
    m = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)


def argmax(scores) -> Column:
    """0-based position of the largest score; the first one wins ties."""
    s = _c(scores)
    return F.array_position(s, F.array_max(s)) - 1


def decide(prob, threshold: float = 0.5, strict: bool = False) -> Column:
    p = _c(prob)
    return ((p > threshold) if strict else (p >= threshold)).cast("int")


def score_list(probs, labels=("no", "yes")) -> Column:
    """``array<struct<label, score>>`` like a classification pipeline's ``return_all_scores``."""
    p = _c(probs)
    return F.transform(F.array(*[F.lit(x) for x in labels]),
                       lambda lab, i: F.struct(lab.alias("label"), F.get(p, i).alias("score")))


def score_of(scores, position: int = 1) -> Column:
    """Score at a fixed position of a score list (class 1 = ``yes``)."""
    return F.get(_c(scores), position)["score"]
