"""Bag-of-words multinomial Naive Bayes for many models at once, with DataFrame aggregations.

Everything runs on one table of term counts ``(row_id, token, tf)``. Training rows carry a
*cell* (e.g. category x fold); a model trains on a list of cells. One aggregate over tokens
and cells gives the counts of every cell, and the models are array arithmetic inside the
token's row, so plans do not grow with cells and models: a k-fold model is the sum of the other
folds' cells, a learning-curve model the sum of the first chunks. A fitted set of models is

* ``weights (token, w array<double>)``: one row per token, one element per model;
* ``bias (bias array<double>)``: one row.

Scoring joins the term counts to the weights once, on ``token``, and reduces arrays per row; for
more than WIDTH models only the distinct tokens of batches of rows, staged while the plan is built,
meet the weights, so no row of that many weights is made for every count. Whether the weights
are broadcast is left to AQE, which sees their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as SC
from ..functions import text as TF
from . import coded as CO

ALPHA = 1.0
WIDTH = 16  # models whose sums one aggregate holds


def model_tokens(text_col: str = "text", sep_replacement: str = " [SEP] "):
    return TF.tokens(TF.model_text(F.col(text_col), sep_replacement))


def term_counts(texts: DataFrame, ids=("row_id",), text_col: str = "text", max_length: int | None = None) -> DataFrame:
    """``(ids…, token, tf)``: the one table that fits and scores share. With ``max_length`` only
    the tokens that fixed-length ids would hold are counted."""
    tokens = model_tokens(text_col)
    if max_length is not None:
        tokens = TF.leading(tokens, max_length)
    return (texts.select(*ids, F.explode(tokens).alias("token"))
            .groupBy(*ids, "token").agg(F.count(F.lit(1)).alias("tf")))


def fit(tf: DataFrame, rows: DataFrame, n_cells: int, trains: list[list[int]], alpha: float = ALPHA,
        mix: DataFrame | None = None, views: list[int] | None = None):
    """``(weights, bias)`` of ``len(trains)`` models.

    ``rows (row_id, cell, label)`` are the labelled rows; model ``m`` trains on the cells
    ``trains[m]``. Without ``mix`` a token's log-likelihood ratio is smoothed by ``alpha``
    uniformly over the model's own vocabulary. With ``mix (row_id, view)`` the models share
    what the mixed rows of their view (``views[m]``) say about tokens: the smoothing mass,
    ``alpha`` per token of the view's vocabulary, is spread by the mix's token distribution
    (a row counts as often as it is mixed in).
    """
    # marks: 2 * cell + label for a labelled row, and a number a view for a mixed row
    n_views = max(views) + 1 if mix is not None else 0
    marks = (rows.where(F.col("cell").between(0, n_cells - 1) & F.col("label").isin(0, 1))
             .select("row_id", (F.col("cell") * 2 + F.col("label")).cast("int").alias("mark")))
    if mix is not None:
        marks = marks.unionByName(mix.where(F.col("view").between(0, n_views - 1)).select(
            "row_id", (F.col("view") + 2 * n_cells).cast("int").alias("mark")))
    marks = marks.groupBy("row_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    per_row = marks.groupBy("row_id").agg(F.collect_list(F.struct("mark", "n")).alias("marks"))  # a mark once
    counts = (tf.join(per_row, "row_id").select("token", "tf", F.inline("marks"))
              .groupBy("token", "mark").agg(F.sum(F.col("tf") * F.col("n")).alias("n")))
    n_marks = 2 * n_cells + n_views
    per = _by_model(_dense(counts.groupBy("token"), n_marks, "token"), trains, "token",
                    F.slice("dense", 2 * n_cells + 1, n_views).alias("mixed"))
    # the model's vocabulary; with a mix, that of all models of its view
    peers = [[i] if mix is None else [m for m in range(len(trains)) if views[m] == views[i]]
             for i in range(len(trains))]
    per = per.withColumn("seen", F.transform(_lists(peers), lambda ms: F.exists(
        ms, lambda i: F.get("n1", i) + F.get("n0", i) > 0)))
    totals = (per.select(F.posexplode(F.arrays_zip("n1", "n0", "seen")).alias("m", "x"))
              .groupBy("m").agg(F.sum("x.n1").alias("t1"), F.sum("x.n0").alias("t0"),
                                F.sum(F.col("x.seen").cast("long")).alias("size"))
              .agg(F.array_sort(F.collect_list(F.struct("m", "t1", "t0", "size"))).alias("t")))
    a = F.lit(alpha)
    models = F.sequence(F.lit(0), F.lit(len(trains) - 1))
    per = per.join(F.broadcast(totals))  # one row, an element a model
    if mix is not None:
        mixed = (per.select(F.posexplode("mixed").alias("v", "x")).groupBy("v").agg(F.sum("x").alias("x"))
                 .agg(F.array_sort(F.collect_list(F.struct("v", "x"))).alias("all_mixed")))
        per = per.join(F.broadcast(mixed))  # one row, an element a view
        view = _ints(views)

    def ratio(m: Column, y: int) -> Column:
        n, t, size = F.get(f"n{y}", m), F.get("t", m)[f"t{y}"], F.get("t", m)["size"]
        if mix is None:
            return (n + a) / (t + a * size)
        v = F.get(view, m)
        share = (F.get("mixed", v) + 1) / (F.get("all_mixed", v)["x"] + size)
        return (n + a * size * share) / (t + a * size)

    weights = per.select("token", F.transform(models, lambda m: F.when(
        F.get("seen", m), F.log(ratio(m, 1)) - F.log(ratio(m, 0))).otherwise(0.0)).alias("w"))
    docs = _by_model(_dense(marks.groupBy("mark").agg(F.sum("n").alias("n")).groupBy(), n_marks), trains)
    bias = docs.select(F.transform(models, lambda m: F.log((F.get("n1", m) + a) / (F.get("n0", m) + a))).alias("bias"))
    return weights, bias


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def _lists(values: list[list[int]]) -> Column:
    return F.array(*[_ints(v) for v in values])


def _dense(grouped, n_marks: int, *keys: str) -> DataFrame:
    """``(keys…, dense array<long>)`` of n_marks counts from groups of rows ``(mark, n)``."""
    found = grouped.agg(F.map_from_entries(F.collect_list(F.struct("mark", "n"))).alias("found"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n_marks - 1)), lambda i: F.coalesce(
        F.try_element_at(F.col("found"), i), F.lit(0).cast("long"))).alias("dense"))


def _by_model(dense: DataFrame, trains: list[list[int]], *keep) -> DataFrame:
    """``(keep…, n1, n0)``: for each model the sum of its cells' counts, by label."""
    def total(y: int) -> Column:
        return F.transform(_lists(trains), lambda cells: F.aggregate(
            cells, F.lit(0).cast("long"), lambda done, c: done + F.get("dense", c * 2 + y)))
    return dense.select(*keep, total(1).alias("n1"), total(0).alias("n0"))


def sums(tf: DataFrame, weights: DataFrame, n_models: int, ids=("row_id",)) -> DataFrame:
    """``(ids…, s array<double>)``: each row's weight sum under every model. More than WIDTH models do
    not ride on every count: a row's counts are one list, and each token is looked up once a batch
    of rows (``coded``)."""
    if n_models <= WIDTH:
        total = F.array(*[F.sum(F.col("tf") * F.get("w", F.lit(m))) for m in range(n_models)])
        return tf.join(weights, "token").groupBy(*ids).agg(total.alias("s"))
    listed = tf.groupBy(*ids).agg(F.collect_list(F.struct("token", "tf")).alias("c"))  # a row's distinct tokens
    batches = CO.batched(listed.select(*ids, F.col("c.token").alias("_t"), F.col("c.tf").cast("array<bigint>").alias("_n")), "_t", "_n")
    return CO.weighted_sums(batches, CO.words(batches).join(weights, "token"), "w", n_models)


def score(tf: DataFrame, rows: DataFrame, weights: DataFrame, bias: DataFrame, n_models: int,
          threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """``rows (row_id, m, …)`` with ``margin, prob, pred`` under model ``m`` of each row.

    ``pred`` is ``prob >= threshold`` (``>`` with ``strict``). Rows without any known token
    have the model's bias alone.
    """
    per_row = sums(tf, weights, n_models)
    out = (rows.join(per_row, "row_id", "left").join(F.broadcast(bias))  # bias: one row
           .withColumn("margin", F.get("bias", F.col("m")) + F.coalesce(F.get("s", F.col("m")), F.lit(0.0)))
           .drop("s", "bias"))
    return (out.withColumn("prob", SC.sigmoid("margin"))
            .withColumn("pred", SC.decide(F.col("prob"), threshold, strict)))


def long_weights(weights: DataFrame, names: list[str], key: str = "category") -> DataFrame:
    """``(key, token, weight)``, one row per token and model, for storage by model."""
    named = F.array(*[F.lit(x) for x in names])
    return (weights.select("token", F.posexplode("w").alias("m", "weight"))
            .select(F.get(named, F.col("m")).alias(key), "token", "weight"))


def wide_weights(long_form: DataFrame, names: list[str], key: str = "category") -> DataFrame:
    """The inverse of :func:`long_weights`; a token a model lacks weighs 0."""
    return long_form.groupBy("token").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col(key) == x, F.col("weight"))), F.lit(0.0)) for x in names]).alias("w"))


def long_bias(bias: DataFrame, names: list[str], key: str = "category") -> DataFrame:
    named = F.array(*[F.lit(x) for x in names])
    return (bias.select(F.posexplode("bias").alias("m", "bias"))
            .select(F.get(named, F.col("m")).alias(key), "bias"))


def wide_bias(long_form: DataFrame, names: list[str], key: str = "category") -> DataFrame:
    return long_form.agg(F.array(*[F.max(F.when(F.col(key) == x, F.col("bias"))) for x in names]).alias("bias"))
