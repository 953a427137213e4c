"""Registered queries of the jointly fitted logistic models (``operators.linear``).

A fit has no SQL form, but its solution has properties that SQL can state: where the intercept
is not penalised, the probabilities of a head's training rows add up to its positive labels.
The queries return that sum, taken from the finished model by scoring its training rows, next
to the rows scored; the twins count labels. Metrics are compared with the Naive Bayes models
in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linear as LI
from ..operators import split as SP
from ..operators.ranking import materialize
from . import models as MD
from . import splits as Q
from .registry import register

CATS, ML_CATS = MD.CATS, MD.ML_CATS


def head(cats, group: str | None = None, groups: int = 1):
    """Position of a row's (category, group), groups counted from 1."""
    at = F.array_position(F.array(*[F.lit(c) for c in cats]), F.col("category")).cast("int") - 1
    return at if group is None else at * groups + F.col(group) - 1


def fitted(tf: DataFrame, tasks: DataFrame, n_heads: int, shared: bool = False, n_features: int = LI.N_FEATURES, **kw):
    """``(model, features)``: document frequencies over the rows that train, features of all rows,
    and the heads fitted on ``tasks (row_id, head, label)``."""
    tasks = materialize(tasks.select("row_id", "head", "label"))
    cells = LI.hashed(tf, n_features)
    idf = LI.hashed_frequencies(cells, tasks, n_features)
    feats = materialize(LI.hashed_features(cells, idf))
    rows = LI.training_rows(feats, tasks)
    return (LI.fit_shared if shared else LI.fit)(rows, idf, n_heads, **kw), feats, tasks


def multilabel_lr(spark, sf_dir, **kw):
    """Test rows scored by heads for all categories (``none`` included) from one fit."""
    lng = MD.multilabel_long(spark, sf_dir).withColumn("head", head(ML_CATS))
    model, feats, tasks = fitted(MD.terms(spark, sf_dir), lng.where(F.col("split") == SP.TRAIN), len(ML_CATS), **kw)
    return LI.score(feats, lng.where(F.col("split") == SP.TEST).drop("split"), model), LI.score(feats, tasks, model)


def multitask_lr(spark, sf_dir, **kw):
    """Test rows scored by a head for each task over an encoder learnt from the even mix of all tasks."""
    h = materialize(Q.agreed_holdout(spark, sf_dir).select("row_id", "doc_id", "category", "label", "split"))
    h = h.withColumn("head", head(CATS))
    mix = SP.task_mix(h.where(F.col("split") == SP.TRAIN), CATS, Q.SEED)
    model, feats, tasks = fitted(MD.terms(spark, sf_dir), mix, len(CATS), shared=True, **kw)
    return LI.score(feats, h.where(F.col("split") == SP.TEST).drop("split"), model), LI.score(feats, tasks, model)


def cv_lr(spark, sf_dir, **kw):
    """Every fold model of every category from one fit: a row trains the heads of the other folds
    and is scored by its own fold's."""
    kf = materialize(Q.kfold(spark, sf_dir).select("row_id", "category", "label", "fold")).withColumn("head", head(CATS, "fold", Q.K))
    other = (SP.fold_views(kf, Q.K).where("role = 'train'")
             .select("row_id", "category", "label", F.col("view").alias("fold")).withColumn("head", head(CATS, "fold", Q.K)))
    model, feats, tasks = fitted(MD.terms(spark, sf_dir), other, len(CATS) * Q.K, **kw)
    return LI.score(feats, kf, model), LI.score(feats, tasks, model)


def curve_lr(spark, sf_dir, **kw):
    """Every growing subset's model of every category from one fit; the fixed test rows are scored by all."""
    h = materialize(Q.holdout(spark, sf_dir))
    steps = Q.STEPS
    chunks = materialize(SP.subset_chunks(h.where(F.col("split") == SP.TRAIN), steps, Q.SEED)
                         .select("row_id", "category", "label", "chunk_idx", "chunk_rows"))
    nested = (chunks.withColumn("step", F.explode(F.sequence(F.col("chunk_idx"), F.lit(steps))))
              .withColumn("head", head(CATS, "step", steps)))
    model, feats, tasks = fitted(MD.terms(spark, sf_dir), nested, len(CATS) * steps, **kw)
    sizes = chunks.groupBy("category").agg(F.max("chunk_rows").alias("chunk_rows"))  # one row per category
    test = (h.where(F.col("split") == SP.TEST).select("row_id", "category", "label").join(F.broadcast(sizes), "category")
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
            .withColumn("head", head(CATS, "step", steps)).withColumn("train_size", F.col("step") * F.col("chunk_rows")))
    return LI.score(feats, test, model), LI.score(feats, tasks, model)


def checked(scored: DataFrame, trained: DataFrame, keys) -> DataFrame:
    """Per group: rows scored with a probability, and the sum of the training rows' probabilities."""
    good = F.col("prob").between(0, 1) & ~F.isnan("prob")
    heads = scored.select("head", *keys).distinct()
    sums = trained.groupBy("head").agg(F.round(F.sum("prob"), 1).alias("train_positives"),
                                       F.count(F.lit(1)).alias("n_train"))
    return (scored.groupBy("head").agg(F.sum(good.cast("long")).alias("n_scored")).join(sums, "head").join(heads, "head")
            .select(*keys, "n_train", "train_positives", "n_scored"))


def _twin(sql: str, train: str, score: str, keys: str) -> str:
    return f"""{sql},
fa AS (SELECT {keys}, count(*) AS n_train, CAST(sum(label) AS DOUBLE) AS train_positives FROM {train} GROUP BY {keys}),
fb AS (SELECT {keys}, count(*) AS n_scored FROM {score} GROUP BY {keys})
SELECT {keys}, n_train, train_positives, n_scored FROM fa JOIN fb USING ({keys})
"""


@register("fit_multilabel_joint", _twin(Q.SQL_PLAIN + MD.ML_LONG_PART + """,
mtr AS (SELECT * FROM mll WHERE split = 'train'), mte AS (SELECT * FROM mll WHERE split = 'test')""", "mtr", "mte", "category"))
def fit_multilabel_joint(spark, sf_dir):
    """All heads of the multi-label model fitted in one pass a step."""
    return checked(*multilabel_lr(spark, sf_dir), ["category"])


@register("fit_multitask_shared", _twin(Q.SQL_AGREED + f""",
tmx AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {MD.S.md5_key(Q.SEED, "'mix'", 'category', 'row_id')}) AS mix_rank,
               count(*) OVER (PARTITION BY category) AS _n FROM ha WHERE split = 'train'),
tmm AS (SELECT row_id, category, label FROM (SELECT *, min(_n) OVER () AS _min FROM tmx) WHERE mix_rank <= _min),
tte AS (SELECT * FROM ha WHERE split = 'test')""", "tmm", "tte", "category"))
def fit_multitask_shared(spark, sf_dir):
    """A head for each task over one encoder, learnt from the even mix of the tasks' rows."""
    return checked(*multitask_lr(spark, sf_dir), ["category"])


@register("cv_results_lr", _twin(Q.SQL_KFOLD + f""",
fv AS (SELECT kf.row_id, kf.category, kf.label, v.view AS fold
       FROM kf, (SELECT unnest(generate_series(1, {Q.K})) AS view) v WHERE kf.fold <> v.view)""", "fv", "kf", "category, fold"))
def cv_results_lr(spark, sf_dir):
    """All fold models of all categories fitted in one pass a step."""
    return checked(*cv_lr(spark, sf_dir), ["category", "fold"])


@register("learning_curve_lr", _twin(Q.SQL_HOLDOUT + Q.SQL_SUBSETS + """,
gz AS (SELECT DISTINCT category, train_size FROM gs),
gte AS (SELECT h.row_id, h.category, h.label, gz.train_size FROM h JOIN gz ON h.category = gz.category
        WHERE h.split = 'test')""", "gs", "gte", "category, train_size"))
def learning_curve_lr(spark, sf_dir):
    """All growing subsets' models of all categories fitted in one pass a step."""
    return checked(*curve_lr(spark, sf_dir), ["category", "train_size"])
