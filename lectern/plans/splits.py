"""Registered split queries: hold-outs, folds, subsets, mixing, votes."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from ..operators import labels as LO
from ..operators import split as SP
from ..operators.ranking import materialize, shuffle_key
from ..sources import tables as ST
from . import sqltext as S
from .registry import register

CATS = list(ST.DEFAULT_CATEGORIES)
SHARE = Fraction(1, 6)
K = 5
SEED = 1
# Learning-curve subsets per category (the reference's 500 to 2,500 rows by 500).
STEPS = 5
N_ANNOTATORS = 3


# --------------------------------------------------------------------------- spark side
def labels_wide(spark, sf_dir):
    return (ST.table(spark, sf_dir, "labels")
            .select(F.col("doc_id").alias("row_id"), "doc_id", *CATS))


def labels_long(spark, sf_dir):
    return LO.to_long(labels_wide(spark, sf_dir), CATS)


def holdout(spark, sf_dir):
    return SP.holdout_stratified(labels_long(spark, sf_dir), SHARE, SEED)


def kfold(spark, sf_dir):
    train = holdout(spark, sf_dir).where(F.col("split") == SP.TRAIN)
    return SP.kfold_stratified(train, K, SEED)


def plain_holdout(spark, sf_dir):
    return SP.holdout_plain(labels_wide(spark, sf_dir), SHARE, SEED)


def synthetic_votes(long_df, seed=SEED, n=N_ANNOTATORS):
    """Test-data stand-in for annotator votes: each vote flips the label when the first hex
    digit of ``md5(seed|vote|category|row_id|annotator)`` is 0, 1 or 2."""
    v = long_df.withColumn("annotator", F.explode(F.sequence(F.lit(1), F.lit(n))))
    flip = F.substring(shuffle_key(seed, "vote", F.col("category"), F.col("row_id"), F.col("annotator")), 1, 1)
    return v.withColumn("vote", F.when(flip.isin("0", "1", "2"), 1 - F.col("label")).otherwise(F.col("label")))


def majority(spark, sf_dir):
    votes = synthetic_votes(labels_long(spark, sf_dir))
    return LO.majority_vote(votes, keys=("row_id", "doc_id", "category"))


# --------------------------------------------------------------------------- SQL side
SQL_LONG = """l AS (SELECT doc_id AS row_id, doc_id, 'quality' AS category, quality AS label FROM labels
  UNION ALL SELECT doc_id AS row_id, doc_id, 'toxic' AS category, toxic AS label FROM labels)"""


def sql_holdout(src: str, out: str) -> str:
    key = S.md5_key(SEED, "'holdout'", "category", "row_id")
    return f""",
{out}_k AS (SELECT *, {key} AS _key FROM {src}),
{out}_s AS (SELECT category, label, count(*) AS n_c FROM {src} GROUP BY category, label),
{out}_q1 AS (SELECT *, sum(n_c) OVER (PARTITION BY category) AS _n FROM {out}_s),
{out}_q2 AS (SELECT *, (_n * {SHARE.numerator} + {SHARE.denominator - 1}) // {SHARE.denominator} AS _n_test FROM {out}_q1),
{out}_q3 AS (SELECT *, _n - _n_test AS _n_train, (n_c * (_n - _n_test)) // _n AS _fl,
                   (n_c * (_n - _n_test)) % _n AS _rem FROM {out}_q2),
{out}_q4 AS (SELECT *, _n_train - sum(_fl) OVER (PARTITION BY category) AS _need,
                   row_number() OVER (PARTITION BY category ORDER BY _rem DESC, label) AS _rk FROM {out}_q3),
{out}_q AS (SELECT category, label, n_c - _fl - CASE WHEN _rk <= _need THEN 1 ELSE 0 END AS test_quota FROM {out}_q4),
{out} AS (SELECT k.* EXCLUDE (_key),
                 CASE WHEN row_number() OVER (PARTITION BY k.category, k.label ORDER BY k._key) <= q.test_quota
                      THEN 'test' ELSE 'train' END AS split
          FROM {out}_k k JOIN {out}_q q ON k.category = q.category AND k.label = q.label)"""


def sql_kfold(src: str, out: str) -> str:
    key = S.md5_key(SEED, "'kfold'", "category", "row_id")
    return f""",
{out} AS (SELECT *, CAST((row_number() OVER (PARTITION BY category ORDER BY label, {key}) - 1) % {K} + 1 AS INTEGER) AS fold
          FROM {src} WHERE split = 'train')"""


SQL_HOLDOUT = "WITH " + SQL_LONG + sql_holdout("l", "h")
SQL_KFOLD = SQL_HOLDOUT + sql_kfold("h", "kf")

PLAIN_PART = f"""w AS (SELECT doc_id AS row_id, doc_id FROM labels),
r AS (SELECT *, row_number() OVER (ORDER BY {S.md5_key(SEED, "'holdout'", 'row_id')}) AS _r,
             count(*) OVER () AS _n FROM w),
p AS (SELECT row_id, doc_id, CASE WHEN _r <= (_n * {SHARE.numerator} + {SHARE.denominator - 1}) // {SHARE.denominator}
                            THEN 'test' ELSE 'train' END AS split FROM r)"""
SQL_PLAIN = "WITH " + PLAIN_PART


@register("holdout_stratified", SQL_HOLDOUT + """
SELECT row_id, doc_id, category, label, split FROM h
""")
def holdout_stratified(spark, sf_dir):
    return holdout(spark, sf_dir).select("row_id", "doc_id", "category", "label", "split")


@register("holdout_plain", SQL_PLAIN + """
SELECT row_id, doc_id, split FROM p
""")
def holdout_plain(spark, sf_dir):
    return plain_holdout(spark, sf_dir).select("row_id", "doc_id", "split")


@register("kfold_stratified", SQL_KFOLD + """
SELECT row_id, category, label, fold FROM kf
""")
def kfold_stratified(spark, sf_dir):
    return kfold(spark, sf_dir).select("row_id", "category", "label", "fold")


@register("kfold_plain", SQL_PLAIN + f""",
t AS (SELECT * FROM p WHERE split = 'train')
SELECT row_id, CAST(ntile({K}) OVER (ORDER BY {S.md5_key(SEED, "'kfold'", 'row_id')}) AS INTEGER) AS fold FROM t
""")
def kfold_plain(spark, sf_dir):
    train = plain_holdout(spark, sf_dir).where(F.col("split") == SP.TRAIN)
    return SP.kfold_plain(train, K, SEED).select("row_id", "fold")


@register("fold_views", SQL_KFOLD + f"""
SELECT row_id, category, fold, CAST(v.view AS INTEGER) AS view,
       CASE WHEN fold = v.view THEN 'val' ELSE 'train' END AS role
FROM kf, (SELECT unnest(generate_series(1, {K})) AS view) v
""")
def fold_views(spark, sf_dir):
    return SP.fold_views(kfold(spark, sf_dir), K).select("row_id", "category", "fold", "view", "role")


SQL_SUBSETS = f""",
gt AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {S.md5_key(SEED, "'subset'", 'category', 'row_id')}) AS _r,
              count(*) OVER (PARTITION BY category) // {STEPS} AS _c FROM h WHERE split = 'train'),
gs AS (SELECT row_id, category, label, CAST(_j * _c AS INTEGER) AS train_size FROM
       (SELECT *, unnest(generate_series((_r + _c - 1) // _c, {STEPS})) AS _j FROM gt WHERE _r <= _c * {STEPS}))"""


@register("growing_subsets", SQL_HOLDOUT + SQL_SUBSETS + """
SELECT row_id, category, train_size FROM gs
""")
def growing_subsets(spark, sf_dir):
    train = holdout(spark, sf_dir).where(F.col("split") == SP.TRAIN)
    return SP.growing_subsets(train, STEPS, SEED).select("row_id", "category", "train_size")


SQL_VOTES = f""",
v AS (SELECT l.*, a.annotator,
             CASE WHEN substr({S.md5_key(SEED, "'vote'", 'category', 'row_id', 'a.annotator')}, 1, 1) IN ('0', '1', '2')
                  THEN 1 - label ELSE label END AS vote
      FROM l, (SELECT unnest(generate_series(1, {N_ANNOTATORS})) AS annotator) a),
mv AS (SELECT row_id, doc_id, category, CAST(sum(vote) * 2 > count(*) AS INTEGER) AS label,
              min(vote) = max(vote) AS full_agree, count(*) AS n_votes
       FROM v GROUP BY row_id, doc_id, category)"""


# Multi-task rows: majority labels, training on fully agreed rows only, so that categories
# differ in size and the mix has something to even out.
SQL_AGREED = "WITH " + SQL_LONG + SQL_VOTES + sql_holdout("mv", "h") + """,
ha AS (SELECT * FROM h WHERE split <> 'train' OR full_agree)"""


def agreed_holdout(spark, sf_dir):
    h = SP.holdout_stratified(majority(spark, sf_dir), SHARE, SEED)
    return h.where((F.col("split") != SP.TRAIN) | F.col("full_agree"))


@register("task_mix", SQL_AGREED + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {S.md5_key(SEED, "'mix'", 'category', 'row_id')}) AS mix_rank,
             count(*) OVER (PARTITION BY category) AS _n FROM ha WHERE split = 'train'),
m AS (SELECT *, min(_n) OVER () AS _min FROM t)
SELECT row_id, category, mix_rank,
       CAST((mix_rank - 1) * {len(CATS)} + list_position(['quality', 'toxic'], category) AS BIGINT) AS mix_pos
FROM m WHERE mix_rank <= _min
""")
def task_mix(spark, sf_dir):
    train = materialize(agreed_holdout(spark, sf_dir).where(F.col("split") == SP.TRAIN).select("row_id", "category"))
    return SP.task_mix(train, CATS, SEED).select("row_id", "category", "mix_rank", "mix_pos")


@register("majority_vote", "WITH " + SQL_LONG + SQL_VOTES + """
SELECT row_id, category, label, full_agree, n_votes FROM mv
""")
def majority_vote(spark, sf_dir):
    return majority(spark, sf_dir).select("row_id", "category", "label", "full_agree", "n_votes")


@register("full_agreement_train", "WITH " + SQL_LONG + SQL_VOTES + sql_holdout("mv", "h") + """
SELECT row_id, category, label, split FROM h WHERE split <> 'train' OR full_agree
""")
def full_agreement_train(spark, sf_dir):
    return agreed_holdout(spark, sf_dir).select("row_id", "category", "label", "split")


@register("holdout_check", SQL_HOLDOUT + """,
tr AS (SELECT category, row_id FROM h WHERE split = 'train'),
te AS (SELECT category, row_id FROM h WHERE split = 'test'),
bo AS (SELECT category, count(*) AS n_both FROM (SELECT * FROM tr INTERSECT SELECT * FROM te) GROUP BY category),
mi AS (SELECT category, count(*) AS n_missing FROM
       (SELECT category, row_id FROM l EXCEPT ALL (SELECT * FROM tr UNION ALL SELECT * FROM te)) GROUP BY category),
sz AS (SELECT category, count(*) AS n_rows,
              CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
              CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test FROM h GROUP BY category)
SELECT sz.category, n_rows, n_train, n_test, coalesce(n_both, 0) AS n_both, coalesce(n_missing, 0) AS n_missing
FROM sz LEFT JOIN bo ON sz.category = bo.category LEFT JOIN mi ON sz.category = mi.category
""")
def holdout_check(spark, sf_dir):
    """The hold-out is a disjoint and complete partition of every category's rows."""
    return SP.check_partition(labels_long(spark, sf_dir), materialize(holdout(spark, sf_dir)))
