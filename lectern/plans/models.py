"""Registered fit/score/evaluate queries (binary, multi-label, multi-task, CV, learning curve)
and the review-level prevalence, all on the Naive Bayes model of ``operators.bayes``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bayes as NB
from ..operators import labels as LO
from ..operators import lang as LG
from ..operators import metrics as M
from ..operators import sentences as SO
from ..operators import split as SP
from ..operators.ranking import materialize
from ..sources import tables as ST
from . import splits as Q
from . import sqltext as S
from .registry import register

CATS = Q.CATS
ML_CATS = [ST.NONE_CATEGORY] + CATS
DIGITS = 6


# --------------------------------------------------------------------------- spark side
def texts(spark, sf_dir) -> DataFrame:
    """Labelled rows with their whole document text."""
    return ST.labelled_rows(spark, sf_dir, CATS).select("row_id", "doc_id", F.col("sentence").alias("text"))


def terms(spark, sf_dir) -> DataFrame:
    """The term counts of all labelled texts, staged once and shared by fits and scores."""
    return materialize(NB.term_counts(texts(spark, sf_dir)))


def numbered(df: DataFrame, cats, groups=None) -> DataFrame:
    """Adds ``cell``: the position of a row's (category, group), groups counted from 1."""
    at = F.array_position(F.array(*[F.lit(c) for c in cats]), F.col("category")).cast("int") - 1
    return df.withColumn("cell", at if groups is None else at * groups + F.col("fold") - 1)


def per_category(tf, h, cats, strict=False, mix=None, carry=()):
    """One model per category on its training rows, applied to its test rows."""
    rows = numbered(h, cats)
    train = rows.where(F.col("split") == SP.TRAIN)
    test = rows.where(F.col("split") == SP.TEST)
    weights, bias = NB.fit(tf, train, len(cats), [[c] for c in range(len(cats))], mix=mix,
                           views=None if mix is None else [0] * len(cats))
    # the test rows' counts alone meet the weights
    asked = tf.join(materialize(test.select("row_id").distinct()), "row_id", "left_semi")
    return NB.score(asked, test.select("row_id", "category", "label", F.col("cell").alias("m"), *carry),
                    weights, bias, len(cats), strict=strict)


def per_fold(tf, kf, cats, mix=None):
    """Every fold model of every category at once: a fold model's counts are the sum of the
    other folds' cells, and a row is scored by its own fold's model."""
    rows, weights, bias = fold_models(tf, kf, cats, mix)
    return NB.score(tf, rows.select("row_id", "category", "label", "fold", F.col("cell").alias("m")),
                    weights, bias, len(cats) * Q.K)


def fold_models(tf, kf, cats, mix=None):
    """``(rows with their cell, weights, bias)`` of all fold models; a cell's model is that of its
    category without its fold."""
    rows = numbered(kf, cats, Q.K)
    trains = [[c * Q.K + g for g in range(Q.K) if g != f] for c in range(len(cats)) for f in range(Q.K)]
    return rows, *NB.fit(tf, rows, len(cats) * Q.K, trains, mix=mix,
                         views=None if mix is None else [f for _ in cats for f in range(Q.K)])


def binary_scores(spark, sf_dir, h=None, tf=None):
    """One model per category on its stratified training rows, applied to its test rows."""
    h = h if h is not None else materialize(Q.holdout(spark, sf_dir))
    return per_category(tf if tf is not None else terms(spark, sf_dir), h, CATS, carry=("doc_id",))


def multilabel_long(spark, sf_dir):
    wide = LO.add_none(Q.labels_wide(spark, sf_dir), CATS, after="doc_id")
    split = SP.holdout_plain(wide, Q.SHARE, Q.SEED)
    return materialize(LO.to_long(split, ML_CATS, extra_cols=("split",)))


def multilabel_scores(spark, sf_dir, strict=False, tf=None):
    """One head per category (``none`` included) on the same training rows. Predictions take
    ``>= 0.5``; ``strict`` gives the training summary's ``> 0.5``."""
    return per_category(tf if tf is not None else terms(spark, sf_dir), multilabel_long(spark, sf_dir), ML_CATS,
                        strict=strict, carry=("doc_id",))


def multitask_scores(spark, sf_dir, tf=None):
    """Heads that share what the evenly mixed training rows of all categories say about tokens:
    a head's smoothing follows the mix's token distribution, so rows of one task change the
    model of another."""
    h = materialize(Q.agreed_holdout(spark, sf_dir).select("row_id", "doc_id", "category", "label", "split"))
    mix = SP.task_mix(h.where(F.col("split") == SP.TRAIN).select("row_id", "category"), CATS, Q.SEED)
    return per_category(tf if tf is not None else terms(spark, sf_dir), h, CATS, carry=("doc_id",),
                        mix=mix.select("row_id", F.lit(0).alias("view")))


def cv_scores(spark, sf_dir):
    """Stratified folds per category."""
    kf = materialize(Q.kfold(spark, sf_dir).select("row_id", "category", "label", "fold"))
    return per_fold(terms(spark, sf_dir), kf, CATS)


def cv_multilabel_scores(spark, sf_dir):
    """Plain folds over the training rows: a row is in one fold for all categories."""
    lng = multilabel_long(spark, sf_dir).where(F.col("split") == SP.TRAIN)
    folds = SP.kfold_plain(lng.select("row_id").distinct(), Q.K, Q.SEED)
    kf = materialize(lng.join(folds, "row_id").select("row_id", "category", "label", "fold"))
    return per_fold(terms(spark, sf_dir), kf, ML_CATS)


def cv_multitask_scores(spark, sf_dir):
    """Stratified folds of the agreed training rows; each fold model has the even mix of its own
    training part."""
    h = Q.agreed_holdout(spark, sf_dir).where(F.col("split") == SP.TRAIN)
    kf = materialize(SP.kfold_stratified(h, Q.K, Q.SEED).select("row_id", "category", "label", "fold"))
    views = SP.fold_views(kf, Q.K).where("role = 'train'").select("row_id", "category", "view")
    mix = SP.task_mix(views, CATS, Q.SEED, within="view")
    return per_fold(terms(spark, sf_dir), kf, CATS, mix=mix.select("row_id", (F.col("view") - 1).alias("view")))


def curve_scores(spark, sf_dir):
    """Every subset model of every category: tokens are counted once per chunk, a subset model
    sums its first chunks inside the token's row; the fixed test rows are scored by all."""
    h = materialize(Q.holdout(spark, sf_dir))
    steps = Q.STEPS
    chunks = materialize(SP.subset_chunks(h.where(F.col("split") == SP.TRAIN), steps, Q.SEED)
                         .select("row_id", "category", "label", F.col("chunk_idx").alias("fold"), "chunk_rows"))
    trains = [[c * steps + g for g in range(j + 1)] for c in range(len(CATS)) for j in range(steps)]
    tf = terms(spark, sf_dir)
    weights, bias = NB.fit(tf, numbered(chunks, CATS, steps), len(trains), trains)
    sizes = chunks.groupBy("category").agg(F.max("chunk_rows").alias("chunk_rows"))  # one row per category
    test = (h.where(F.col("split") == SP.TEST).join(F.broadcast(sizes), "category")
            .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(steps)))))
    rows = numbered(test, CATS, steps).select("row_id", "category", "label", F.col("cell").alias("m"),
                                              (F.col("fold") * F.col("chunk_rows")).alias("train_size"))
    return NB.score(tf, rows, weights, bias, len(trains))


def rounded(df, cols):
    return M.round_columns(df, cols, DIGITS)


def final_models(spark, sf_dir):
    h = materialize(Q.holdout(spark, sf_dir))
    train = numbered(h.where(F.col("split") == SP.TRAIN), CATS)
    return NB.fit(NB.term_counts(texts(spark, sf_dir)), train, len(CATS), [[c] for c in range(len(CATS))])


def english_sentences(spark, sf_dir):
    docs = ST.documents(spark, sf_dir).select("doc_id", "text")
    en, _ = LG.language_gate(docs)
    cleaned = SO.clean_documents(en)
    return SO.sentences(cleaned)


def sentence_scores(spark, sf_dir):
    """Every sentence of every English review scored by every category model."""
    from ..operators import prevalence as PV
    weights, bias = final_models(spark, sf_dir)
    return PV.score_sentences(english_sentences(spark, sf_dir), weights, bias, CATS)


# --------------------------------------------------------------------------- SQL side
SQL_TEXTS = f""",
tx AS (SELECT l.doc_id AS row_id, l.doc_id, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
tt AS (SELECT row_id, unnest({S.tokens(S.model_text('text'))}) AS token FROM tx)"""


def sql_sigmoid(margin: str) -> str:
    e = f"exp(-abs({margin}))"
    return f"CASE WHEN {margin} >= 0 THEN 1.0 / (1.0 + {e}) ELSE {e} / (1.0 + {e}) END"


def sql_nb(train: str, score: str, keys, out: str, strict: bool = False, mix: str | None = None,
           view: str | None = None) -> str:
    """Fit and score CTEs. ``mix`` names the mixed rows of the shared smoothing (with the
    column ``view`` if there is a mix per view)."""
    k = ", ".join(keys)
    cmp = ">" if strict else ">="
    a = NB.ALPHA
    vk = f"{view}, " if view else ""
    von = f"USING ({view}, token)" if view else "USING (token)"
    if mix is None:
        model = f""",
{out}_w AS (SELECT {k}, token,
                   ln((CAST(n1 AS DOUBLE) + {a}) / (CAST(tot1 AS DOUBLE) + {a} * vocab_size))
                 - ln((CAST(n0 AS DOUBLE) + {a}) / (CAST(tot0 AS DOUBLE) + {a} * vocab_size)) AS weight
            FROM {out}_cnt JOIN {out}_head USING ({k}))"""
    else:
        cross = f"JOIN {out}_vs USING ({view})" if view else f", {out}_vs"
        heads = f"JOIN {out}_u USING ({view})" if view else f", {out}_u"
        model = f""",
{out}_u AS (SELECT DISTINCT {vk}token FROM {out}_cnt),
{out}_mc AS (SELECT {"m." + view + ", " if view else ""}t.token, count(*) AS mixed FROM {mix} m JOIN tt t ON m.row_id = t.row_id
             GROUP BY {"m." + view + ", " if view else ""}t.token),
{out}_vs AS (SELECT {vk}count(*) AS v, sum(coalesce(mixed, 0)) AS mixed_all FROM {out}_u LEFT JOIN {out}_mc {von}
             {"GROUP BY " + view if view else ""}),
{out}_g AS (SELECT {k}, token, tot1, tot0, v, (coalesce(mixed, 0) + 1.0) / (mixed_all + v) AS p
            FROM {out}_head {heads} LEFT JOIN {out}_mc {von} {cross}),
{out}_w AS (SELECT {k}, token,
                   ln((coalesce(n1, 0) + {a} * v * p) / (CAST(tot1 AS DOUBLE) + {a} * v))
                 - ln((coalesce(n0, 0) + {a} * v * p) / (CAST(tot0 AS DOUBLE) + {a} * v)) AS weight
            FROM {out}_g LEFT JOIN {out}_cnt USING ({k}, token))"""
    return f""",
{out}_tr AS (SELECT {', '.join('a.' + x for x in keys)}, a.label, t.token FROM {train} a JOIN tt t ON a.row_id = t.row_id),
{out}_cnt AS (SELECT {k}, token, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS n1,
                     sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n0 FROM {out}_tr GROUP BY {k}, token),
{out}_tot AS (SELECT {k}, sum(n1) AS tot1, sum(n0) AS tot0, count(*) AS vocab_size FROM {out}_cnt GROUP BY {k}),
{out}_pri AS (SELECT {k}, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS docs1,
                     sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS docs0 FROM {train} GROUP BY {k}),
{out}_head AS (SELECT * FROM {out}_tot JOIN {out}_pri USING ({k})){model},
{out}_b AS (SELECT {k}, ln((CAST(docs1 AS DOUBLE) + {a}) / (CAST(docs0 AS DOUBLE) + {a})) AS bias FROM {out}_head),
{out}_st AS (SELECT s.row_id, {', '.join('s.' + x for x in keys)}, s.label, t.token
             FROM {score} s LEFT JOIN tt t ON s.row_id = t.row_id),
{out}_ss AS (SELECT row_id, {k}, label, sum(coalesce(weight, 0.0)) AS _s
             FROM {out}_st LEFT JOIN {out}_w USING ({k}, token) GROUP BY row_id, {k}, label),
{out}_m AS (SELECT ss.*, coalesce(bias, 0.0) + _s AS margin FROM {out}_ss ss LEFT JOIN {out}_b USING ({k})),
{out}_p AS (SELECT *, {sql_sigmoid('margin')} AS prob FROM {out}_m),
{out} AS (SELECT *, CAST(prob {cmp} 0.5 AS INTEGER) AS pred FROM {out}_p)"""


def sql_metrics(src: str, keys, name: str = "") -> str:
    """The fourteen metrics per group, rounded, from a CTE with label/pred columns."""
    k = ", ".join(keys)
    sel = (k + ", ") if keys else ""
    grp = f" GROUP BY {k}" if keys else ""

    def div(a, b):
        return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"

    def mean(v1, v0, h1, h0):
        kk = f"(CAST({h1} AS INTEGER) + CAST({h0} AS INTEGER))"
        s = f"(CASE WHEN {h1} THEN {v1} ELSE 0.0 END + CASE WHEN {h0} THEN {v0} ELSE 0.0 END)"
        return f"CASE WHEN {kk} > 0 THEN {s} / {kk} ELSE 0.0 END"

    acc = div("tp + tn", "tp + fp + fn + tn")
    p1, p0 = div("tp", "tp + fp"), div("tn", "tn + fn")
    r1, r0 = div("tp", "tp + fn"), div("tn", "tn + fp")
    f1, f0 = div("2 * tp", "2 * tp + fp + fn"), div("2 * tn", "2 * tn + fn + fp")
    s1, s0 = "(tp + fp + fn) > 0", "(tn + fp + fn) > 0"
    t1, t0 = "(tp + fn) > 0", "(tn + fp) > 0"
    vals = {
        "accuracy": acc, "balanced_accuracy": mean(r1, r0, t1, t0),
        "f1_macro": mean(f1, f0, s1, s0), "f1_micro": acc, "f1_label1": f1, "f1_label0": f0,
        "precision_macro": mean(p1, p0, s1, s0), "precision_micro": acc,
        "precision_label1": p1, "precision_label0": p0,
        "recall_macro": mean(r1, r0, s1, s0), "recall_micro": acc,
        "recall_label1": r1, "recall_label0": r0,
    }
    cols = ",\n       ".join(f"round({vals[m]}, {DIGITS}) AS {m}" for m in M.METRICS)
    return f"""
{name}conf AS (SELECT {sel}
       CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM {src}{grp})
SELECT {sel}{cols}
FROM {name}conf"""


def sql_metrics_unrounded(src: str, keys) -> str:
    return sql_metrics(src, keys).replace(f"round(", "(").replace(f", {DIGITS}) AS", ") AS")


BIN_PART = """,
btr AS (SELECT row_id, category, label FROM h WHERE split = 'train'),
bte AS (SELECT row_id, category, label FROM h WHERE split = 'test')""" + sql_nb("btr", "bte", ["category"], "bs")
SQL_BIN = Q.SQL_HOLDOUT + SQL_TEXTS + BIN_PART

ML_LONG_PART = """,
mlw AS (SELECT p.row_id, p.split, CAST(l.quality + l.toxic = 0 AS INTEGER) AS "none", l.quality, l.toxic
        FROM p JOIN labels l ON p.row_id = l.doc_id),
mll AS (SELECT row_id, split, 'none' AS category, "none" AS label FROM mlw
        UNION ALL SELECT row_id, split, 'quality', quality FROM mlw
        UNION ALL SELECT row_id, split, 'toxic', toxic FROM mlw)"""
ML_PART = ML_LONG_PART + """,
mtr AS (SELECT row_id, category, label FROM mll WHERE split = 'train'),
mte AS (SELECT row_id, category, label FROM mll WHERE split = 'test')""" + sql_nb("mtr", "mte", ["category"], "ms")
SQL_ML = Q.SQL_PLAIN + SQL_TEXTS + ML_PART
SQL_ML_STRICT = SQL_ML + ",\nmx AS (SELECT * EXCLUDE (pred), CAST(prob > 0.5 AS INTEGER) AS pred FROM ms)"

# The multi-task rows have majority labels of their own: their hold-out is ``ha``.
MT_PART = f""",
tmx AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {S.md5_key(Q.SEED, "'mix'", 'category', 'row_id')}) AS mix_rank,
               count(*) OVER (PARTITION BY category) AS _n FROM ha WHERE split = 'train'),
tmm AS (SELECT row_id FROM (SELECT *, min(_n) OVER () AS _min FROM tmx) WHERE mix_rank <= _min),
ttr AS (SELECT row_id, category, label FROM ha WHERE split = 'train'),
tte AS (SELECT row_id, category, label FROM ha WHERE split = 'test')""" + sql_nb("ttr", "tte", ["category"], "ts", mix="tmm")
SQL_MT = Q.SQL_AGREED + SQL_TEXTS + MT_PART

SQL_CV = Q.SQL_KFOLD + SQL_TEXTS + f""",
fv AS (SELECT kf.row_id, kf.category, kf.label, v.view AS fold
       FROM kf, (SELECT unnest(generate_series(1, {Q.K})) AS view) v WHERE kf.fold <> v.view),
fs AS (SELECT row_id, category, label, fold FROM kf)""" + sql_nb("fv", "fs", ["category", "fold"], "cs")

SQL_CV_ML = Q.SQL_PLAIN + SQL_TEXTS + ML_LONG_PART + f""",
pf AS (SELECT row_id, CAST(ntile({Q.K}) OVER (ORDER BY {S.md5_key(Q.SEED, "'kfold'", 'row_id')}) AS INTEGER) AS fold
       FROM p WHERE split = 'train'),
kf AS (SELECT mll.row_id, mll.category, mll.label, pf.fold FROM mll JOIN pf ON mll.row_id = pf.row_id),
fv AS (SELECT kf.row_id, kf.category, kf.label, v.view AS fold
       FROM kf, (SELECT unnest(generate_series(1, {Q.K})) AS view) v WHERE kf.fold <> v.view)""" + sql_nb(
    "fv", "kf", ["category", "fold"], "cs")

SQL_CV_MT = Q.SQL_AGREED + Q.sql_kfold("ha", "kf") + SQL_TEXTS + f""",
fv AS (SELECT kf.row_id, kf.category, kf.label, v.view AS fold
       FROM kf, (SELECT unnest(generate_series(1, {Q.K})) AS view) v WHERE kf.fold <> v.view),
fx AS (SELECT *, row_number() OVER (PARTITION BY category, fold ORDER BY {S.md5_key(Q.SEED, "'mix'", 'category', 'row_id')}) AS mix_rank,
              count(*) OVER (PARTITION BY category, fold) AS _n FROM fv),
fm AS (SELECT row_id, fold FROM (SELECT *, min(_n) OVER (PARTITION BY fold) AS _min FROM fx) WHERE mix_rank <= _min),
fs AS (SELECT row_id, category, label, fold FROM kf)""" + sql_nb("fv", "fs", ["category", "fold"], "cs", mix="fm", view="fold")

SQL_CURVE = Q.SQL_HOLDOUT + SQL_TEXTS + Q.SQL_SUBSETS + """,
gz AS (SELECT DISTINCT category, train_size FROM gs),
gte AS (SELECT h.row_id, h.category, h.label, gz.train_size FROM h JOIN gz ON h.category = gz.category
        WHERE h.split = 'test')""" + sql_nb("gs", "gte", ["category", "train_size"], "lc")


# --------------------------------------------------------------------------- queries
@register("score_binary", SQL_BIN + f"""
SELECT row_id, category, label, round(prob, {DIGITS}) AS prob, pred FROM bs
""")
def score_binary(spark, sf_dir):
    return rounded(binary_scores(spark, sf_dir).select("row_id", "category", "label", "prob", "pred"), ["prob"])


# What a model of MAX_LENGTH places reads: the tokens that fixed-length ids hold.
MAX_LENGTH = 256
SQL_BIN_TRUNCATED = SQL_BIN.replace(f"unnest({S.tokens(S.model_text('text'))})",
                                    f"unnest(({S.tokens(S.model_text('text'))})[1:{MAX_LENGTH - 2}])")


@register("score_binary_truncated", SQL_BIN_TRUNCATED + f"""
SELECT row_id, category, label, round(prob, {DIGITS}) AS prob, pred FROM bs
""")
def score_binary_truncated(spark, sf_dir):
    """Fitted on and applied to the tokens that fit MAX_LENGTH places with start and end."""
    tf = materialize(NB.term_counts(texts(spark, sf_dir), max_length=MAX_LENGTH))
    return rounded(binary_scores(spark, sf_dir, tf=tf).select("row_id", "category", "label", "prob", "pred"), ["prob"])


@register("eval_metrics_user", SQL_CV + f""",
uc AS (SELECT category, CAST(sum(CAST(label = 1 AND pred = 1 AS INTEGER)) AS DOUBLE) AS tp,
              CAST(sum(CAST(label = 0 AND pred = 1 AS INTEGER)) AS DOUBLE) AS fp,
              CAST(sum(CAST(label = 1 AND pred = 0 AS INTEGER)) AS DOUBLE) AS fn,
              CAST(sum(CAST(label = 0 AND pred = 0 AS INTEGER)) AS DOUBLE) AS tn,
              avg((prob - label) * (prob - label)) AS brier FROM cs GROUP BY category)
SELECT category, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0), {{DIGITS}}) AS mcc,
       round(brier, {{DIGITS}}) AS brier FROM uc
""".replace("{DIGITS}", str(DIGITS)))
def eval_metrics_user(spark, sf_dir):
    """Two metrics given as mergeable states: summed per fold, merged to the category, finished."""
    own = [M.MATTHEWS, M.BRIER]
    per_fold = M.metric_states(cv_scores(spark, sf_dir), ["category", "fold"], own)
    return rounded(M.finish_states(M.merge_states(per_fold, ["category"]), ["category"], own), ["mcc", "brier"])


@register("eval_metrics", SQL_BIN + "," + sql_metrics("bs", ["category"]))
def eval_metrics(spark, sf_dir):
    return rounded(M.eval_metrics(binary_scores(spark, sf_dir), ["category"]), M.METRICS)


@register("trainer_metrics", SQL_BIN + f""",
conf AS (SELECT category,
       sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn,
       sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn FROM bs GROUP BY category)
SELECT category,
       round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0), {DIGITS}) AS accuracy,
       round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0), {DIGITS}) AS f1,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), {DIGITS}) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), {DIGITS}) AS recall
FROM conf
""")
def trainer_metrics(spark, sf_dir):
    return rounded(M.trainer_metrics(binary_scores(spark, sf_dir), ["category"]), M.TRAINER_METRICS)


@register("softmax_labels", SQL_ML + f"""
, top AS (SELECT row_id, max(margin) AS most FROM ms GROUP BY row_id),
ex AS (SELECT row_id, category, exp(margin - most) AS e FROM ms JOIN top USING (row_id))
SELECT row_id, category, round(e / sum(e) OVER (PARTITION BY row_id), {DIGITS}) AS share FROM ex
""")
def softmax_labels(spark, sf_dir):
    """The multi-label margins of a row as one distribution over its categories (softmax)."""
    from ..functions import scoring as SC
    listed = (multilabel_scores(spark, sf_dir).groupBy("row_id")  # a row's categories
              .agg(F.array_sort(F.collect_list(F.struct("category", "margin"))).alias("c"))
              .select("row_id", F.arrays_zip(F.col("c.category").alias("category"),
                                             SC.softmax(F.col("c.margin")).alias("share")).alias("c")))
    return rounded(listed.select("row_id", F.inline("c")).toDF("row_id", "category", "share"), ["share"])


@register("argmax_label", SQL_BIN + f"""
, arr AS (SELECT row_id, category, [1.0 - prob, prob] AS scores FROM bs)
SELECT row_id, category,
       ['no', 'yes'][list_position(scores, list_max(scores))] AS top_label,
       round(list_max(scores), {DIGITS}) AS top_score
FROM arr
""")
def argmax_label(spark, sf_dir):
    """Two-class score list per row (``no``, ``yes``), its top class and score."""
    from ..functions import scoring as SC
    s = binary_scores(spark, sf_dir)
    scores = F.array(1.0 - F.col("prob"), F.col("prob"))
    listed = SC.score_list(scores)
    top = SC.argmax(F.transform(listed, lambda e: e["score"]))
    return rounded(s.select("row_id", "category",
                            F.get(listed, top)["label"].alias("top_label"),
                            F.get(listed, top)["score"].alias("top_score")), ["top_score"])


@register("score_multilabel", SQL_ML + f"""
SELECT row_id, category, label, round(prob, {DIGITS}) AS prob, pred FROM ms
""")
def score_multilabel(spark, sf_dir):
    return rounded(multilabel_scores(spark, sf_dir).select("row_id", "category", "label", "prob", "pred"), ["prob"])


@register("eval_metrics_flat", SQL_ML_STRICT + f""",
conf AS (SELECT sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
       sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
       sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn,
       sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn FROM mx)
SELECT round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0), {DIGITS}) AS accuracy,
       round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0), {DIGITS}) AS f1,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), {DIGITS}) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), {DIGITS}) AS recall
FROM conf
""")
def eval_metrics_flat(spark, sf_dir):
    """Multi-label training summary: every row x category cell pooled (no category key),
    predictions by ``> 0.5``."""
    return rounded(M.trainer_metrics(multilabel_scores(spark, sf_dir, strict=True), []), M.TRAINER_METRICS)


@register("multilabel_metrics", SQL_ML + "," + sql_metrics("ms", ["category"]))
def multilabel_metrics(spark, sf_dir):
    return rounded(M.eval_metrics(multilabel_scores(spark, sf_dir), ["category"]), M.METRICS)


@register("multitask_metrics", SQL_MT + "," + sql_metrics("ts", ["category"]))
def multitask_metrics(spark, sf_dir):
    return rounded(M.eval_metrics(multitask_scores(spark, sf_dir), ["category"]), M.METRICS)


def _report(prefix: str, cats, value: str, digits: str = "") -> str:
    cells = ", ".join(f"{'round(' if digits else ''}max(CASE WHEN category = '{c}' THEN {value} END){digits} AS \"{c}\""
                      for c in cats)
    return f"""
SELECT row_id, row_id AS doc_id, {cells} FROM {prefix} GROUP BY row_id
"""


def report(scores, cats, value: str):
    """Prediction table: one row per text with its ``doc_id``, one column per category."""
    return scores.groupBy("row_id", "doc_id").pivot("category", list(cats)).agg(F.first(value))


@register("predictions_class", SQL_ML + _report("ms", ML_CATS, "pred"))
def predictions_class(spark, sf_dir):
    return report(multilabel_scores(spark, sf_dir), ML_CATS, "pred")


@register("predictions_prob", SQL_ML + _report("ms", ML_CATS, "prob", f", {DIGITS})"))
def predictions_prob(spark, sf_dir):
    return rounded(report(multilabel_scores(spark, sf_dir), ML_CATS, "prob"), ML_CATS)


@register("predictions_multitask", SQL_MT + f"""
SELECT category, row_id, row_id AS doc_id, pred AS yes_class, round(prob, {DIGITS}) AS yes_prob FROM ts
""")
def predictions_multitask(spark, sf_dir):
    """Multi-task report: each task's test rows with class and probability."""
    s = multitask_scores(spark, sf_dir)
    return rounded(s.select("category", "row_id", "doc_id", F.col("pred").alias("yes_class"),
                            F.col("prob").alias("yes_prob")), ["yes_prob"])


@register("score_multitask", SQL_MT + f"""
SELECT row_id, category, label, round(prob, {DIGITS}) AS prob, pred FROM ts
""")
def score_multitask(spark, sf_dir):
    return rounded(multitask_scores(spark, sf_dir).select("row_id", "category", "label", "prob", "pred"), ["prob"])


def _sql_average(src: str) -> str:
    return (src + ", per_fold AS (" + sql_metrics_unrounded("cs", ["category", "fold"]).replace(
        "\nconf AS", "\nWITH conf AS", 1) + ")\nSELECT category, " + ", ".join(
            f"round(avg({m}), {DIGITS}) AS {m}" for m in M.METRICS) + " FROM per_fold GROUP BY category")


def _cv_queries(suffix: str, sql: str, scores):
    """Per-fold metrics and their fold average for one approach."""
    @register(f"cv_results{suffix}", sql + "," + sql_metrics("cs", ["category", "fold"]))
    def results(spark, sf_dir):
        return rounded(M.eval_metrics(scores(spark, sf_dir), ["category", "fold"]), M.METRICS)

    @register(f"cv_average{suffix}", _sql_average(sql))
    def average(spark, sf_dir):
        per_fold = M.eval_metrics(scores(spark, sf_dir), ["category", "fold"])
        return rounded(M.fold_average(per_fold, ["category"]), M.METRICS)


_cv_queries("", SQL_CV, cv_scores)
_cv_queries("_multilabel", SQL_CV_ML, cv_multilabel_scores)
_cv_queries("_multitask", SQL_CV_MT, cv_multitask_scores)


@register("learning_curve_metrics", SQL_CURVE + "," + sql_metrics("lc", ["category", "train_size"]))
def learning_curve_metrics(spark, sf_dir):
    return rounded(M.eval_metrics(curve_scores(spark, sf_dir), ["category", "train_size"]), M.METRICS)


SQL_SENT = Q.SQL_HOLDOUT + SQL_TEXTS + """,
btr AS (SELECT row_id, category, label FROM h WHERE split = 'train'),
bte AS (SELECT row_id, category, label FROM h WHERE 1 = 0)""" + sql_nb("btr", "bte", ["category"], "bs")


def _sql_lang_cte() -> str:
    words = S.letter_words("text")
    hits = {lang: f"len(list_filter({words}, lambda w: w IN ({', '.join(S.q(x) for x in ws)})))"
            for lang, ws in LG.PROFILES.items()}
    best = f"greatest({', '.join(hits.values())})"
    case = "CASE " + " ".join(f"WHEN {h} = {best} AND {best} > 0 THEN '{lang}'" for lang, h in hits.items()) + \
        f" ELSE '{LG.UNKNOWN}' END"
    return f"SELECT doc_id, text, {case} AS lang_detected FROM documents"


def sql_sentence_scores(models: str) -> str:
    """CTE ``sp``: every sentence of every English review under the models ``bs`` of ``models``."""
    return models + f""",
en AS (SELECT * FROM ({_sql_lang_cte()}) WHERE lang_detected = 'en'),
cl AS (SELECT doc_id, {S.sentence_array(S.clean('text'))} AS arr FROM en),
se AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lower(arr[i]) AS sentence
       FROM (SELECT doc_id, arr, unnest(generate_series(1, len(arr))) AS i FROM cl)),
stok AS (SELECT doc_id, pos, unnest({S.tokens(S.model_text('sentence'))}) AS token FROM se),
cats AS (SELECT DISTINCT category FROM bs_b),
grid AS (SELECT se.doc_id, se.pos, cats.category FROM se, cats),
ssum AS (SELECT g.doc_id, g.pos, g.category, sum(coalesce(w.weight, 0.0)) AS _s
         FROM grid g LEFT JOIN stok t ON g.doc_id = t.doc_id AND g.pos = t.pos
         LEFT JOIN bs_w w ON w.category = g.category AND w.token = t.token
         GROUP BY g.doc_id, g.pos, g.category),
sp AS (SELECT s.doc_id, s.pos, s.category,
              {sql_sigmoid('(b.bias + s._s)')} AS prob
       FROM ssum s JOIN bs_b b ON s.category = b.category)"""


SQL_SENT_SCORES = sql_sentence_scores(SQL_SENT)


@register("sentences_by_model", SQL_SENT_SCORES + f"""
SELECT doc_id, pos, category, round(prob, {DIGITS}) AS prob, prob > 0.5 AS is_yes FROM sp
""")
def sentences_by_model(spark, sf_dir):
    return rounded(sentence_scores(spark, sf_dir), ["prob"])


@register("review_prevalence", SQL_SENT_SCORES + f"""
SELECT doc_id, category, count(*) AS n_sentences,
       round(avg(CAST(prob > 0.5 AS INTEGER)), {DIGITS}) AS share
FROM sp GROUP BY doc_id, category
""")
def review_prevalence(spark, sf_dir):
    from ..operators import prevalence as PV
    return rounded(PV.prevalence(sentence_scores(spark, sf_dir)), ["share"])


@register("language_id", f"""
WITH d AS (SELECT doc_id, {S.letter_words('text')} AS words FROM documents)
SELECT doc_id, {'CASE ' + ' '.join(
    f"WHEN h_{lang} = greatest({', '.join('h_' + x for x in LG.PROFILES)}) AND greatest({', '.join('h_' + x for x in LG.PROFILES)}) > 0 THEN '{lang}'"
    for lang in LG.PROFILES) + f" ELSE '{LG.UNKNOWN}' END"} AS lang_detected,
       {', '.join(f'h_{lang} AS hits_{lang}' for lang in LG.PROFILES)}
FROM (SELECT doc_id, {', '.join(
    f"CAST(len(list_filter(words, lambda w: w IN ({', '.join(S.q(x) for x in ws)}))) AS INTEGER) AS h_{lang}"
    for lang, ws in LG.PROFILES.items())} FROM d)
""")
def language_id(spark, sf_dir):
    return LG.language_id(ST.documents(spark, sf_dir))


@register("language_gate", f"""
SELECT doc_id, n_chars FROM ({_sql_lang_cte()}) JOIN documents USING (doc_id) WHERE lang_detected = 'en'
""")
def language_gate(spark, sf_dir):
    en, _ = LG.language_gate(ST.documents(spark, sf_dir).select("doc_id", "text", "n_chars"))
    return en.select("doc_id", "n_chars")


# --------------------------------------------------------------------------- Spark ML plug-in
def lr_scores(spark, sf_dir, roundtrip: bool = False, train_too: bool = False):
    """Scores of the test rows (with ``train_too`` of all rows, by ``split``); with ``roundtrip`` also
    the saved and loaded model's (``prob2``)."""
    from ..operators import ml as ML
    from ..session import scratch_path
    h = materialize(Q.holdout(spark, sf_dir).select("row_id", "category", "label", "split"))
    tx = texts(spark, sf_dir)
    fmodel = ML.fit_features(tx, h.where(F.col("split") == SP.TRAIN))
    feats = materialize(ML.featurize(fmodel, tx).join(h, "row_id"))
    train, test = feats.where(F.col("split") == SP.TRAIN), feats.where(F.col("split") == SP.TEST)
    heads = ML.fit_heads(train, CATS, max_iter=100, reg_param=0.01)
    if train_too:
        return ML.score_heads(heads, feats).join(h.select("row_id", "category", "split"), ["row_id", "category"])
    scored = ML.score_heads(heads, test)
    if roundtrip:
        path = scratch_path(spark, "lr-model")
        ML.save_heads(fmodel, heads, path)
        loaded, again = ML.load_heads(path, CATS)
        test = ML.featurize(loaded, tx).join(h.where(F.col("split") == SP.TEST), "row_id")
        scored = scored.join(ML.score_heads(again, test).select("row_id", "category", F.col("prob").alias("prob2")),
                             ["row_id", "category"])
    return scored


_SQL_LR = Q.SQL_HOLDOUT + """
SELECT category, count(*) AS n_scored, CAST(0 AS BIGINT) AS {bad} FROM h WHERE split = 'test' GROUP BY category
"""


@register("fit_binary_lr", Q.SQL_HOLDOUT + """
SELECT category, CAST(sum(CAST(split = 'test' AS INTEGER)) AS BIGINT) AS n_scored, CAST(0 AS BIGINT) AS n_bad_prob,
       CAST(sum(CASE WHEN split = 'train' THEN label ELSE 0 END) AS DOUBLE) AS train_positives
FROM h GROUP BY category
""")
def fit_binary_lr(spark, sf_dir):
    """Logistic regression heads over hashed TF-IDF features: test rows scored per category, how
    many have no probability between 0 and 1, and the sum of the training rows' probabilities,
    which at the optimum (the intercept is not penalised) is the number of positive labels."""
    good = F.col("prob").isNotNull() & ~F.isnan("prob") & F.col("prob").between(0, 1)
    test = F.col("split") == SP.TEST
    return (lr_scores(spark, sf_dir, train_too=True).groupBy("category")
            .agg(F.sum(test.cast("long")).alias("n_scored"), F.sum((test & ~good).cast("long")).alias("n_bad_prob"),
                 F.round(F.sum(F.when(~test, F.col("prob"))), 1).alias("train_positives")))


@register("model_roundtrip_lr", _SQL_LR.format(bad="n_changed"))
def model_roundtrip_lr(spark, sf_dir):
    """The same heads saved to the shared folder and loaded back: rows whose score changed."""
    return (lr_scores(spark, sf_dir, roundtrip=True).groupBy("category")
            .agg(F.count(F.lit(1)).alias("n_scored"),
                 F.sum((F.abs(F.col("prob") - F.col("prob2")) > 1e-9).cast("long")).alias("n_changed")))


# --------------------------------------------------------------------------- external scorer
# Test double for an external classifier: the logistic of how often a cue occurs. The same
# formula is written in SQL below.
EXT_CUES = {"quality": " the ", "toxic": " und "}


def _load_cue_scorer():
    import math

    def model(texts):
        out = []
        for t in texts:
            low = t.lower()
            out.append([[{"label": "no", "score": 1.0 - p}, {"label": "yes", "score": p}]
                        for p in [1.0 / (1.0 + math.exp(-(low.count(c) - 3.0))) for c in EXT_CUES.values()]])
        return out
    return model


def external_scores(spark, sf_dir, batched: bool = False):
    """Each test text is scored once for all categories (one UDF pass over the text); the
    long test rows then pick their category's score list by position."""
    from ..functions import scoring as SC
    from ..operators import external as EX
    h = materialize(Q.holdout(spark, sf_dir))
    test = h.where(F.col("split") == SP.TEST).select("row_id", "category", "label")
    tx = texts(spark, sf_dir).join(test.select("row_id").distinct(), "row_id", "left_semi")
    if batched:
        per_text = EX.with_batched_scores(tx, "text", _load_cue_scorer, len(EXT_CUES), "all").select("row_id", "all")
    else:
        per_text = tx.select("row_id", EX.external_scores(F.col("text"), _load_cue_scorer, nested=True).alias("all"))
    ordinal = F.array_position(F.array(*[F.lit(c) for c in EXT_CUES]), F.col("category")) - 1
    return (test.join(per_text, "row_id")
            .select("row_id", "category", "label", SC.score_of(F.get(F.col("all"), ordinal.cast("int")), 1).alias("prob"))
            .withColumn("pred", SC.decide(F.col("prob"))))


def _sql_cue_count(expr, cue):
    return f"((length(lower({expr})) - length(replace(lower({expr}), {S.q(cue)}, ''))) / {len(cue)})"


@register("score_external", Q.SQL_HOLDOUT + SQL_TEXTS + f""",
es AS (SELECT h.row_id, h.category, h.label,
              1.0 / (1.0 + exp(-(CASE h.category """ + " ".join(
    f"WHEN {S.q(c)} THEN {_sql_cue_count('tx.text', cue)}" for c, cue in EXT_CUES.items()) + f""" END - 3.0))) AS prob
       FROM h JOIN tx ON h.row_id = tx.row_id WHERE h.split = 'test')
SELECT row_id, category, label, round(prob, {DIGITS}) AS prob, CAST(prob >= 0.5 AS INTEGER) AS pred FROM es
""")
def score_external(spark, sf_dir):
    """An external scorer (iterator pandas UDF, model loaded once per worker) on the test rows."""
    return rounded(external_scores(spark, sf_dir), ["prob"])


@register("score_external_batched", Q.SQL_HOLDOUT + SQL_TEXTS + f""",
es AS (SELECT h.row_id, h.category, h.label,
              1.0 / (1.0 + exp(-(CASE h.category """ + " ".join(
    f"WHEN {S.q(c)} THEN {_sql_cue_count('tx.text', cue)}" for c, cue in EXT_CUES.items()) + f""" END - 3.0))) AS prob
       FROM h JOIN tx ON h.row_id = tx.row_id WHERE h.split = 'test')
SELECT row_id, category, label, round(prob, {DIGITS}) AS prob, CAST(prob >= 0.5 AS INTEGER) AS pred FROM es
""")
def score_external_batched(spark, sf_dir):
    """The same scorer in batches of a fixed size (``predict_batch_udf``)."""
    return rounded(external_scores(spark, sf_dir, batched=True), ["prob"])


@register("predictions_binary", SQL_BIN + f"""
SELECT bs.category, bs.row_id, l.doc_id, bs.pred AS yes_class, round(bs.prob, {DIGITS}) AS yes_prob
FROM bs JOIN labels l ON bs.row_id = l.doc_id
""")
def predictions_binary(spark, sf_dir):
    """Binary approach: class and probability of ``yes`` per test row, with its ``doc_id``
    carried through scoring (no join back to the labelled table)."""
    s = binary_scores(spark, sf_dir)
    return rounded(s.select("category", "row_id", "doc_id", F.col("pred").alias("yes_class"),
                            F.col("prob").alias("yes_prob")), ["yes_prob"])


@register("review_sentences_wide", SQL_SENT_SCORES + ", se_txt AS (SELECT doc_id, pos, sentence FROM se)\n"
          "SELECT sp.doc_id, sp.pos, se_txt.sentence, "
          + ", ".join(f"bool_or(CASE WHEN sp.category = '{c}' THEN sp.prob > 0.5 END) AS {c}" for c in CATS)
          + "\nFROM sp JOIN se_txt ON sp.doc_id = se_txt.doc_id AND sp.pos = se_txt.pos"
          "\nGROUP BY sp.doc_id, sp.pos, se_txt.sentence")
def review_sentences_wide(spark, sf_dir):
    """The per-sentence result table: the sentence and one yes/no column per category."""
    from ..operators import prevalence as PV
    weights, bias = final_models(spark, sf_dir)
    wide = PV.score_sentences_wide(english_sentences(spark, sf_dir), weights, bias, CATS, keep_text=True)
    return wide.select("doc_id", "pos", "sentence", *[(F.col(c) > 0.5).alias(c) for c in CATS])
