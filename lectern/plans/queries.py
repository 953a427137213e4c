"""Registered queries: one Spark plan per operator group, each with a DuckDB twin.

Every query reads the given tables under ``sf_dir`` in full. Where the test tables lack
a case the operator handles (numbered headings, the mask word, null sides), the same
text is added to every row in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as LF
from ..functions import text as TF
from ..operators import labels as LO
from ..operators import sentences as SO
from ..sources import tables as ST
from . import sqltext as S

CATS = list(ST.DEFAULT_CATEGORIES)
ML_CATS = [ST.NONE_CATEGORY] + CATS

# Text added to every document so that headings, titles and masks occur in the data.
HEAD_PREFIX = "1. Head line\nStrengths: "
HEAD_SUFFIX = "\n\tGeneral Comment:  Done."
MASK_SUFFIX = " XXX [SEP] x[unk]xxxx"

from .registry import ORACLE, REGISTRY, register  # noqa: E402


def _docs_with_headings(spark, sf_dir):
    d = ST.documents(spark, sf_dir)
    return d.select("doc_id", F.concat(F.lit(HEAD_PREFIX), F.col("text"), F.lit(HEAD_SUFFIX)).alias("text"))


_SQL_HEAD_TEXT = f"concat({S.q(HEAD_PREFIX)}, text, {S.q(HEAD_SUFFIX)})"


# --------------------------------------------------------------------------- text
@register("clean_documents", f"""
SELECT doc_id, {S.clean(_SQL_HEAD_TEXT)} AS clean_text FROM documents
""")
def clean_documents(spark, sf_dir):
    return SO.clean_documents(_docs_with_headings(spark, sf_dir))


_SQL_SENT_ARR = f"""
WITH c AS (SELECT doc_id, {S.clean(_SQL_HEAD_TEXT)} AS t FROM documents),
a AS (SELECT doc_id, {S.sentence_array('t')} AS arr FROM c),
e AS (SELECT doc_id, arr, unnest(generate_series(1, len(arr))) AS i FROM a)
"""


@register("sentences", _SQL_SENT_ARR + """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lower(arr[i]) AS sentence FROM e
""")
def sentences(spark, sf_dir):
    return SO.sentences(clean_documents(spark, sf_dir))


@register("context_window", _SQL_SENT_ARR + f"""
, s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, arr[i] AS sentence FROM e),
w AS (SELECT doc_id, pos,
             lag(sentence) OVER (PARTITION BY doc_id ORDER BY pos) AS sentence_pre, sentence,
             lead(sentence) OVER (PARTITION BY doc_id ORDER BY pos) AS sentence_post FROM s)
SELECT doc_id, pos, sentence_pre, sentence, sentence_post,
       {S.model_text("concat_ws(' ', coalesce(sentence_pre, ''), coalesce(sentence, ''), coalesce(sentence_post, ''))")} AS text
FROM w
""")
def context_window(spark, sf_dir):
    s = SO.sentences_with_context(clean_documents(spark, sf_dir))
    return SO.model_input(s, single_sentence=False)


_SQL_MASKED = f"concat(text, {S.q(MASK_SUFFIX)})"


@register("normalise_text", f"""
SELECT doc_id, {S.model_text(_SQL_MASKED)} AS text FROM documents
""")
def normalise_text(spark, sf_dir):
    d = ST.documents(spark, sf_dir)
    return d.select("doc_id", TF.model_text(F.concat("text", F.lit(MASK_SUFFIX))).alias("text"))


@register("normalise_text_fewshot", f"""
SELECT doc_id, {S.model_text(_SQL_MASKED, ' . ')} AS text FROM documents
""")
def normalise_text_fewshot(spark, sf_dir):
    d = ST.documents(spark, sf_dir)
    return d.select("doc_id", TF.model_text(F.concat("text", F.lit(MASK_SUFFIX)),
                                            TF.FEWSHOT_SEP).alias("text"))


# --------------------------------------------------------------------------- labels
def _labels_wide(spark, sf_dir):
    return (ST.table(spark, sf_dir, "labels")
            .select(F.col("doc_id").alias("row_id"), "doc_id", *CATS))


_SQL_LABELS_WIDE = "(SELECT doc_id AS row_id, doc_id, quality, toxic FROM labels)"


@register("labels_long", f"""
SELECT row_id, doc_id, 'quality' AS category, quality AS label FROM {_SQL_LABELS_WIDE}
UNION ALL
SELECT row_id, doc_id, 'toxic' AS category, toxic AS label FROM {_SQL_LABELS_WIDE}
""")
def labels_long(spark, sf_dir):
    return LO.to_long(_labels_wide(spark, sf_dir), CATS)


@register("label_counts", f"""
SELECT c.ordinal, c.category, CAST(sum(l.label) AS BIGINT) AS n_yes, count(*) AS n_rows
FROM (VALUES (0, 'none'), (1, 'quality'), (2, 'toxic')) AS c(ordinal, category)
JOIN (SELECT 'none' AS category, CAST(quality + toxic = 0 AS INTEGER) AS label FROM labels
      UNION ALL SELECT 'quality', quality FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) l USING (category)
GROUP BY c.ordinal, c.category
""")
def label_counts(spark, sf_dir):
    """Rows and positive labels of every category of the category dimension, with its place."""
    rows = LO.to_long(LO.add_none(_labels_wide(spark, sf_dir), CATS, after="doc_id"), ML_CATS)
    counts = rows.groupBy("category").agg(F.sum("label").cast("long").alias("n_yes"), F.count(F.lit(1)).alias("n_rows"))
    return (ST.category_dimension(spark, CATS, with_none=True).join(counts, "category")
            .select("ordinal", "category", "n_yes", "n_rows"))


@register("label_none", f"""
SELECT row_id, doc_id,
       CAST((coalesce(quality, 0) + coalesce(toxic, 0)) = 0 AS INTEGER) AS none,
       quality, toxic,
       CAST((coalesce(quality, 0) + coalesce(toxic, 0)) >= 1 AS INTEGER) AS quality_or_toxic
FROM {_SQL_LABELS_WIDE}
""")
def label_none(spark, sf_dir):
    df = LO.add_none(_labels_wide(spark, sf_dir), CATS, after="doc_id")
    return LO.add_or(df, "quality_or_toxic", CATS)


_SQL_LIST = ("list_filter([CASE WHEN quality = 1 THEN 'quality' END, "
             "CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)")
_SQL_LIST_ML = ("list_filter([CASE WHEN coalesce(quality,0) + coalesce(toxic,0) = 0 THEN 'none' END, "
                "CASE WHEN quality = 1 THEN 'quality' END, "
                "CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)")


@register("label_list", f"""
SELECT row_id, array_to_string({_SQL_LIST}, ',') AS labels,
       CAST(len({_SQL_LIST}) AS INTEGER) AS n_labels
FROM {_SQL_LABELS_WIDE}
""")
def label_list(spark, sf_dir):
    lst = LF.label_list(CATS)
    return _labels_wide(spark, sf_dir).select(
        "row_id", F.array_join(lst, ",").alias("labels"), F.size(lst).alias("n_labels"))


@register("multi_hot", f"""
WITH l AS (SELECT row_id, {_SQL_LIST_ML} AS names FROM {_SQL_LABELS_WIDE}),
m AS (SELECT row_id, names,
             [CAST(list_contains(names, c) AS INTEGER) for c in ['none', 'quality', 'toxic']] AS hot
      FROM l)
SELECT row_id, array_to_string(hot, ',') AS multi_hot,
       array_to_string(list_filter(['none', 'quality', 'toxic'], lambda c, i: hot[i] = 1), ',') AS round_trip
FROM m
""")
def multi_hot(spark, sf_dir):
    df = LO.add_none(_labels_wide(spark, sf_dir), CATS, after="doc_id")
    names = LF.label_list(ML_CATS)
    hot = LF.multi_hot(names, ML_CATS)
    back = LF.names_from_multi_hot(hot, ML_CATS)
    return df.select(
        "row_id",
        F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), ",").alias("multi_hot"),
        F.array_join(back, ",").alias("round_trip"))


@register("label_combinations", """
SELECT concat_ws('_', CAST(coalesce("none", 0) AS VARCHAR), CAST(coalesce(quality, 0) AS VARCHAR),
                 CAST(coalesce(toxic, 0) AS VARCHAR)) AS combination,
       count(*) AS n_rows, count(*) = 1 AS singleton
FROM (SELECT CAST(quality + toxic = 0 AS INTEGER) AS "none", quality, toxic FROM labels)
GROUP BY 1
""")
def label_combinations(spark, sf_dir):
    df = LO.add_none(_labels_wide(spark, sf_dir), CATS, after="doc_id")
    return LO.label_combinations(df, ML_CATS)


from . import splits as _splits  # noqa: E402,F401  (registers its queries)
from . import models as _models  # noqa: E402,F401
from . import many as _many  # noqa: E402,F401
from . import features as _features  # noqa: E402,F401
from . import language as _language  # noqa: E402,F401
from . import linear as _linear  # noqa: E402,F401
from . import fewshot as _fewshot  # noqa: E402,F401
from . import sinks as _sinks  # noqa: E402,F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
