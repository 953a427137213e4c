"""Registered few-shot queries, conversation answers and the approach comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as TF
from ..operators import metrics as M
from ..operators import prompt as PR
from ..operators import split as SP
from ..operators.ranking import materialize
from ..sources import tables as ST
from ..sources import templates as TP
from . import models as MD
from . import splits as Q
from . import sqltext as S
from .registry import register

CATS = Q.CATS
DIGITS = MD.DIGITS

# Test double for the language model: answers yes when the text to label contains the
# category's cue word. Same rule in SQL below.
CUES = {"quality": " and ", "toxic": " die "}


def keyword_generator(pdf: pd.DataFrame) -> pd.Series:
    def one(category, messages):
        last = messages[-1]["content"] or ""
        text = last[len(TP.FINAL_PREFIX):].lower()
        return TP.YES_TAG if CUES.get(category, "\0") in text else TP.NO_TAG
    return pd.Series([one(c, m) for c, m in zip(pdf["category"], pdf["messages"])], index=pdf.index)


def test_rows(spark, sf_dir, h=None):
    h = (h if h is not None else Q.holdout(spark, sf_dir))
    h = h.where(F.col("split") == SP.TEST).select("row_id", "category", "label")
    tx = MD.texts(spark, sf_dir).select("row_id", TF.model_text(F.col("text"), TF.FEWSHOT_SEP).alias("text"))
    return h.join(tx, "row_id")


def rendered(spark, sf_dir, h=None):
    return PR.render(test_rows(spark, sf_dir, h), TP.template_table(spark))


def labelled(spark, sf_dir, h=None):
    chat = PR.generate(rendered(spark, sf_dir, h), keyword_generator)
    gen = PR.answer(F.col("chat"))
    return chat.select("row_id", "category", "label", gen.alias("gen_label"),
                       PR.parse_yes(gen).alias("gen_label_bool"))


# --------------------------------------------------------------------------- SQL side
_TPL = ", ".join(f"({S.q(c)}, {S.q(t)}, {S.q(qq)}, {S.q(y)})" for c, t, qq, y in TP.DATA_TEMPLATES)


def _cue_case(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN category = {S.q(c)} AND contains(lower({expr}), {S.q(w)}) THEN {S.q(TP.YES_TAG)}"
                              for c, w in CUES.items()) + f" ELSE {S.q(TP.NO_TAG)} END"


FS_PART = f""",
tpl AS (SELECT * FROM (VALUES {_TPL}) AS v(category, title, question, yes_example)),
fx AS (SELECT l.doc_id AS row_id, {S.model_text('d.text', TF.FEWSHOT_SEP)} AS text
       FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
ft AS (SELECT h.row_id, h.category, h.label, fx.text FROM h JOIN fx ON h.row_id = fx.row_id WHERE h.split = 'test'),
pm AS (SELECT ft.*, [
  {{'role': 'system', 'content': {S.q(TP.SYSTEM_TEXT)}}},
  {{'role': 'user', 'content': replace(replace({S.q(TP.TASK_TEXT)}, '{{title}}', tpl.title), '{{question}}', tpl.question)}},
  {{'role': 'assistant', 'content': {S.q(TP.ASK_EXAMPLES_TEXT)}}},
  {{'role': 'user', 'content': replace(replace({S.q(TP.EXAMPLES_TEXT)}, '{{yes_example}}', tpl.yes_example), '{{no_example}}', {S.q(TP.NO_EXAMPLE)})}},
  {{'role': 'assistant', 'content': {S.q(TP.READY_TEXT)}}},
  {{'role': 'user', 'content': {S.q(TP.FINAL_PREFIX)} || coalesce(ft.text, '')}}] AS messages
  FROM ft JOIN tpl ON ft.category = tpl.category),
gl AS (SELECT row_id, category, label, {_cue_case('ft_text')} AS gen_label
       FROM (SELECT *, text AS ft_text FROM pm)),
fl AS (SELECT row_id, category, label, gen_label,
              CAST(coalesce(contains(gen_label, {S.q(TP.YES_TAG)}), false) AS INTEGER) AS gen_label_bool FROM gl)"""
SQL_PROMPTS = Q.SQL_HOLDOUT + FS_PART


@register("prompts", SQL_PROMPTS + """
SELECT row_id, category, CAST(len(messages) AS INTEGER) AS n_messages,
       array_to_string(list_transform(messages, lambda m: m.role), ',') AS roles,
       array_to_string(list_transform(messages, lambda m: m.role || ': ' || m.content), chr(10)) AS prompt_text
FROM pm
""")
def prompts(spark, sf_dir):
    r = rendered(spark, sf_dir)
    return r.select("row_id", "category", F.size("messages").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    PR.prompt_text(F.col("messages")).alias("prompt_text"))


@register("fewshot_labels", SQL_PROMPTS + """
SELECT row_id, category, gen_label, gen_label_bool FROM fl
""")
def fewshot_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("row_id", "category", "gen_label", "gen_label_bool")


# Every document gets one of the twelve review categories, by a hash of its key.
_REVIEW = [t[0] for t in TP.REVIEW_TEMPLATES]
_SQL_REVIEW_CATEGORY = ("[" + ", ".join(S.q(c) for c in _REVIEW) + "][1 + CAST(('0x' || substr("
                        + S.md5_key(Q.SEED, "'review'", "doc_id") + f", 1, 6)) AS INTEGER) % {len(_REVIEW)}]")
_SQL_REVIEW_TPL = ", ".join(f"({S.q(c)}, {S.q(t)}, {S.q(qq)}, {S.q(y)})" for c, t, qq, y in TP.REVIEW_TEMPLATES)


@register("prompts_review", f"""
WITH tpl AS (SELECT * FROM (VALUES {_SQL_REVIEW_TPL}) AS v(category, title, question, yes_example)),
d AS (SELECT doc_id, {_SQL_REVIEW_CATEGORY} AS category, {S.model_text('text', TF.FEWSHOT_SEP)} AS text FROM documents)
SELECT d.doc_id, d.category, 'system: ' || {S.q(TP.SYSTEM_TEXT)} || chr(10)
  || 'user: ' || replace(replace({S.q(TP.TASK_TEXT)}, '{{title}}', title), '{{question}}', question) || chr(10)
  || 'assistant: ' || {S.q(TP.ASK_EXAMPLES_TEXT)} || chr(10)
  || 'user: ' || replace(replace({S.q(TP.EXAMPLES_TEXT)}, '{{yes_example}}', yes_example), '{{no_example}}', {S.q(TP.NO_EXAMPLE)}) || chr(10)
  || 'assistant: ' || {S.q(TP.READY_TEXT)} || chr(10)
  || 'user: ' || {S.q(TP.FINAL_PREFIX)} || text AS prompt_text
FROM d JOIN tpl ON d.category = tpl.category
""")
def prompts_review(spark, sf_dir):
    """The twelve review templates rendered over all documents."""
    from ..operators.ranking import shuffle_key
    pick = F.conv(F.substring(shuffle_key(Q.SEED, "review", F.col("doc_id")), 1, 6), 16, 10).cast("int") % len(_REVIEW)
    docs = ST.documents(spark, sf_dir).select(
        "doc_id", F.get(F.array(*[F.lit(c) for c in _REVIEW]), pick).alias("category"),
        TF.model_text(F.col("text"), TF.FEWSHOT_SEP).alias("text"))
    r = PR.render(docs, TP.template_table(spark, TP.REVIEW_TEMPLATES))
    return r.select("doc_id", "category", PR.prompt_text(F.col("messages")).alias("prompt_text"))


@register("generated_label_sink", SQL_PROMPTS + """
SELECT row_id, category, gen_label, gen_label_bool FROM fl
""")
def generated_label_sink(spark, sf_dir):
    """Generated labels with their row id, as CSV per category, written and read back."""
    from pyspark.sql import types as T

    from ..session import scratch_path
    from ..sources import io as IO
    rows = labelled(spark, sf_dir).select("row_id", "gen_label", "gen_label_bool", "category")
    path = scratch_path(spark, "generated-labels")
    IO.write_csv(rows, path, partition_by=("category",), spaced_metric_names=False)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("gen_label", T.StringType()),
                           T.StructField("gen_label_bool", T.IntegerType()), T.StructField("category", T.StringType())])
    return IO.read_labelled_csv(spark, path, schema)


@register("fewshot_metrics", SQL_PROMPTS + ", fm AS (SELECT category, label, gen_label_bool AS pred FROM fl),"
          + MD.sql_metrics("fm", ["category"]))
def fewshot_metrics(spark, sf_dir):
    return MD.rounded(M.eval_metrics(labelled(spark, sf_dir), ["category"], pred="gen_label_bool"), M.METRICS)


@register("conversation_answers", f"""
WITH n AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, role AS answer_role, text AS answer FROM conversations WHERE turn = 6)
SELECT n.conv_id, n.n_turns, a.answer_role,
       CAST(coalesce(contains(a.answer, {S.q(TP.YES_TAG)}), false) AS INTEGER) AS answer_yes,
       a.conv_id IS NOT NULL AS has_answer,
       CAST(coalesce(len(a.answer), 0) AS INTEGER) AS answer_chars
FROM n LEFT JOIN a ON n.conv_id = a.conv_id
""")
def conversation_answers(spark, sf_dir):
    """The seventh message of every conversation (turns are positions from 0): a filter plus a
    per-conversation count, so a very long conversation never becomes one array."""
    conv = ST.table(spark, sf_dir, "conversations")
    n = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    a = conv.where(F.col("turn") == 6).select("conv_id", F.col("role").alias("answer_role"),
                                               F.col("text").alias("answer"))
    return (n.join(a, "conv_id", "left")
            .select("conv_id", "n_turns", "answer_role", PR.parse_yes(F.col("answer")).alias("answer_yes"),
                    F.col("answer").isNotNull().alias("has_answer"),
                    F.coalesce(F.length("answer"), F.lit(0)).alias("answer_chars")))


APPROACHES = ["binary", "multilabel", "multitask", "fewshot"]

SQL_COMPARE = ("WITH " + Q.SQL_LONG + Q.sql_holdout("l", "h") + Q.SQL_VOTES + Q.sql_holdout("mv", "hv")
               + ",\nha AS (SELECT * FROM hv WHERE split <> 'train' OR full_agree),\n" + Q.PLAIN_PART + MD.SQL_TEXTS
               + MD.BIN_PART + MD.ML_PART + MD.MT_PART + FS_PART + f""",
allp AS (SELECT 'binary' AS approach, category, label, pred FROM bs
         UNION ALL SELECT 'multilabel', category, label, pred FROM ms WHERE category <> 'none'
         UNION ALL SELECT 'multitask', category, label, pred FROM ts
         UNION ALL SELECT 'fewshot', category, label, gen_label_bool FROM fl),
cmp AS (WITH """ + MD.sql_metrics("allp", ["approach", "category"], name="cm_") + """)
SELECT category, """ + ", ".join(
    f"max(CASE WHEN approach = '{a}' THEN f1_macro END) AS {a}" for a in APPROACHES) + """
FROM cmp GROUP BY category""")


@register("compare_approaches", SQL_COMPARE)
def compare_approaches(spark, sf_dir):
    """F1 macro per category for every approach, side by side."""
    keep = ["category", "label", "pred"]
    h = materialize(Q.holdout(spark, sf_dir))  # one stratified split shared by two approaches
    tf = MD.terms(spark, sf_dir)               # one table of term counts shared by three
    ml = MD.multilabel_scores(spark, sf_dir, tf=tf).where(F.col("category") != "none")
    fs = labelled(spark, sf_dir, h).withColumnRenamed("gen_label_bool", "pred")
    parts = [("binary", MD.binary_scores(spark, sf_dir, h, tf)), ("multilabel", ml),
             ("multitask", MD.multitask_scores(spark, sf_dir, tf)), ("fewshot", fs)]
    allp = None
    for name, df in parts:
        d = df.select(F.lit(name).alias("approach"), *keep)
        allp = d if allp is None else allp.unionByName(d)
    metrics = M.eval_metrics(allp, ["approach", "category"])
    return MD.rounded(M.compare(metrics, APPROACHES), APPROACHES)
