"""Registered queries of the n-gram language model: detection, held-out accuracy, the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ngrams as NG
from ..operators.ranking import materialize
from ..sources import tables as ST
from . import sqltext as S
from .registry import register

DIGITS = 6
# Documents held out of the fit: those whose md5 key starts with one of three hexadecimal digits.
HELD = ("0", "1", "2")
_HELD_SQL = f"substr({S.md5_key(1, 'doc_id')}, 1, 1) IN ({', '.join(map(S.q, HELD))})"


def held_out():
    from ..operators.ranking import shuffle_key
    return F.substring(shuffle_key(1, F.col("doc_id")), 1, 1).isin(*HELD)


def detected(spark, sf_dir):
    """``(doc_id, held_out, lang, lang_detected, n_grams, margin)``; the model sees the labels of
    documents that are not held out."""
    docs = ST.documents(spark, sf_dir).select("doc_id", "text", "lang", "n_chars")
    counts = materialize(NG.word_lists(docs))
    train = docs.where(~held_out()).select("doc_id", "lang")
    langs = NG.languages(train)
    weights, head = NG.fit(counts, train, langs)
    found = NG.detect(counts, docs, weights, head, langs)
    return docs.select("doc_id", "lang", "n_chars", held_out().alias("held_out")).join(found, "doc_id")


_GRAMS = " || ".join(f"list_transform(generate_series(1, len(m) - {n - 1}), lambda i: substr(m, i, {n}))" for n in NG.SIZES)
SQL_DETECT = f"""
WITH d AS (SELECT doc_id, lang, n_chars, {_HELD_SQL} AS held_out, {S.letter_words('text')} AS words FROM documents),
c AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
lg AS (SELECT lang, count(*) AS docs, row_number() OVER (ORDER BY lang) AS nth FROM d
       WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang),
wg AS (SELECT word, unnest({_GRAMS}) AS gram FROM (SELECT word, '{NG.EDGE}' || word || '{NG.EDGE}' AS m FROM (SELECT DISTINCT word FROM c))),
tw AS (SELECT d.lang, c.word, sum(c.tf) AS n FROM c JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
tg AS (SELECT lang, gram, sum(n) AS n FROM tw JOIN wg USING (word) GROUP BY ALL),
vs AS (SELECT count(DISTINCT gram) AS v FROM tg),
tt AS (SELECT lang, sum(n) AS t FROM tg GROUP BY lang),
hd AS (SELECT lg.lang, nth, ln(docs / (SELECT sum(docs) FROM lg)) AS prior, t + {NG.ALPHA} * v AS below FROM lg JOIN tt USING (lang), vs),
ws AS (SELECT word, hd.lang, sum(ln((coalesce(tg.n, 0) + {NG.ALPHA}) / below)) AS s, count(*) AS grams
       FROM wg CROSS JOIN hd LEFT JOIN tg ON tg.lang = hd.lang AND tg.gram = wg.gram GROUP BY word, hd.lang),
ds AS (SELECT doc_id, lang, sum(tf * s) AS s, sum(tf * grams) AS n_grams FROM c JOIN ws USING (word) GROUP BY ALL),
dp AS (SELECT doc_id, ds.lang, nth, s + prior AS s, n_grams FROM ds JOIN hd USING (lang)),
db AS (SELECT doc_id, arg_max(lang, (s, -nth)) AS best, max(n_grams) AS n_grams, max(s) AS top FROM dp GROUP BY doc_id),
dn AS (SELECT dp.doc_id, max(s) AS next FROM dp JOIN db ON db.doc_id = dp.doc_id AND dp.lang <> db.best GROUP BY dp.doc_id),
dd AS (SELECT d.doc_id, d.lang, d.n_chars, d.held_out, coalesce(best, 'unknown') AS lang_detected,
              CAST(coalesce(n_grams, 0) AS BIGINT) AS n_grams, (top - next) / n_grams AS margin
       FROM d LEFT JOIN db USING (doc_id) LEFT JOIN dn USING (doc_id))"""


@register("language_ngrams", SQL_DETECT + f"""
SELECT doc_id, held_out, lang_detected, n_grams, round(margin, {DIGITS}) AS margin FROM dd
""")
def language_ngrams(spark, sf_dir):
    """Detected language of every document, the number of n-grams read and the winner's lead."""
    return detected(spark, sf_dir).select("doc_id", "held_out", "lang_detected", "n_grams",
                                          F.round("margin", DIGITS).alias("margin"))


@register("language_ngrams_accuracy", SQL_DETECT + f"""
SELECT lang, count(*) AS n_docs, CAST(sum(CAST(lang_detected = lang AS INTEGER)) AS BIGINT) AS n_right,
       round(avg(CAST(lang_detected = lang AS INTEGER)), {DIGITS}) AS accuracy
FROM dd WHERE held_out AND lang IS NOT NULL GROUP BY lang
""")
def language_ngrams_accuracy(spark, sf_dir):
    """Accuracy per language on the documents that the model has not seen."""
    right = (F.col("lang_detected") == F.col("lang")).cast("long")
    return (detected(spark, sf_dir).where("held_out and lang is not null").groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(right).alias("n_right"), F.round(F.avg(right), DIGITS).alias("accuracy")))


@register("language_gate_ngrams", SQL_DETECT + """
SELECT doc_id, n_chars FROM dd WHERE lang_detected = 'en'
""")
def language_gate_ngrams(spark, sf_dir):
    """Documents that the n-gram model takes for English."""
    return detected(spark, sf_dir).where("lang_detected = 'en'").select("doc_id", "n_chars")
