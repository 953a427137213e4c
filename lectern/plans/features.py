"""Registered token queries: vocabulary, fixed-length ids, ids with multi-hot labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as LF
from ..operators import labels as LO
from ..operators import subword as SW
from ..operators import tokens as TK
from ..sources import tables as ST
from . import sqltext as S
from .registry import register

CATS = list(ST.DEFAULT_CATEGORIES)
ML_CATS = [ST.NONE_CATEGORY] + CATS
MAX_LENGTH = 256


def vocab(spark, sf_dir):
    return TK.vocabulary(ST.documents(spark, sf_dir).select("text"))


def _specials_sql() -> str:
    return ", ".join(S.q(t) for t in TK.SPECIAL_IDS)


SQL_VOCAB = f"""
voc_t AS (SELECT unnest({S.tokens(S.model_text('text'))}) AS token FROM documents),
voc_c AS (SELECT token, count(*) AS n FROM voc_t WHERE token NOT IN ({_specials_sql()}) GROUP BY token),
voc AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + {TK.FIRST_ID - 1} AS BIGINT) AS token_id FROM voc_c)"""

_SPECIAL_CASE = "CASE t.token " + " ".join(f"WHEN {S.q(k)} THEN {v}" for k, v in TK.SPECIAL_IDS.items()) + \
    f" ELSE coalesce(CAST(v.token_id AS INTEGER), {TK.UNK}) END"


def sql_token_ids(src: str, id_col: str, L: int) -> str:
    """``id_col`` may list several columns."""
    of_t, of_l = (", ".join(f"{a}.{c.strip()}" for c in id_col.split(",")) for a in "tl")
    return f""",
tk_l AS (SELECT {id_col}, {S.tokens(S.model_text('text'))} AS toks FROM {src}),
tk_t AS (SELECT {id_col}, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS _at FROM tk_l),
tk_i AS (SELECT {of_t}, t._at, {_SPECIAL_CASE} AS id FROM tk_t t LEFT JOIN voc v ON t.token = v.token),
tk_g AS (SELECT {of_l}, coalesce(list(i.id ORDER BY i._at) FILTER (WHERE i.id IS NOT NULL), []) AS ids
         FROM tk_l l LEFT JOIN tk_i i USING ({id_col}) GROUP BY {of_l}),
tk_b AS (SELECT {id_col}, ids, list_slice(ids, 1, {L - 2}) AS body FROM tk_g),
tk AS (SELECT {id_col}, CAST(len(ids) AS INTEGER) AS n_tokens,
              [{TK.CLS}] || body || [{TK.SEP}] || list_transform(range({L} - 2 - len(body)), lambda x: {TK.PAD}) AS input_ids,
              list_transform(range(len(body) + 2), lambda x: 1) || list_transform(range({L} - 2 - len(body)), lambda x: 0) AS attention_mask
       FROM tk_b)"""


@register("vocabulary", "WITH " + SQL_VOCAB + """
SELECT token, n, token_id FROM voc
""")
def vocabulary(spark, sf_dir):
    return vocab(spark, sf_dir)


def _ids(spark, sf_dir, L=MAX_LENGTH):
    docs = ST.documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text")
    return TK.token_ids(docs, vocab(spark, sf_dir), L)


@register("token_ids", "WITH " + SQL_VOCAB + ", src AS (SELECT doc_id AS row_id, text FROM documents)"
          + sql_token_ids("src", "row_id", MAX_LENGTH) + """
SELECT row_id, n_tokens, array_to_string(input_ids, ',') AS input_ids,
       array_to_string(attention_mask, ',') AS attention_mask FROM tk
""")
def token_ids(spark, sf_dir):
    t = _ids(spark, sf_dir)
    return t.select("row_id", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"))


@register("token_ids_multi_hot", "WITH " + SQL_VOCAB + """,
src AS (SELECT l.doc_id AS row_id, d.text, l.quality, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
          + sql_token_ids("src", "row_id", MAX_LENGTH) + """
SELECT tk.row_id, n_tokens, array_to_string(input_ids, ',') AS input_ids,
       concat_ws(',', CAST(CAST(quality + toxic = 0 AS INTEGER) AS VARCHAR), CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)) AS labels
FROM tk JOIN src ON tk.row_id = src.row_id
""")
def token_ids_multi_hot(spark, sf_dir):
    rows = ST.labelled_rows(spark, sf_dir, CATS).withColumnRenamed("sentence", "text")
    rows = LO.add_none(rows, CATS, after="doc_id")
    hot = LF.multi_hot(LF.label_list(ML_CATS), ML_CATS)
    rows = rows.select("row_id", "text", hot.alias("hot"))
    t = TK.token_ids(rows, vocab(spark, sf_dir), MAX_LENGTH, keep=("hot",))
    return t.select("row_id", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join(F.transform("hot", lambda x: x.cast("int").cast("string")), ",").alias("labels"))


SQL_SENTENCES = f""",
sa AS (SELECT doc_id, {S.sentence_array(S.clean('text'))} AS arr FROM documents),
ss AS (SELECT doc_id, i - 1 AS pos, arr[i - 1] AS pre, arr[i] AS sentence, arr[i + 1] AS post
       FROM (SELECT doc_id, arr, unnest(generate_series(1, len(arr))) AS i FROM sa))"""


@register("token_ids_context", "WITH " + SQL_VOCAB + SQL_SENTENCES + """,
src AS (SELECT doc_id, pos,
               concat_ws(' ', coalesce(CASE WHEN pos > 0 THEN pre END, ''), coalesce(sentence, ''), coalesce(post, '')) AS text FROM ss)"""
          + sql_token_ids("src", "doc_id, pos", 512) + """
SELECT doc_id, CAST(pos AS INTEGER) AS pos, n_tokens, CAST(len(input_ids) AS INTEGER) AS length,
       md5(array_to_string(input_ids, ',')) AS input_ids_md5
FROM tk
""")
def token_ids_context(spark, sf_dir):
    """Ids of every sentence with its neighbours, at the length that goes with context (512)."""
    return _sentence_ids(spark, sf_dir, single_sentence=False)


@register("token_ids_sentence", "WITH " + SQL_VOCAB + SQL_SENTENCES + """,
src AS (SELECT doc_id, pos, coalesce(sentence, '') AS text FROM ss)"""
          + sql_token_ids("src", "doc_id, pos", 256) + """
SELECT doc_id, CAST(pos AS INTEGER) AS pos, n_tokens, CAST(len(input_ids) AS INTEGER) AS length,
       md5(array_to_string(input_ids, ',')) AS input_ids_md5
FROM tk
""")
def token_ids_sentence(spark, sf_dir):
    """Ids of every sentence alone, at the length that goes without context (256)."""
    return _sentence_ids(spark, sf_dir, single_sentence=True)


def _sentence_ids(spark, sf_dir, single_sentence: bool):
    from ..operators import sentences as SO
    rows = SO.sentences_with_context(SO.clean_documents(ST.documents(spark, sf_dir)))
    rows = SO.model_input(rows, single_sentence=single_sentence).select("doc_id", "pos", "text")
    t = TK.token_ids(rows, vocab(spark, sf_dir), SO.max_length_for(single_sentence), ids=("doc_id", "pos"))
    return t.select("doc_id", "pos", "n_tokens", F.size("input_ids").alias("length"),
                    F.md5(F.array_join("input_ids", ",")).alias("input_ids_md5"))


# --------------------------------------------------------------------------- sub-words
_LETTERS = "[" + ", ".join(S.q(c) for c in SW.byte_alphabet()) + "]"
SQL_SUBWORD = f"""
sv AS (SELECT unnest(map_entries(from_json(json_extract(content, '$.model.vocab'), '"MAP(VARCHAR,INTEGER)"'))) AS e
       FROM read_text({S.q(SW.tokenizer_path())})),
sp AS (SELECT regexp_replace(e.key, '</w>$', '') AS piece, e.key LIKE '%</w>' AS at_end, e.value + {TK.FIRST_ID} AS id FROM sv),
sx AS (SELECT doc_id AS row_id, {S.tokens(S.model_text('text'))} AS toks FROM documents),
su AS (SELECT row_id, unnest(toks[1:{MAX_LENGTH - 2}]) AS word, unnest(generate_series(1, least({MAX_LENGTH - 2}, len(toks)))) AS _at FROM sx),
sw AS (SELECT word, list_aggregate(list_transform(regexp_extract_all(hex(encode(word)), '..'),
                lambda h: {_LETTERS}[CAST('0x' || h AS INTEGER) + 1]), 'string_agg', '') AS letters
       FROM (SELECT DISTINCT word FROM su WHERE word NOT IN ({_specials_sql()}) AND len(word) <= {SW.MAX_WORD})),
sc AS (SELECT word, len(letters) AS size, letters, unnest(generate_series(1, len(letters))) AS k FROM sw),
sd AS (SELECT word, size, k, letters, unnest(generate_series(1, least(32, size - k + 1))) AS n FROM sc),
sb AS (SELECT word, size, k, max(n) AS n, arg_max(id, n) AS id
       FROM sd JOIN sp ON sp.piece = substr(letters, k, n) AND sp.at_end = (k + n - 1 = size) GROUP BY word, size, k),
sr(word, size, k, ids) AS (SELECT DISTINCT word, size, CAST(1 AS BIGINT), CAST([] AS INTEGER[]) FROM sb
       UNION ALL SELECT r.word, r.size, r.k + b.n, list_append(r.ids, CAST(b.id AS INTEGER))
       FROM sr r JOIN sb b ON r.word = b.word AND r.k = b.k),
sg AS (SELECT word, ids FROM sr WHERE k = size + 1)"""


@register("subword_words", "WITH RECURSIVE " + SQL_SUBWORD.replace(f"toks[1:{MAX_LENGTH - 2}]", "toks")
          .replace(f"least({MAX_LENGTH - 2}, len(toks))", "len(toks)") + f"""
SELECT u.word, count(*) AS n, coalesce(any_value(array_to_string(g.ids, ',')), '{TK.UNK}') AS ids
FROM su u LEFT JOIN sg g ON u.word = g.word WHERE u.word NOT IN ({_specials_sql()}) GROUP BY u.word
""")
def subword_words(spark, sf_dir):
    """Every distinct word of the documents with its occurrences and the ids of its pieces."""
    words = (ST.documents(spark, sf_dir).select(F.explode(TK.text_tokens(F.col("text"))).alias("word"))
             .where(~F.col("word").isin(*TK.SPECIAL_IDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    pieces = SW.word_pieces(words, SW.read_vocabulary(spark))
    return words.join(pieces, "word").select("word", "n", F.array_join("ids", ",").alias("ids"))


@register("subword_ids", "WITH RECURSIVE " + SQL_SUBWORD + f""",
si AS (SELECT u.row_id, u._at, CASE u.word {" ".join(f"WHEN {S.q(k)} THEN [{v}]" for k, v in TK.SPECIAL_IDS.items())}
                                    ELSE coalesce(g.ids, [{TK.UNK}]) END AS ids FROM su u LEFT JOIN sg g ON u.word = g.word),
sl AS (SELECT x.row_id, CAST(len(x.toks) AS INTEGER) AS n_words,
              coalesce((SELECT flatten(list(i.ids ORDER BY i._at)) FROM si i WHERE i.row_id = x.row_id), []) AS ids FROM sx x),
so AS (SELECT row_id, n_words, ids[1:{MAX_LENGTH - 2}] AS body FROM sl)
SELECT row_id, n_words, CAST(len(body) + 2 AS INTEGER) AS n_used,
       array_to_string([{TK.CLS}] || body || [{TK.SEP}] || list_transform(range({MAX_LENGTH - 2} - len(body)), lambda x: {TK.PAD}), ',') AS input_ids
FROM so
""")
def subword_ids(spark, sf_dir):
    """Fixed-length sub-word ids of every document (start, pieces, end, padding)."""
    docs = ST.documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text")
    t = SW.subword_ids(docs, SW.read_vocabulary(spark), MAX_LENGTH)
    used = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return t.select("row_id", "n_words", used.alias("n_used"), F.array_join("input_ids", ",").alias("input_ids"))
