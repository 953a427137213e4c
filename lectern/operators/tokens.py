"""Vocabulary and fixed-length token id arrays (start, ids, end, padding) with masks.

Ids: ``[PAD]`` 0, ``[UNK]`` 1, ``[CLS]`` 2 (start), ``[SEP]`` 3 (end and separator), then
the vocabulary in order of descending count, ties by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TF
from . import coded as CO
from .ranking import global_index

# Special tokens and their ids.
SPECIAL_IDS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_ID = len(SPECIAL_IDS)


def text_tokens(text: Column, sep_replacement: str = " [SEP] ") -> Column:
    return TF.tokens(TF.model_text(text, sep_replacement))


def vocabulary(df: DataFrame, text_col: str = "text", max_size: int | None = None) -> DataFrame:
    """``(token, n, token_id)`` over all texts; ``max_size`` keeps the most frequent tokens.

    Counting is one ``groupBy`` with map-side combine; ids come from ``global_index``
    (range-partitioned sort + per-partition offsets), never a one-task window.
    """
    toks = df.select(F.explode(text_tokens(F.col(text_col))).alias("token"))
    counts = (toks.where(~F.col("token").isin(*SPECIAL_IDS))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    ranked = global_index(counts, [F.col("n").desc(), F.col("token").asc()], out="_idx")
    if max_size is not None:
        ranked = ranked.where(F.col("_idx") <= max_size)
    return ranked.select("token", "n", (F.col("_idx") + FIRST_ID - 1).alias("token_id"))


def special_id(token: Column) -> Column:
    out = None
    for tok, i in SPECIAL_IDS.items():
        out = (F.when(token == tok, F.lit(i)) if out is None else out.when(token == tok, F.lit(i)))
    return out


def fixed_length(ids: Column, max_length: int) -> dict[str, Column]:
    """Start + first ``max_length - 2`` ids + end, padded to ``max_length``; with its mask."""
    body = TF.leading(ids, max_length)
    used = F.size(body) + 2
    pad = F.array_repeat(F.lit(PAD), F.lit(max_length) - used)
    input_ids = F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)), pad)
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used))
    return {"input_ids": input_ids, "attention_mask": mask}


def token_ids(df: DataFrame, vocab: DataFrame, max_length: int, ids=("row_id",),
              text_col: str = "text", keep=()) -> DataFrame:
    """``(ids…, keep…, n_tokens, input_ids, attention_mask)`` for every row of ``df``, which
    the columns ``ids`` name.

    The whole text is tokenised; ``n_tokens`` is its full length before truncation. Only the
    positions that fit the fixed length are looked up, each token once a batch of rows
    (``coded``); unknown tokens get ``[UNK]``.
    """
    toks = df.select(*ids, *keep, text_tokens(F.col(text_col)).alias("_t"))
    batches = CO.batched(toks.select(*ids, *keep, F.size("_t").alias("n_tokens"), TF.leading("_t", max_length).alias("_t")), "_t")
    ided = CO.words(batches).join(vocab.select("token", "token_id"), "token", "left").select(
        "batch", "code", F.coalesce(special_id(F.col("token")), F.col("token_id"), F.lit(UNK)).alias("_id"))
    rows = CO.token_values(batches, ided, "_id", "_ids", UNK)
    carried = [F.first(c).alias(c) for c in (*keep, "n_tokens")]  # the same on all of a row's tokens
    grouped = rows.groupBy(*ids).agg(F.collect_list("_ids").alias("_l"), *carried)
    # rows that share their ids are read place by place, as one
    pairs = F.sort_array(F.flatten(F.transform("_l", lambda x: F.transform(x, lambda v, i: F.struct(i.alias("_at"), v.alias("_id"))))))
    grouped = grouped.withColumn("_p", F.when(F.size("_l") == 1, F.get("_l", F.lit(0))).otherwise(
        F.transform(pairs, lambda p: p["_id"])))
    fx = fixed_length(F.col("_p"), max_length)
    return grouped.select(*ids, *keep, "n_tokens",
                          fx["input_ids"].alias("input_ids"), fx["attention_mask"].alias("attention_mask"))
