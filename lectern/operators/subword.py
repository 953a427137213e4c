"""Sub-word token ids: words parted into vocabulary pieces by greedy longest match.

The vocabulary comes from a public tokenizer's file (its path is a parameter; nothing is learnt
here). Its pieces are written in byte letters, and a piece at the end of a word carries the
file's word-end mark. From the left, a word gives up its longest piece, then its rest the next.
A word of more than ``MAX_WORD`` characters, or with a place where no piece fits, is ``[UNK]``.

While the vocabulary has at most ``HELD_PIECES`` pieces, tasks hold it and match their own rows'
distinct words. A larger one meets the words in joins: every substring that could be a piece is
looked up with one equi-join, the longest per place is kept, a fold over the places walks from
piece to piece, and texts fetch their words' ids with one join on the word.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TF
from . import coded as CO
from .ranking import materialize
from .tokens import FIRST_ID, SPECIAL_IDS, UNK, fixed_length, special_id, text_tokens

TOKENIZER = "word_bpe_49k.json"
MAX_WORD = 100  # characters, as in the tokenizers of the reference's models
HELD_PIECES = 1 << 17  # pieces of a vocabulary that tasks hold
KNOWN = 1 << 17        # words whose pieces a task keeps


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> str:
    """256 letters, one for each byte: visible Latin-1 characters stand for themselves, the rest
    for U+0100 and on, in order."""
    visible = [c for lo, hi in ((33, 126), (161, 172), (174, 255)) for c in range(lo, hi + 1)]
    rest = (c for c in range(256) if c not in set(visible))
    letters = {c: chr(c) for c in visible} | {c: chr(256 + i) for i, c in enumerate(rest)}
    return "".join(letters[c] for c in range(256))


def byte_letters(word: Column) -> Column:
    """A word as the letters of its UTF-8 bytes."""
    alphabet = byte_alphabet()
    hidden = [c for c in range(256) if alphabet[c] != chr(c)]
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, hidden)), "".join(alphabet[c] for c in hidden))


def read_vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(piece, at_end, token_id)`` of a byte-level tokenizer file with a word-end mark. Ids follow
    the special tokens of ``tokens.SPECIAL_IDS``. The size is the file's, some 50,000 rows."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark = model.get("end_of_word_suffix") or ""
    if not mark:
        raise ValueError("the vocabulary has no word-end mark")
    rows = [(p.removesuffix(mark), p.endswith(mark), i + FIRST_ID) for p, i in model["vocab"].items()]
    return spark.createDataFrame(rows, "piece string, at_end boolean, token_id int")


def _held(vocab: DataFrame):
    """``(inner, last, longest)`` of a vocabulary of HELD_PIECES rows at most: ids by piece, for a
    place inside a word and at its end, and the length of the longest one. None for a larger one."""
    if vocab.limit(HELD_PIECES + 1).count() > HELD_PIECES:
        return None
    tables: tuple[dict, dict] = {}, {}
    for r in vocab.where("piece <> '' and at_end is not null and token_id is not null").collect():
        table = tables[r["at_end"]]
        table[r["piece"]] = max(r["token_id"], table.get(r["piece"], r["token_id"]))
    return *tables, max((len(p) for t in tables for p in t), default=1)


def greedy_ids(word: str, letters: dict, inner: dict, last: dict, longest: int, max_word: int = MAX_WORD) -> list[int]:
    """The ids of a word's pieces. ``letters`` are the byte letters by byte."""
    if len(word) > max_word:
        return [UNK]
    text, at, ids = word.encode().decode("latin-1").translate(letters), 0, []
    while at < len(text):
        for end in range(min(len(text), at + longest), at, -1):
            found = (last if end == len(text) else inner).get(text[at:end])
            if found is not None:
                break
        else:
            return [UNK]
        ids.append(found)
        at = end
    return ids


def _pieces_by_tasks(words: DataFrame, column: str, held, max_word: int, specials: bool) -> DataFrame:
    """``words`` with ``_ids array<array<int>>`` for its list of words ``column``: the pieces of each."""
    from ..session import ship_package

    ship_package(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast(held)
    others = [f for f in words.schema.fields if f.name != column]
    schema = T.StructType([*others, T.StructField("_ids", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        letters = dict(enumerate(byte_alphabet()))
        known = {w: [i] for w, i in SPECIAL_IDS.items()} if specials else {}
        for big in batches:
            for part in CO.slices(big, column, CO.TOKENS):
                lists = part.column(column)
                coded = lists.flatten().dictionary_encode()
                found = []
                for w in coded.dictionary.to_pylist():
                    ids = known.get(w)
                    if ids is None:
                        ids = greedy_ids(w, letters, *shared.value, max_word)
                        if len(known) < KNOWN:
                            known[w] = ids
                    found.append(ids)
                pieces = pa.array(found, pa.list_(pa.int32())).take(coded.indices)
                ends = pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))),
                                pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in others], pa.ListArray.from_arrays(ends, pieces)],
                                                 schema.names)

    return words.mapInArrow(run, schema)


def word_pieces(words: DataFrame, vocab: DataFrame, word_col: str = "word", max_word: int = MAX_WORD) -> DataFrame:
    """``(word, ids array<int>)`` for every distinct non-null word.

    In joins, a word's substrings are at most its bytes times the longest piece, and its bytes at most four
    times ``max_word``, so no group grows with the data.
    """
    distinct = words.select(F.col(word_col).alias("word")).where("word is not null and word <> ''").distinct()
    held = _held(vocab)
    if held is not None:
        return (_pieces_by_tasks(distinct.withColumn("_t", F.array("word")), "_t", held, max_word, False)
                .select("word", F.get("_ids", F.lit(0)).alias("ids")))
    longest = vocab.agg(F.max(F.length("piece"))).first()[0] or 1
    short = distinct.where(F.length("word") <= max_word).withColumn("letters", byte_letters(F.col("word")))
    size = F.length("letters")
    cut = (short.select("word", "letters", size.alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("at"))
           .select("word", "size", "at", "letters",
                   F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("at") + 1))).alias("n"))
           .select("word", "size", "at", "n", F.substring("letters", F.col("at"), F.col("n")).alias("piece"),
                   (F.col("at") + F.col("n") - 1 == F.col("size")).alias("at_end")))
    fits = (cut.join(vocab, ["piece", "at_end"])
            .groupBy("word", "size", "at").agg(F.max(F.struct("n", "token_id")).alias("best")))
    places = fits.groupBy("word", "size").agg(F.array_sort(F.collect_list(F.struct("at", "best.n", "best.token_id"))).alias("places"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(state, place):
        here = place["at"] == state["at"]
        return F.struct(F.when(here, state["at"] + place["n"]).otherwise(state["at"]).alias("at"),
                        F.when(here, F.array_append(state["ids"], place["token_id"])).otherwise(state["ids"]).alias("ids"))

    walked = places.select("word", "size", F.aggregate("places", start, step).alias("end"))
    whole = walked.where("end.at = size + 1").select("word", "end.ids")
    return distinct.join(whole, "word", "left").select("word", F.coalesce("ids", F.array(F.lit(UNK))).alias("ids"))


def subword_ids(df: DataFrame, vocab: DataFrame, max_length: int, ids=("row_id",), text_col: str = "text",
                keep=()) -> DataFrame:
    """``(ids…, keep…, n_words, input_ids, attention_mask)``: start, the text's first
    ``max_length - 2`` pieces, end, padding, and the mask. ``ids`` must name a row.

    A word gives one piece at least, so no word past ``max_length - 2`` is looked up; ``n_words``
    counts them all. Rows that share their ids are one, with their words by place. Special tokens keep their ids. Null and empty texts have start and end only.
    """
    words = df.select(*ids, *keep, text_tokens(F.col(text_col)).alias("_t"))
    words = words.select(*ids, *keep, F.size("_t").alias("n_words"), TF.leading("_t", max_length).alias("_t"))
    carried = [F.first(c).alias(c) for c in (*keep, "n_words")]  # the same on all of a row's words
    held = _held(vocab)
    if held is None:
        grouped = _grouped_by_joins(words, vocab, ids, carried)
    else:
        rows = _pieces_by_tasks(words, "_t", held, MAX_WORD, True)
        grouped = (rows.groupBy(*ids).agg(F.collect_list("_ids").alias("_l"), *carried)
                   .withColumn("_p", F.when(F.size("_l") == 1, F.get("_l", F.lit(0))).otherwise(_by_place("_l"))))
    fixed = fixed_length(F.flatten("_p"), max_length)
    return grouped.select(*ids, *keep, "n_words", fixed["input_ids"].alias("input_ids"),
                          fixed["attention_mask"].alias("attention_mask"))


def _by_place(rows: str) -> Column:
    """The words of rows that share their ids, by place and then by pieces."""
    placed = F.transform(rows, lambda p: F.transform(p, lambda x, i: F.struct(i.alias("at"), x.alias("ids"))))
    return F.transform(F.array_sort(F.flatten(placed)), lambda p: p["ids"])


def _grouped_by_joins(words: DataFrame, vocab: DataFrame, ids, carried) -> DataFrame:
    """``(ids…, _p array<array<int>>)`` and what is carried: the words' pieces in order."""
    others = [c for c in words.columns if c != "_t"]
    used = materialize(words.select(*others, F.posexplode_outer("_t").alias("_at", "word")))
    plain = used.where(~F.col("word").isin(*SPECIAL_IDS))
    pieces = materialize(word_pieces(plain, vocab))
    found = used.join(pieces.withColumnRenamed("ids", "_ids"), "word", "left").withColumn(
        "_ids", F.when(F.col("word").isin(*SPECIAL_IDS), F.array(special_id(F.col("word")))).otherwise(F.col("_ids")))
    return found.groupBy(*ids).agg(
        F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("_at", "_ids")))).alias("_p"),
        *carried).withColumn("_p", F.transform("_p", lambda p: p["_ids"]))
