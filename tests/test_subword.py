import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import subword as SW
from lectern.operators import tokens as TK


def greedy(word, vocab, mark="</w>", max_word=SW.MAX_WORD):
    """Longest piece first, on the word's byte letters."""
    if len(word) > max_word:
        return [TK.UNK]
    alphabet = SW.byte_alphabet()
    rest, out = "".join(alphabet[b] for b in word.encode()), []
    while rest:
        for n in range(len(rest), 0, -1):
            piece = rest[:n] + (mark if n == len(rest) else "")
            if piece in vocab:
                out.append(vocab[piece] + TK.FIRST_ID)
                rest = rest[n:]
                break
        else:
            return [TK.UNK]
    return out


@pytest.fixture(scope="module")
def file_vocab():
    with open(SW.tokenizer_path(), encoding="utf-8") as f:
        return json.load(f)["model"]["vocab"]


def test_byte_letters(spark):
    words = ["plain", "größe", "naïve", "日本", "😀", "\x00\x7f", "a\xadb"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", SW.byte_letters(F.col("w")).alias("x")).collect()
    alphabet = SW.byte_alphabet()
    assert len(set(alphabet)) == 256
    assert {r.w: r.x for r in got} == {w: "".join(alphabet[b] for b in w.encode()) for w in words}


def test_pieces_against_greedy_match(spark, file_vocab):
    words = ["the", "unbelievable", "größe", "x" * 100, "x" * 101, "日本語", "😀", "antidisestablishmentarianism", "!", "12345", "q\x00z",
             "étionement", "the", "a" * 99 + "b"]
    got = SW.word_pieces(spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string"), SW.read_vocabulary(spark))
    assert {r.word: list(r.ids) for r in got.collect()} == {w: greedy(w, file_vocab) for w in words}


def test_a_place_without_a_piece_is_unknown(spark):
    vocab = spark.createDataFrame([("ab", False, 4), ("c", True, 5), ("a", False, 6), ("b", True, 7)],
                                  "piece string, at_end boolean, token_id int")
    got = SW.word_pieces(spark.createDataFrame([("abc",), ("ab",), ("abx",), ("ca",), ("c",)], "word string"), vocab)
    assert {r.word: list(r.ids) for r in got.collect()} == {"abc": [4, 5], "ab": [6, 7], "abx": [1], "ca": [1], "c": [5]}


def test_fixed_length_ids(spark, file_vocab):
    rows = [(1, "The unbelievable [SEP] größe."), (2, None), (3, ""), (4, "word " * 50), (5, "xxx")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    got = {r.row_id: r for r in SW.subword_ids(df, SW.read_vocabulary(spark), 8).collect()}
    first = [*greedy("the", file_vocab), *greedy("unbelievable", file_vocab), TK.SEP, *greedy("größe", file_vocab), *greedy(".", file_vocab)]
    assert list(got[1].input_ids) == ([TK.CLS] + first[:6] + [TK.SEP] + [TK.PAD] * 6)[:8] and got[1].n_words == 5
    for i in (2, 3):
        assert list(got[i].input_ids) == [TK.CLS, TK.SEP] + [TK.PAD] * 6 and list(got[i].attention_mask) == [1, 1] + [0] * 6
    assert got[4].n_words == 50 and list(got[4].attention_mask) == [1] * 8 and got[4].input_ids[-1] == TK.SEP
    assert list(got[5].input_ids)[:3] == [TK.CLS, TK.UNK, TK.SEP]


def test_ids_by_several_columns(spark):
    """Sentences of a very long document keep their own rows."""
    rows = [(1, 100_000, "a b"), (2, 0, "c d")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, text string")
    vocab = TK.vocabulary(df)
    assert TK.token_ids(df, vocab, 8, ids=("doc_id", "pos")).count() == 2


def test_large_vocabulary_and_rows_that_share_an_id(spark, monkeypatch):
    """A vocabulary that tasks hold and one that meets the words in joins give the same rows."""
    vocab = SW.read_vocabulary(spark)
    rows = [(1, "The unbelievable [SEP] größe."), (1, "a second naïve row"), (1, "a second naïve row"), (2, None), (None, "x" * 101),
            (None, "of no id"), (3, "")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    words = df.select(F.explode(TK.text_tokens(F.col("text"))).alias("word"))

    def both():
        ids = SW.subword_ids(df, vocab, 16)
        return (sorted(ids.collect(), key=str), sorted(SW.word_pieces(words, vocab).collect(), key=str),
                ids._jdf.queryExecution().toString())

    held = both()
    monkeypatch.setattr(SW, "HELD_PIECES", 100)
    joined = both()
    assert held[:2] == joined[:2] and len(held[0]) == 4
    # no row a word is sent: one exchange of rows by id
    assert "Generate" not in held[2] and "Join" not in held[2] and "Join" in joined[2]
