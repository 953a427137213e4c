from pyspark.sql import functions as F

from lectern.operators import tokens as TK


def test_fixed_length_pad_and_truncate(spark):
    df = spark.createDataFrame([([10, 11, 12, 13],), (list(range(100, 500)),)], "ids array<int>")
    fx = TK.fixed_length(F.col("ids"), 8)
    r = df.select(fx["input_ids"].alias("i"), fx["attention_mask"].alias("m")).collect()
    assert r[0]["i"] == [TK.CLS, 10, 11, 12, 13, TK.SEP, TK.PAD, TK.PAD]
    assert r[0]["m"] == [1, 1, 1, 1, 1, 1, 0, 0]
    fx = TK.fixed_length(F.col("ids"), 256)
    r = df.select(fx["input_ids"].alias("i")).collect()[1]["i"]
    assert len(r) == 256 and r[0] == TK.CLS and r[-1] == TK.SEP and r[1:255] == list(range(100, 354))


def test_vocabulary_and_ids(spark):
    texts = spark.createDataFrame([(1, "b a a [SEP] xxx"), (2, "c b a"), (3, "")], "row_id long, text string")
    v = {r["token"]: (r["n"], r["token_id"]) for r in TK.vocabulary(texts).collect()}
    assert v == {"a": (3, 4), "b": (2, 5), "c": (1, 6)}
    ids = {r["row_id"]: r for r in TK.token_ids(texts, TK.vocabulary(texts), 8).collect()}
    assert ids[1]["input_ids"] == [TK.CLS, 5, 4, 4, TK.SEP, TK.UNK, TK.SEP, TK.PAD]
    assert ids[3]["n_tokens"] == 0 and ids[3]["input_ids"][:2] == [TK.CLS, TK.SEP]
