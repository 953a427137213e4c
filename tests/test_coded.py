import pytest
from pyspark.sql import functions as F

from lectern.operators import bayes as NB
from lectern.operators import coded as CO
from lectern.operators import prevalence as PV
from lectern.operators import tokens as TK


def common(spark, n=3000):
    """Rows that all hold one word, beside a word of their own."""
    return spark.range(n).select(F.col("id").alias("row_id"), F.format_string("every every w%d", "id").alias("text"))


def test_a_token_is_sent_once_a_batch(spark):
    df = common(spark).select("row_id", F.split("text", " ").alias("t"))
    b = CO.batched(df.coalesce(1), "t")
    words = CO.words(b)
    assert words.where("token = 'every'").count() == b.count() < 10
    assert words.count() == 3000 + b.count()
    small = CO.batched(df.where("row_id < 7").coalesce(1), "t", size=10)
    found = CO.words(small).where("token <> 'every'").withColumn("v", F.length("token"))
    got = {r.row_id: list(r.x) for r in CO.token_values(small, found, "v", "x", -1).collect()}
    assert small.count() == 3 and set(map(tuple, got.values())) <= {(-1, -1, n) for n in range(2, 6)} and len(got) == 7


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_row_a_token_is_joined(spark):
    """Texts go into batches before any token becomes a row of the join with the vocabulary."""
    texts = common(spark, 20)
    ids = TK.token_ids(texts, TK.vocabulary(texts), 8)
    assert "regexp_extract_all" not in plan(ids)
    sents = texts.select(F.col("row_id").alias("doc_id"), F.lit(0).alias("pos"), F.col("text").alias("sentence"))
    w = spark.createDataFrame([("every", [1.0, 2.0])], "token string, w array<double>")
    bias = spark.createDataFrame([([0.0, 0.0],)], "bias array<double>")
    assert "regexp_extract_all" not in plan(PV.score_sentences(sents, w, bias, ["a", "b"]))
    w = spark.createDataFrame([("every", [1.0] * 20)], "token string, w array<double>")
    sums = NB.sums(NB.term_counts(texts), w, 20)  # more than one aggregate holds
    assert "regexp_extract_all" not in plan(sums)
    assert {tuple(r.s) for r in sums.collect()} == {(2.0,) * 20}


def test_odd_rows(spark):
    """Null and repeated ids, null, empty and unknown texts."""
    rows = [(None, "a b"), (1, "a zz a"), (1, "b"), (2, None), (3, ""), (4, "zz")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    w = spark.createDataFrame([("a", [1.0] * 20), ("b", [float(i) for i in range(20)])], "token string, w array<double>")
    got = {r.row_id: list(r.s) for r in NB.sums(NB.term_counts(df), w, 20).collect()}
    assert got[1] == pytest.approx([2.0 + i for i in range(20)]) and got[None] == pytest.approx([1.0 + i for i in range(20)])
    assert got.get(4, [0.0] * 20) == [0.0] * 20 and not set(got) & {2, 3}
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, token_id int")
    ids = {r.row_id: list(r.input_ids) for r in TK.token_ids(df, vocab, 6).collect()}
    assert ids[None] == [2, 4, 5, 3, 0, 0] and ids[1] == [2, 4, 5, 1, 4, 3] and ids[2] == ids[3] == [2, 3, 0, 0, 0, 0]
    sents = df.select(F.col("row_id").alias("doc_id"), F.lit(0).alias("pos"), F.col("text").alias("sentence"))
    wide = PV.score_sentences_wide(sents, w, spark.createDataFrame([([0.0] * 20,)], "bias array<double>"),
                                   [f"c{i}" for i in range(20)], keep_text=True).collect()
    assert {r.doc_id: r.c0 > 0.6 for r in wide} == {None: True, 1: True, 2: False, 3: False, 4: False}


def test_few_batches_are_held_at_once(spark, monkeypatch):
    """A file holds few batches, as readers take up to 4,096 of its rows at once; a lookup takes one batch."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(CO, "IN_FILE", 3)
    df = common(spark, 200).select("row_id", F.split("text", " ").alias("t"))
    b = CO.batched(df.coalesce(1), "t", size=30)
    files = [f for path in b.inputFiles() for f in glob.glob(path.removeprefix("file://"))]
    assert b.count() == 20 and max(pq.read_metadata(f).num_rows for f in files) == 3
    found = CO.words(b).where("token = 'every'").withColumn("v", F.lit(7))
    values = CO.token_values(b, found, "v", "x", -1)
    assert "CoGroup" in plan(values) and "collect_list" not in plan(values)
    assert {tuple(r.x) for r in values.collect()} == {(7, 7, -1)}
    none = CO.token_values(b, found.where("false"), "v", "x", -1)  # nothing is found
    assert {tuple(r.x) for r in none.collect()} == {(-1, -1, -1)}


def test_sentence_scores_look_up_one_batch_at_a_time(spark):
    sents = common(spark, 50).select(F.col("row_id").alias("doc_id"), F.lit(0).alias("pos"), F.col("text").alias("sentence"))
    w = spark.createDataFrame([("every", [1.0, 2.0])], "token string, w array<double>")
    bias = spark.createDataFrame([([0.0, -4.0],)], "bias array<double>")
    scores = PV.score_sentences(sents, w, bias, ["a", "b"])
    assert "CoGroup" in plan(scores) and "collect_list" not in plan(scores)
    assert {(r.category, round(r.prob, 6)) for r in scores.collect()} == {("a", .880797), ("b", .5)}
