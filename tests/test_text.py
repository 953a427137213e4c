import random

from pyspark.sql import functions as F

from lectern.functions import text as TF
from lectern.operators import sentences as SO


def one(spark, expr, value="x", dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_text_chain(spark):
    assert one(spark, TF.model_text, "ab XXX c[SEP]d [unk]xxxx") == "ab  [UNK]  c [SEP] d  [UNK]  [UNK] x"


def test_null_text_is_empty(spark):
    assert one(spark, TF.model_text, None) == ""


def test_fewshot_separator(spark):
    assert one(spark, lambda c: TF.model_text(c, TF.FEWSHOT_SEP), "a[SEP]b") == "a . b"


def test_context_keeps_spaces(spark):
    df = spark.createDataFrame([(None, "b", None)], "a string, b string, c string")
    assert df.select(TF.context_text("a", "b", "c").alias("r")).first()["r"] == " b "


def test_split_sentences(spark):
    assert one(spark, TF.split_sentences, "A. B. C d.") == ["A.", "B.", "C d."]
    assert one(spark, TF.split_sentences, "") == [""]
    assert one(spark, TF.split_sentences, "see e.g. this. Not split? yes") == ["see e.g. this.", "Not split? yes"]


def test_heading_removed_before_whitespace_cleanup(spark):
    assert one(spark, TF.strip_headings, "1. Head line\nText.") == "\nText."


def test_clean_review_shape(spark):
    raw = ("\n\n1. Scientific Relevance\n\nStrengths:\nThe topic is good.\tIt is new.\n\n"
           "General Comment:\nFine.  Done.\n\nOverall Assessment\n\nStrong.")
    assert one(spark, TF.clean_review, raw) == "The topic is good. It is new. Fine. Done. Strong."


def test_clean_review_equals_the_plain_chain(spark):
    rng = random.Random(3)
    bits = ["1. Head", "٣. Kopf", "2020.\u00a0x", "strengths:", "WEAKNESSES:", "General Comment:", "overall assessment",
            "Stren", "gths:", "\n", "\t", "  ", " ", "\u00a0", "\u2003", "\x0b", "\x0c\r", "\x1f", "é", "K", "ſ", "a.", "B", ""]
    texts = [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for titles in (TF.SECTION_TITLES, ("Größe:", "Strengths:"), ("a\nb",), ()):
        for anchored in (False, True):
            for wide in (False, True):
                t = TF.strip_headings(F.col("v"), line_anchored=anchored, unicode=wide)
                t = TF.flatten_whitespace(TF.strip_titles(t, titles) if titles else t)
                plain = F.trim(F.regexp_replace(t, r"(?U)\s+" if wide else r"\s+", " "))
                got = TF.clean_review(F.col("v"), titles, anchored, wide)
                assert df.where(~got.eqNullSafe(plain)).count() == 0


def test_tokens_keep_special_tokens(spark):
    assert one(spark, lambda c: TF.tokens(TF.model_text(c)), "a xxx[SEP]b") == ["a", "[UNK]", "[SEP]", "b"]


def test_sentences_with_context(spark):
    df = spark.createDataFrame([(1, "One here. Two there. Three.")], "doc_id long, clean_text string")
    rows = SO.sentences_with_context(df).orderBy("pos").collect()
    assert [r["sentence"] for r in rows] == ["One here.", "Two there.", "Three."]
    assert rows[0]["sentence_pre"] is None and rows[-1]["sentence_post"] is None
    assert rows[1]["sentence_pre"] == "One here." and rows[1]["sentence_post"] == "Three."


def test_context_from_rows_equals_window(spark):
    from pyspark.sql import Window
    rows = [(d, p, f"s{d}-{p}") for d in range(3) for p in range(d * 4 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, sentence string")
    got = sorted(map(tuple, SO.context_from_rows(df).collect()))
    w = Window.partitionBy("doc_id").orderBy("pos")
    exp = df.select("*", F.lag("sentence").over(w).alias("sentence_pre"),
                    F.lead("sentence").over(w).alias("sentence_post"))
    assert got == sorted(map(tuple, exp.collect()))
