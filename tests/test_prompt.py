import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import prompt as PR
from lectern.sources import templates as TP


def test_render_generate_parse(spark):
    df = spark.createDataFrame([(1, "positive", "great work"), (2, "negative", "weak")],
                               "row_id long, category string, text string")
    r = PR.render(df, TP.template_table(spark))
    msgs = {x["row_id"]: x["messages"] for x in r.collect()}
    assert [m["role"] for m in msgs[1]] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert "'Positive Statement'" in msgs[1][1]["content"]
    assert msgs[1][5]["content"] == TP.FINAL_PREFIX + "great work"

    def gen(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series([TP.YES_TAG if "great" in m[-1]["content"] else "no idea" for m in pdf["messages"]])

    out = PR.generate(r, gen).select("row_id", PR.parse_yes(PR.answer(F.col("chat"))).alias("y"),
                                     F.size("chat").alias("n"))
    got = {x["row_id"]: (x["y"], x["n"]) for x in out.collect()}
    assert got == {1: (1, 7), 2: (0, 7)}


def test_parse_null_is_zero(spark):
    df = spark.createDataFrame([(None,)], "a string")
    assert df.select(PR.parse_yes(F.col("a")).alias("y")).first()["y"] == 0
