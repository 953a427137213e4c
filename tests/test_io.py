import os
import tempfile

from pyspark.sql import types as T

from lectern.operators import sentences as SO
from lectern.sources import io as IO


def test_review_files_whole_text(spark):
    d = tempfile.mkdtemp(prefix="lectern-reviews-")
    with open(os.path.join(d, "r1.txt"), "w") as f:
        f.write("1. Relevance\n\nStrengths:\nThe topic is new. It matters.\n")
    with open(os.path.join(d, "r2.txt"), "w") as f:
        f.write("Weaknesses:\nToo long.\n")
    docs = IO.read_review_files(spark, d)
    assert docs.count() == 2
    s = SO.sentences(SO.clean_documents(docs)).collect()
    assert sorted(r["sentence"] for r in s) == ["it matters.", "the topic is new.", "too long."]


def test_labelled_csv_na_words(spark):
    d = tempfile.mkdtemp(prefix="lectern-csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write('row_id,sentence,a\n1,"multi\nline, ""quoted""",1\n2,NA,0\n3,,1\n4,n/a,0\n')
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("sentence", T.StringType()),
                           T.StructField("a", T.IntegerType())])
    rows = {r["row_id"]: r for r in IO.read_labelled_csv(spark, p, schema).collect()}
    assert rows[1]["sentence"] == 'multi\nline, "quoted"'
    assert rows[2]["sentence"] is None and rows[3]["sentence"] is None and rows[4]["sentence"] is None
