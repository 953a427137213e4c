import os
import shutil
import tempfile

from conftest import SF_SMALL
from lectern.plans import models as MD
from lectern.streaming import prevalence as SP


def test_stream_equals_batch(spark):
    weights, bias = MD.final_models(spark, SF_SMALL)
    weights, bias = weights.cache(), bias.cache()
    out = tempfile.mkdtemp(prefix="lectern-stream-")
    src = os.path.join(out, "src")
    os.makedirs(src)
    shutil.copy(os.path.join(SF_SMALL, "documents.parquet"), os.path.join(src, "part-0.parquet"))
    q = SP.start_prevalence_stream(spark, src,
                                   os.path.join(out, "sink"), os.path.join(out, "ckpt"),
                                   weights, bias, MD.CATS, max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(out, "sink")).drop("batch_id")
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    exp = SP.batch_prevalence(docs, weights, bias, MD.CATS)
    norm = lambda d: sorted((r["doc_id"], r["category"], r["n_sentences"], round(r["share"], 9))
                            for r in d.collect())
    assert norm(got) == norm(exp) and len(norm(exp)) > 0
