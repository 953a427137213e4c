from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import split as SP
from lectern.operators.ranking import exact_rank, shuffle_key


def long_rows(spark, counts):
    """counts: {category: (n_label0, n_label1)} -> long table."""
    rows, rid = [], 0
    for cat, (n0, n1) in counts.items():
        for lab, n in ((0, n0), (1, n1)):
            for _ in range(n):
                rows.append((rid, cat, lab))
                rid += 1
    return spark.createDataFrame(rows, "row_id long, category string, label int")


def test_quota_example(spark):
    strata = spark.createDataFrame([("c", 1, 58), ("c", 0, 341)], "category string, label int, n_c long")
    q = {r["label"]: r["test_quota"] for r in SP.stratified_quota(strata, 1 / 6).collect()}
    assert q == {1: 10, 0: 57}


def test_holdout_invariants(spark):
    df = long_rows(spark, {"a": (341, 58), "b": (348, 51), "c": (1200, 3)})
    h = SP.holdout_stratified(df).collect()
    for cat in "abc":
        rows = [r for r in h if r["category"] == cat]
        n = len(rows)
        test = [r for r in rows if r["split"] == "test"]
        assert len(test) == -(-n // 6)
        assert len({r["row_id"] for r in rows}) == n
    # split does not depend on partitioning
    again = SP.holdout_stratified(df.repartition(7)).collect()
    assert sorted(map(tuple, h)) == sorted(map(tuple, again))


def test_kfold_balance(spark):
    df = long_rows(spark, {"a": (270, 62)})
    f = SP.kfold_stratified(df, k=5).collect()
    sizes = Counter(r["fold"] for r in f)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for lab in (0, 1):
        s = Counter(r["fold"] for r in f if r["label"] == lab)
        assert max(s.values()) - min(s.values()) <= 1


def test_kfold_plain_matches_ntile(spark):
    rows = spark.range(332).withColumnRenamed("id", "row_id")
    f = SP.kfold_plain(rows, k=5)
    ref = rows.withColumn("fold", F.ntile(5).over(Window.orderBy(shuffle_key(1, "kfold", F.col("row_id")))))
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, ref.select("row_id", "fold").collect()))


def test_subsets_nested(spark):
    df = long_rows(spark, {"a": (180, 43), "b": (3, 0)})
    s = SP.growing_subsets(df, steps=5).collect()
    by = {}
    for r in s:
        by.setdefault((r["category"], r["train_size"]), set()).add(r["row_id"])
    assert sorted(by) == [("a", n) for n in (44, 88, 132, 176, 220)]  # too few rows of b for five chunks
    sizes = sorted(n for _, n in by)
    for a, b in zip(sizes, sizes[1:]):
        assert len(by["a", a]) == a and by["a", a] < by["a", b]


def test_null_labels_and_categories_lose_no_row(spark):
    rows = [(i, None if i % 6 == 0 else "a", None if i % 4 == 0 else i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "row_id long, category string, label int")
    assert SP.holdout_stratified(df).count() == 24
    folds = SP.kfold_stratified(df, k=5).collect()
    assert len(folds) == 24 and all(1 <= r["fold"] <= 5 for r in folds)


def test_holdout_check_and_language_split_once(spark):
    from lectern.operators import lang as LG

    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "le chat et la souris"), (3, None), (4, "xyz")],
                                 "doc_id long, text string")
    df = LG.language_id(docs)
    assert {r["doc_id"]: r["lang_detected"] for r in df.collect()} == {1: "en", 2: "fr", 3: "unknown", 4: "unknown"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan


def test_exact_rank_equals_window_under_skew(spark):
    # one stratum holds most rows
    df = long_rows(spark, {"hot": (5000, 7), "cold": (30, 4)}).withColumn(
        "_key", shuffle_key(1, F.col("category"), F.col("row_id")))
    fast = exact_rank(df, ["category", "label"], "_key", out="r", n_hex=2)
    slow = df.withColumn("r", F.row_number().over(Window.partitionBy("category", "label").orderBy("_key")))
    a = sorted((r["row_id"], r["r"]) for r in fast.collect())
    b = sorted((r["row_id"], r["r"]) for r in slow.collect())
    assert a == b


def test_task_mix_within_views(spark):
    df = long_rows(spark, {"a": (10, 0), "b": (6, 0)}).withColumn("view", F.explode(F.array(F.lit(1), F.lit(2))))
    df = df.where("view = 1 or row_id < 12")
    c = Counter((r["view"], r["category"]) for r in SP.task_mix(df, ["a", "b"], within="view").collect())
    assert c == {(1, "a"): 6, (1, "b"): 6, (2, "a"): 2, (2, "b"): 2}


def test_task_mix_even(spark):
    df = long_rows(spark, {"a": (40, 10), "b": (20, 5)})
    m = SP.task_mix(df, ["a", "b"]).collect()
    c = Counter(r["category"] for r in m)
    assert c["a"] == c["b"] == 25
    assert sorted(r["mix_pos"] for r in m) == list(range(1, 51))
