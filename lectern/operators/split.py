"""Reproducible hold-outs, k-folds, nested training subsets and task mixing on the long table.

All splits work on the long form ``(row_id, category, label, …)`` so every category is
split in the same job. Orders come from md5 keys (``ranking.shuffle_key``), ranks from
``ranking.exact_rank``; per-stratum quotas are computed on tiny aggregate tables (their
size is bounded by categories x labels, so AQE broadcasts them). Rows with a null category
or label are strata of their own: no row is lost.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import exact_rank, shuffle_key

TRAIN, TEST = "train", "test"


def _fraction(share) -> Fraction:
    return share if isinstance(share, Fraction) else Fraction(share).limit_denominator(10_000)


def stratified_quota(strata: DataFrame, share, part: str = "category", label: str = "label",
                     count_col: str = "n_c") -> DataFrame:
    """Test rows per stratum for a stratified hold-out.

    Test size is ``ceil(share * n)``. The training rows are shared out first in
    proportion to the class counts, floors plus one extra row for the largest remainders
    (ties: smaller label first), and each class's test quota is the rest.
    """
    s = _fraction(share)
    w = Window.partitionBy(part)
    c = F.col
    q = (strata
         .withColumn("_n", F.sum(count_col).over(w))
         .withColumn("_n_test", F.expr(f"(_n * {s.numerator} + {s.denominator - 1}) div {s.denominator}"))
         .withColumn("_n_train", c("_n") - c("_n_test"))
         .withColumn("_fl", F.expr(f"({count_col} * _n_train) div _n"))
         .withColumn("_rem", F.expr(f"pmod({count_col} * _n_train, _n)"))
         .withColumn("_need", c("_n_train") - F.sum("_fl").over(w))
         .withColumn("_rk", F.row_number().over(Window.partitionBy(part).orderBy(c("_rem").desc(), c(label))))
         .withColumn("test_quota", c(count_col) - c("_fl") - (c("_rk") <= c("_need")).cast("long")))
    return q.select(part, label, count_col, "test_quota")


def holdout_stratified(long_df: DataFrame, share=Fraction(1, 6), seed: int = 1,
                       part: str = "category", label: str = "label", row_id: str = "row_id") -> DataFrame:
    """One stratified train/test split per category; adds ``split`` and ``rank``."""
    keyed = long_df.withColumn("_key", shuffle_key(seed, "holdout", F.col(part), F.col(row_id)))
    strata = keyed.groupBy(part, label).agg(F.count(F.lit(1)).alias("n_c"))
    quota = stratified_quota(strata, share, part, label)
    ranked = exact_rank(keyed, [part, label], "_key", out="_rank")
    quota = quota.select(F.col(part).alias("_q_part"), F.col(label).alias("_q_label"), "test_quota")
    return (ranked.join(quota, F.col(part).eqNullSafe(F.col("_q_part")) & F.col(label).eqNullSafe(F.col("_q_label")))
            .withColumn("split", F.when(F.col("_rank") <= F.col("test_quota"), F.lit(TEST))
                        .otherwise(F.lit(TRAIN)))
            .drop("_key", "_rank", "test_quota", "_q_part", "_q_label"))


def holdout_plain(rows: DataFrame, share=Fraction(1, 6), seed: int = 1,
                  row_id: str = "row_id") -> DataFrame:
    """One split for all categories (multi-label: label sets cannot be stratified)."""
    s = _fraction(share)
    keyed = rows.withColumn("_key", shuffle_key(seed, "holdout", F.col(row_id)))
    ranked = exact_rank(keyed, [], "_key", out="_rank", total="_n")
    n_test = F.expr(f"(_n * {s.numerator} + {s.denominator - 1}) div {s.denominator}")
    return (ranked.withColumn("split", F.when(F.col("_rank") <= n_test, F.lit(TEST)).otherwise(F.lit(TRAIN)))
            .drop("_key", "_rank", "_n"))


def kfold_stratified(train_long: DataFrame, k: int = 5, seed: int = 1, part: str = "category",
                     label: str = "label", row_id: str = "row_id") -> DataFrame:
    """Stratified k folds per category: rows sorted by (label, key) are dealt round-robin,
    so fold sizes differ by at most one overall and within each class."""
    keyed = train_long.withColumn("_key", shuffle_key(seed, "kfold", F.col(part), F.col(row_id)))
    ranked = exact_rank(keyed, [part], "_key", lead_cols=[label], out="_rank")
    return (ranked.withColumn("fold", (F.pmod(F.col("_rank") - 1, F.lit(k)) + 1).cast("int"))
            .drop("_key", "_rank"))


def kfold_plain(train_rows: DataFrame, k: int = 5, seed: int = 1, row_id: str = "row_id") -> DataFrame:
    """``ntile(k)`` over the key order: the first ``n mod k`` folds get one more row."""
    keyed = train_rows.withColumn("_key", shuffle_key(seed, "kfold", F.col(row_id)))
    ranked = exact_rank(keyed, [], "_key", out="_rank", total="_n")
    fold = F.expr(f"""CASE WHEN _rank <= (_n % {k}) * (_n div {k} + 1)
                           THEN (_rank - 1) div (_n div {k} + 1) + 1
                           ELSE (_n % {k}) + (_rank - (_n % {k}) * (_n div {k} + 1) - 1) div (_n div {k}) + 1
                      END""")
    return ranked.withColumn("fold", fold.cast("int")).drop("_key", "_rank", "_n")


def fold_views(folded: DataFrame, k: int = 5, fold: str = "fold") -> DataFrame:
    """For every fold ``view`` 1..k, each row's role: ``val`` in its own fold, else ``train``.

    A generator (``explode(sequence(1, k))``), not a join. Fits should read filtered
    views instead of materialising all k copies.
    """
    return (folded.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(k))))
            .withColumn("role", F.when(F.col(fold) == F.col("view"), F.lit("val")).otherwise(F.lit("train"))))


def subset_chunks(train_long: DataFrame, steps: int = 5, seed: int = 1, part: str = "category",
                  row_id: str = "row_id") -> DataFrame:
    """Each training row's chunk ``chunk_idx`` (1 to ``steps``, by shuffled rank) and its
    category's ``chunk_rows`` = n div steps. Remainder rows are in no chunk. Subset ``j`` is
    the union of chunks ``1..j``, so the number of subsets does not follow the data (the
    reference's five steps of 500 over 2,500 rows)."""
    keyed = train_long.withColumn("_key", shuffle_key(seed, "subset", F.col(part), F.col(row_id)))
    ranked = exact_rank(keyed, [part], "_key", out="_rank", total="_n")
    return (ranked.withColumn("chunk_rows", F.expr(f"_n div {steps}").cast("int"))
            .where(F.col("_rank") <= F.col("chunk_rows") * steps)
            .withColumn("chunk_idx", F.expr("(_rank + chunk_rows - 1) div chunk_rows").cast("int"))
            .drop("_key", "_rank", "_n"))


def growing_subsets(train_long: DataFrame, steps: int = 5, seed: int = 1, part: str = "category",
                    row_id: str = "row_id") -> DataFrame:
    """Nested training subsets of one to ``steps`` chunks per category: a row of chunk ``i``
    belongs to the subsets ``i..steps``; the remainder rows are in none."""
    chunks = subset_chunks(train_long, steps, seed, part, row_id)
    return (chunks.withColumn("_j", F.explode(F.sequence(F.col("chunk_idx"), F.lit(steps))))
            .withColumn("train_size", (F.col("_j") * F.col("chunk_rows")).cast("int"))
            .drop("_j", "chunk_idx", "chunk_rows"))


def task_mix(train_long: DataFrame, categories, seed: int = 1, part: str = "category",
             row_id: str = "row_id", within: str | None = None) -> DataFrame:
    """Even mixing over categories: each category contributes as many rows as the smallest
    one, interleaved one row per category at a time (``mix_pos``). ``within`` names a column
    (e.g. a fold view) that gets a mix of its own per value."""
    keys = [part] + ([within] if within else [])
    keyed = train_long.withColumn("_key", shuffle_key(seed, "mix", F.col(part), F.col(row_id)))
    ranked = exact_rank(keyed, keys, "_key", out="mix_rank")
    sizes = train_long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # one row per category (and view)
    smallest = sizes.groupBy(*keys[1:]).agg(F.min("_n").alias("_min"))
    ordinal = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(part))
    joined = ranked.join(smallest, within) if within else ranked.join(F.broadcast(smallest))  # one row
    return (joined.where(F.col("mix_rank") <= F.col("_min"))
            .withColumn("mix_pos", (F.col("mix_rank") - 1) * len(categories) + ordinal)
            .drop("_key", "_min"))


def check_partition(rows: DataFrame, split_df: DataFrame, part: str = "category",
                    row_id: str = "row_id") -> DataFrame:
    """Per ``part``: rows, train, test, rows in both (``intersect``) and rows in neither
    (``exceptAll`` of the input against the split rows). A valid split has 0 and 0."""
    keys = [part, row_id]
    train = split_df.where(F.col("split") == TRAIN).select(*keys)
    test = split_df.where(F.col("split") == TEST).select(*keys)
    both = train.intersect(test).groupBy(part).agg(F.count(F.lit(1)).alias("n_both"))
    missing = (rows.select(*keys).exceptAll(train.unionByName(test))
               .groupBy(part).agg(F.count(F.lit(1)).alias("n_missing")))
    sizes = split_df.groupBy(part).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("split") == TRAIN, 1).otherwise(0)).cast("long").alias("n_train"),
        F.sum(F.when(F.col("split") == TEST, 1).otherwise(0)).cast("long").alias("n_test"))
    return (sizes.join(both, part, "left").join(missing, part, "left")
            .na.fill(0, ["n_both", "n_missing"]))
