"""Deterministic shuffle keys, exact ranks without one giant task, tables staged on shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def shuffle_key(seed: int, *parts) -> Column:
    """``md5('seed|part|…')``: a uniform order that does not depend on partitioning.

    ``rand(seed)`` would change with the number and order of input partitions; this key
    is a pure function of the row and gives the same order in SQL engines.
    """
    cols = [F.lit(p) if not isinstance(p, Column) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def exact_rank(df: DataFrame, part_cols, key_col: str, lead_cols=(), out: str = "rank",
               total: str | None = None, n_hex: int = 3) -> DataFrame:
    """``row_number() over (partition by part order by lead…, key)``, computed in parallel.

    A plain window puts each partition (e.g. one category/label stratum holding a third of
    all rows) into one task. Here rows are bucketed by the first ``n_hex`` hex digits of
    the md5 key (bucket order agrees with key order): bucket sizes are counted with a
    map-side-combined aggregate, turned into running offsets on the small bucket table,
    and each row's rank is its offset plus its ``row_number`` inside its bucket. Up to
    ``16**n_hex`` tasks share every stratum; the result equals the plain window exactly.

    Nulls in the partition columns are a partition of their own (null-safe join). The
    offsets meet the rows on the keys that the window needs anyway, so the join adds no
    shuffle of the rows. ``total`` names an optional column with the partition size.
    """
    part_cols, lead_cols = list(part_cols), list(lead_cols)
    bucket = "_rank_bucket"
    grp = part_cols + lead_cols + [bucket]
    keyed = df.withColumn(bucket, F.substring(F.col(key_col), 1, n_hex))
    counts = keyed.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*part_cols).orderBy(*lead_cols, bucket)
              .rowsBetween(Window.unboundedPreceding, -1))
    cols = [*grp, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total:
        cols.append(F.sum("_n").over(Window.partitionBy(*part_cols)).alias(total))
    offsets = counts.select(*cols)
    inside = Window.partitionBy(*grp).orderBy(key_col)
    there = offsets.select(*[F.col(c).alias(f"_o_{i}") for i, c in enumerate(grp)],
                           *[c for c in offsets.columns if c not in grp])
    match = [F.col(c).eqNullSafe(F.col(f"_o_{i}")) for i, c in enumerate(grp)]
    return (keyed.join(there, match)
            .withColumn(out, F.col("_off") + F.row_number().over(inside))
            .drop(bucket, "_off", *[f"_o_{i}" for i in range(len(grp))]))


def global_index(df: DataFrame, order_cols, out: str = "idx", n_parts: int | None = None) -> DataFrame:
    """Dense 1-based position of every row in a total order, without a one-task window.

    Range-partition and sort, pin the result as a table in the shared folder (survives
    executor loss), then position = offset of the partition (small table of partition
    sizes) + position inside it.
    """
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pinned = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    pinned = materialize(pinned.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    sizes = pinned.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (pinned.join(F.broadcast(offsets), "_pid")  # one row per partition
            .withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
            .drop("_pid", "_mid", "_off", "_first"))


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared checkpoint folder and reads it back: cuts the
    lineage of a table that several later jobs reuse (e.g. a split assignment), so it is
    computed once and a lost executor does not force recomputing it."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
