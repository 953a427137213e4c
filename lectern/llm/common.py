"""Helpers shared by the operators: staged tables, prefix offsets, id filters, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir, ship_package

# Rows of an id table that may be broadcast: 300k longs are some 20 MB as a hash table. Larger ones are shuffled.
BROADCAST_IDS = 300_000


# Rows of an Arrow batch between Spark and Python: whole texts may be long, and a batch is held on
# either side.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """What operators with Python steps need: the package on the executors, small batches."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared checkpoint folder and read back.

    This cuts the lineage: a lost executor costs the tasks it ran, never a recomputation of
    what came before, and a value such as ``spark_partition_id()`` stays as written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prefix_offsets(totals: DataFrame, order: str, sums: list[str], within: str | None = None) -> DataFrame:
    """``totals`` (one row per partition of the data) with ``<sum>_before`` = sum over the
    rows before it in ``order``. The table has one row per partition (and ``within`` value),
    so its size follows the number of partitions, not of rows."""
    w = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
    w = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *[F.coalesce(F.sum(s).over(w), F.lit(0)).cast("long").alias(f"{s}_before")
                                for s in sums])


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def without_ids(df: DataFrame, drop: DataFrame, on: list[str]) -> DataFrame:
    """``df`` without the rows whose ``on`` columns are in ``drop``. ``drop`` is broadcast only
    after its rows have been counted; beyond the bound it is a shuffled anti join."""
    n = drop.count()
    if n == 0:
        return df
    return df.join(F.broadcast(drop) if n <= BROADCAST_IDS else drop, on, "left_anti")


def sized(df: DataFrame, lists: str | None = None, most: int = BROADCAST_IDS) -> DataFrame:
    """A staged thin table with a broadcast hint if its rows, and the elements of its list column
    ``lists``, together are counted within the bound."""
    n = df.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.count(F.lit(1))).first()[0]
    return F.broadcast(df) if n <= most else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(node, component)`` with
    ``component`` = the smallest node reachable. Nodes without edges are not returned.

    Union-find on a distributed edge list: each partition first replaces its edges with its
    own union-find forest (node -> root), then large-star and small-star rounds hang every
    node under the smallest neighbour until nothing changes. Each round is staged in the
    shared folder; per round a node's edges are reduced by a map-side combined ``min``, and
    the join back to a hot node is a plain equi-join that AQE can split.
    """
    prepare(edges.sparkSession)
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    e = staged(e.mapInPandas(tidied(_local_forest), "u long, v long").distinct(), "edges")
    last = _signature(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # large star: every larger neighbour of u hangs under u's smallest neighbour
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its smaller neighbours hang under the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = staged(small, "star")
        e, before, last = nxt, last, _signature(nxt)
        if last == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    own = e.select("v").distinct()
    return (roots.withColumnRenamed("u", "node")
            .unionByName(own.join(roots, own["v"] == roots["u"], "left_anti")
                         .select(F.col("v").alias("node"), F.col("v").alias("component"))))


def _signature(e: DataFrame):
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def find(parent: dict, x):
    """Root of ``x`` in a union-find dictionary, with path halving."""
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def union(parent: dict, a, b) -> None:
    parent.setdefault(a, a)
    parent.setdefault(b, b)
    ra, rb = find(parent, a), find(parent, b)
    if ra != rb:
        parent[max(ra, rb)] = min(ra, rb)


def _local_forest(batches):
    """Union-find over one partition's edges, batch by batch (memory: the batch's nodes)."""
    import pandas as pd

    for pdf in batches:
        parent: dict = {}
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            union(parent, u, v)
        out = [(x, find(parent, x)) for x in parent]
        out = [(x, r) for x, r in out if x != r]
        yield pd.DataFrame({"u": [x for x, _ in out], "v": [r for _, r in out]}, dtype="int64")


def tidied(fn, keep: str | None = None):
    """``fn`` (batches -> batches) for a worker that other stages have used before: tables that
    operators keep from task to task are dropped first, but for those of ``keep``, and freed
    memory goes back to the system at either end, so that a job of many stages needs no more
    memory than its largest stage."""
    def run(batches):
        _free(keep)
        yield from fn(batches)
        _free(keep)
    return run


def _free(keep: str | None) -> None:
    import gc
    import sys

    for name, tables in (("encode", "_ENCODERS"), ("bpe", "_TABLES"), ("cross_align", "_PAIRS")):
        module = sys.modules.get(f"{__package__}.{name}")
        if name != keep and module is not None and getattr(module, tables):
            getattr(module, tables).clear()
            gc.collect()
    freed()


def freed() -> None:
    """Freed memory of this process goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can
        pass


def scan_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table through Spark's reader (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
