"""Contiguous shards of near-equal bytes, by global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, prefix_offsets, staged


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: rows in ascending id order, cut into
    ``n_shards`` contiguous shards of near-equal bytes.

    A row's size is its text's UTF-8 bytes plus ``overhead``. A row goes to the shard that
    holds the middle of its byte range, so a shard misses its equal target by at most half a
    row at either end. ``slot`` numbers a shard's rows gapless from 0.

    Plan: the text is reduced to size and checksum in the scan; the thin rows are
    range-partitioned by id and pinned; one total per partition gives each partition's
    offset; running sums inside a partition do the rest. No task sees more than one
    partition's rows, and only the totals (one row per partition) meet in one place.

    Defined cases: null text counts as empty (size ``overhead``, checksum 0); null ids sort
    first; rows that share an id follow by size, checksum and scan position, so repeated rows
    each get a slot of their own; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                              (F.octet_length(text).cast("long") + overhead).alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"),
                              F.monotonically_increasing_id().alias("tie")), "sizes")
    order = ["doc_id", "size", "text_crc32", "tie"]
    ranged = staged(thin.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = prefix_offsets(totals, "pid", ["bytes", "rows"])
    whole = totals.agg(F.sum("bytes").alias("whole"))
    upto = Window.partitionBy("pid").orderBy(*order)
    placed = (ranged
              .withColumn("byte_to", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("row_in", F.row_number().over(upto) - 1)
              .join(F.broadcast(before.select("pid", "bytes_before", "rows_before")), "pid")
              .join(F.broadcast(whole))
              .select("doc_id", "size", "text_crc32",
                      (F.col("rows_before") + F.col("row_in")).alias("at"),
                      # twice the middle of the row's byte range, in whole numbers
                      F.least(F.lit(n_shards - 1),
                              F.expr(f"((bytes_before + byte_to) * 2 - size) * {n_shards} div (2 * whole)")
                              ).cast("int").alias("shard")))
    placed = staged(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows at most
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")))


def write_shards(docs: DataFrame, placement: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of ``docs`` as Parquet folders ``shard=<n>``, each sorted by slot. ``id_col``
    must be unique. A shard may be written by several tasks (range of slots each).

    Defined cases: null texts are written as null; a row whose id is null or not placed is not
    written; texts of any length are written whole; an empty table writes no folder; all columns
    are kept, and where one is called ``shard`` or ``slot`` the folder's name differs."""
    key, slot, shard = free_names(docs.columns, "placed_id", "slot", "shard")
    moved = docs.join(placement.select(F.col("doc_id").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot)),
                      F.col(id_col) == F.col(key)).drop(key)
    (moved.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path))
