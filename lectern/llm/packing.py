"""Packing of documents into fixed-length sequences, shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import prefix_offsets, prepare, staged, tidied
from .encode import encoder, tokenizer_path

MAX_TOKENS = 2048
END_ID = 1


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts, from piece lengths and their counts.

    Lengths are placed longest first. A length goes to the pattern with the fewest tokens so
    far in which it fits (a new pattern if none), and takes as many of that pattern's copies
    as it has pieces; the copies it does not need keep the pattern without it.
    """
    open_by_space: dict[int, list] = defaultdict(list)  # space left -> [pattern, copies]
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern, copies, space):
        (open_by_space[space].append((pattern, copies)) if space else done.append((pattern, copies)))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for space in range(size - 1, length - 1, -1):  # most space left first
            # patterns that took this length are met again further down, at their new space
            while left and open_by_space.get(space):
                pattern, copies = open_by_space[space].pop()
                used = min(left, copies)
                if copies > used:
                    open_by_space[space].append((pattern, copies - used))
                put(pattern + (length,), used, space - length)
                left -= used
            if not left:
                break
        # nothing open has room: new patterns of this length alone, filled up with itself
        fit = size // length
        whole, rest = divmod(left, fit)
        if whole:
            put((length,) * fit, whole, size - fit * length)
        if rest:
            put((length,) * rest, 1, size - rest * length)
    for space, patterns in open_by_space.items():
        done.extend(patterns)
    return done


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, rank_from, rank_to, sequence_from, offset)``: the pieces of a length with
    ranks in the half-open interval go to consecutive sequences, at one offset."""
    rank, out, sequence = defaultdict(int), [], 0
    for pattern, copies in patterns:
        at = 0
        for length in pattern:
            out.append((length, rank[length], rank[length] + copies, sequence, at))
            rank[length] += copies
            at += length
        sequence += copies
    return out


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, pid int, tie long"


def cut_documents(docs: DataFrame, size: int = MAX_TOKENS, end_id: int = END_ID, tokenizer: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of every whole text (with ``end_id`` at its end): full
    pieces and a last, shorter one. ``with_ids`` adds the ids themselves, little-endian.

    Defined cases: null and empty texts are the end id alone; null ids, repeated rows and rows that
    share an id are documents of their own; very long texts are read whole; an empty table gives
    no rows; other columns are not read."""
    prepare(docs.sparkSession)
    source = tokenizer or tokenizer_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, pid, tie = encoder(source), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in names}
            for key, ids in zip(batch.column("doc_id").to_pylist(), enc.each(batch.column("text"))):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[4 * at:4 * (at + size)]
                    values = (key, at, len(piece) // 4, zlib.crc32(piece), n, pid, tie, piece)
                    for name, v in zip(names, values):
                        rows[name].append(v)
                    tie += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[n]) for n in names], names)

    names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids
    import pyarrow as pa

    kinds = {n: pa.int64() for n in names} | {"length": pa.int32(), "pid": pa.int32(), "ids": pa.binary()}
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(tidied(run, keep="encode"), PIECE + ", ids binary" * with_ids))


def pack_documents(docs: DataFrame, size: int = MAX_TOKENS, end_id: int = END_ID, tokenizer: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length`` (and ``ids`` on request). Sequences are numbered gapless from 0, a
    sequence's pieces lie gapless from offset 0, and each id lies in exactly one piece.
    ``padded_length`` is what the sequence takes when padded: ``size``, or its own length where
    that is a power of two.

    Only the histogram (at most ``size`` lengths) reaches the driver, where patterns are made.
    A piece finds its place by its rank among the pieces of its length: counts per map
    partition and length give offsets by prefix sums, and a rank within (partition, length)
    adds to them, so a length that a third of all pieces share is still spread over all
    partitions. Pieces meet their pattern by a join with the interval table (length, rank
    range), whose size follows the number of patterns (some thousands), not of pieces.

    Defined cases: null and empty texts are one piece, the end id alone; rows that share an id
    are documents of their own; a very long text gives full pieces; an empty table gives no
    rows; null ids are kept; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = staged(cut_documents(docs, size, end_id, tokenizer, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = intervals(shortest_pack_first(histogram, size))
    schema = T.StructType([T.StructField("length", T.IntegerType())] +
                          [T.StructField(c, T.LongType()) for c in ("rank_from", "rank_to", "seq_from", "offset")])
    table = spark.createDataFrame(places, schema)
    fill = (table.groupBy("seq_from").agg(F.sum("length").alias("filled"))
            .select("seq_from", F.when(F.expr("filled & (filled - 1)") == 0, F.col("filled"))
                    .otherwise(F.lit(size)).cast("int").alias("padded_length")))
    table = table.join(F.broadcast(fill), "seq_from")

    counts = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))  # partitions x lengths
    before = prefix_offsets(counts, "pid", ["n"], within="length").select("pid", "length", "n_before")
    inside = Window.partitionBy("pid", "length").orderBy("tie")
    ranked = (pieces.withColumn("rank_in", F.row_number().over(inside) - 1)
              .join(before, ["pid", "length"])
              .withColumn("rank", F.col("n_before") + F.col("rank_in")))
    return (ranked.alias("p").join(F.broadcast(table).alias("t"),
                                   (F.col("p.length") == F.col("t.length")) & (F.col("rank") >= F.col("rank_from"))
                                   & (F.col("rank") < F.col("rank_to")))
            .select("doc_id", "start", F.col("p.length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                    (F.col("seq_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
                    "offset", "padded_length", *["ids"] * with_ids))
