"""Token ids in one global document order, stored as compressed byte planes of fixed-size blocks.

File format: a Parquet folder written by Spark, one row per block of ``BLOCK`` ids.

====================  ======================================================================
part, first           partition of the document order, place of the block's first id in it
n_ids                 ids in the block (BLOCK, fewer in a part's last block)
planes                plane p holds byte p of every id of the block, compressed by zstandard;
                      as many planes as the block's largest id needs
plane_bytes           compressed size of each plane (the chunk index: with ``part`` and
                      ``first`` it finds an id without reading other blocks)
head_doc, head_at,    the document that runs into the block from the one before it: its id,
head_n                place of its first id in the part (negative offsets never occur), ids
doc_ids, doc_at,      the documents that begin in the block, in order
doc_n
====================  ======================================================================
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_offsets, prepare, staged, tidied
from .encode import encoder, tokenizer_path

BLOCK = 65_536
KEPT_WORDS = 900_000  # words whose ids a worker keeps in each of two tables, about 180 MB
END_ID = 2
BLOCK_SCHEMA = ("part int, first long, n_ids int, planes array<binary>, plane_bytes array<int>, "
                "head_doc long, head_at long, head_n long, "
                "doc_ids array<long>, doc_at array<long>, doc_n array<long>")
PIECE_SCHEMA = "part int, at long, doc_id long, n_tokens long, piece_at long, piece_n long, crc long"


def to_planes(ids) -> list[bytes]:
    """Byte planes of a block of unsigned 32-bit ids, low byte first, each compressed. Planes
    above the largest id's bytes are all zero and are left out."""
    import numpy as np
    import zstandard

    shuffled = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    top = int(ids.max()) if len(ids) else 0
    n = max(1, (top.bit_length() + 7) // 8)
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in shuffled[:n]]


def from_planes(planes: list[bytes], n_ids: int):
    """The block's ids again."""
    import numpy as np
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    out = np.zeros((n_ids, 4), dtype=np.uint8)
    for p, data in enumerate(planes):
        out[:, p] = np.frombuffer(unpack.decompress(data, max_output_size=n_ids), dtype=np.uint8)
    return out.reshape(-1).view("<u4")


def crc32_join(a: int, b: int, n_bytes: int) -> int:
    """crc32 of two byte strings one after the other, from their own crc32 and the second's
    length. Appending n zero bytes is a linear map over GF(2); its power is taken by squaring."""
    power = 0
    while n_bytes >> power:
        if n_bytes >> power & 1:
            a = _times(_zeros(power), a)
        power += 1
    return a ^ b


def _times(matrix, v: int) -> int:
    r, i = 0, 0
    while v:
        if v & 1:
            r ^= matrix[i]
        v >>= 1
        i += 1
    return r


@lru_cache(maxsize=None)
def _zeros(power: int) -> tuple[int, ...]:
    """The map of appending 2 ** power zero bytes (at most 64 of these are asked for)."""
    if power:
        half = _zeros(power - 1)
        return tuple(_times(half, c) for c in half)
    step = (0xEDB88320, *(1 << i for i in range(31)))  # one zero bit
    for _ in range(3):
        step = tuple(_times(step, c) for c in step)
    return step


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                       id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes the blocks to ``path``.

    Documents are range-partitioned by id, so the parts in order are the documents in order; a
    task sorts and encodes one part and holds one block of ids and one batch of texts. Texts
    move once. Each part is self-contained, so a lost task is written again by itself.

    Defined cases: null text is empty and stores the end id alone; null ids come first; rows
    that share an id follow by text hash, each stored; a very long text runs over as many
    blocks as it needs; an empty table writes no block; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = tokenizer or tokenizer_path()

    def blocks(batches):
        return _blocks(batches, source, end_id)

    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(tidied(blocks, keep="encode"), BLOCK_SCHEMA)
     .write.option("compression", "none").parquet(path))


def _blocks(batches, source: str, end_id: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, enc = TaskContext.get().partitionId(), encoder(source, KEPT_WORDS)
    end = np.array([end_id], dtype="<u4").tobytes()
    pending, at, first, head, docs = bytearray(), 0, 0, None, []

    def block(data: bytes):
        nonlocal first, head, docs
        ids = np.frombuffer(data, dtype="<u4")
        planes = to_planes(ids)
        row = {"part": part, "first": first, "n_ids": len(ids), "planes": planes,
               "plane_bytes": [len(p) for p in planes], "head_doc": head and head[0],
               "head_at": head and head[1], "head_n": head and head[2], "doc_ids": [d[0] for d in docs],
               "doc_at": [d[1] for d in docs], "doc_n": [d[2] for d in docs]}
        first += len(ids)
        last = docs[-1] if docs else head
        head = last if last and last[1] + last[2] > first else None
        docs = []
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
                        ("planes", pa.list_(pa.binary())), ("plane_bytes", pa.list_(pa.int32())),
                        ("head_doc", pa.int64()), ("head_at", pa.int64()), ("head_n", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int64())),
                        ("doc_n", pa.list_(pa.int64()))])
    for batch in batches:
        for key, ids in zip(batch.column("doc_id").to_pylist(), enc.each(batch.column("text"))):
            ids += end
            n, used = len(ids) // 4, 0
            docs.append((key, at, n))
            at += n
            while len(pending) + len(ids) - used >= BLOCK * 4:
                take = BLOCK * 4 - len(pending)
                yield block(bytes(pending) + ids[used:used + take])
                used += take
                pending.clear()
            pending += ids[used:]
    if pending:
        yield block(bytes(pending))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document, read from the blocks.

    ``start`` counts the ids of all documents before it: a part's offset (prefix sums over one
    total per part) and the place within the part. Blocks are read alone, in any order; a
    document over several blocks is put together from its pieces' checksums.

    Defined cases: documents of null or empty texts hold the end id alone; null ids come first;
    rows that share an id, repeats included, are documents of their own; files of an empty table
    give no rows.
    """
    prepare(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    pieces = staged(blocks.mapInArrow(tidied(_pieces), PIECE_SCHEMA), "pieces")
    whole = (pieces.where("piece_n = n_tokens")  # nearly all documents lie in one block
             .select("part", "at", "doc_id", "n_tokens", F.col("crc").alias("ids_crc32")))
    joined = F.udf(_join_pieces, "long")
    cut = (pieces.where("piece_n < n_tokens").groupBy("part", "at", "doc_id", "n_tokens")  # one row per block
           .agg(F.array_sort(F.collect_list(F.struct("piece_at", "piece_n", "crc"))).alias("pieces"))
           .select("part", "at", "doc_id", "n_tokens", joined("pieces").alias("ids_crc32")))
    docs = whole.unionByName(cut)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").cast("long").alias("ids"))
    before = prefix_offsets(totals, "part", ["ids"])
    return (docs.join(F.broadcast(before.select("part", "ids_before")), "part")  # one row per part
            .select("doc_id", (F.col("ids_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def _join_pieces(pieces):
    crc = None
    for p in pieces:
        crc = p["crc"] if crc is None else crc32_join(crc, p["crc"], 4 * p["piece_n"])
    return crc


def _pieces(batches):
    import pyarrow as pa

    schema = pa.schema([("part", pa.int32())] + [(c, pa.int64()) for c in
                       ("at", "doc_id", "n_tokens", "piece_at", "piece_n", "crc")])
    for batch in batches:
        for row in batch.to_pylist():
            ids = from_planes(row["planes"], row["n_ids"])
            starts = list(zip(row["doc_ids"], row["doc_at"], row["doc_n"]))
            if row["head_at"] is not None:
                starts.insert(0, (row["head_doc"], row["head_at"], row["head_n"]))
            out = []
            for doc, at, n in starts:
                a, b = max(at, row["first"]), min(at + n, row["first"] + row["n_ids"])
                data = ids[a - row["first"]:b - row["first"]].tobytes()
                out.append({"part": row["part"], "at": at, "doc_id": doc, "n_tokens": n,
                            "piece_at": a - at, "piece_n": b - a, "crc": zlib.crc32(data)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_ids(blocks_row) -> list[int]:
    """The ids of one block row (a collected ``Row`` or a dict)."""
    return from_planes(list(blocks_row["planes"]), blocks_row["n_ids"]).tolist()
