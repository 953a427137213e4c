"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from . import (bitplane, bpe, chain_dedup, chunk_dedup, cross_align, multi_index, order_minhash, packing, shards,
               suffix_dedup, superminhash, toxicity, turn_repair)
from .common import scan_table, staged
from .registry import ORACLE, REGISTRY, register

N_SHARDS = 40


@register("op1_bitplane_ids")
def op1(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/llm-token-blocks-{uuid.uuid4().hex}"
    bitplane.write_token_blocks(scan_table(spark, sf_dir, "documents"), path)
    return bitplane.read_documents(spark, path)


@register("op2_collinear_chains")
def op2(spark, sf_dir):
    return chain_dedup.passages(scan_table(spark, sf_dir, "documents")).drop("k")


@register("op3_multi_index_links")
def op3(spark, sf_dir):
    return multi_index.link_vectors(scan_table(spark, sf_dir, "embeddings"))


@register("op4_byte_shards")
def op4(spark, sf_dir):
    placed = shards.shard_by_bytes(scan_table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op5_chunk_recipes", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
""")
def op5(spark, sf_dir):
    return chunk_dedup.exact_groups(scan_table(spark, sf_dir, "documents"))


@register("op6_bpe_merge_queue")
def op6(spark, sf_dir):
    return bpe.encode_documents(scan_table(spark, sf_dir, "documents"), digests=True)


@register("op7_superminhash")
def op7(spark, sf_dir):
    return superminhash.near_groups(scan_table(spark, sf_dir, "documents"))


@register("op8_suffix_repeats")
def op8(spark, sf_dir):
    return suffix_dedup.remove_repeats(scan_table(spark, sf_dir, "documents"))


@register("op9_shortest_pack_first")
def op9(spark, sf_dir):
    return packing.pack_documents(scan_table(spark, sf_dir, "documents"))


@register("op10_toxicity_gru")
def op10(spark, sf_dir):
    docs = scan_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, scan_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"),
        F.col("toxicity_flag").alias("predicted"))


@register("op11_cross_align")
def op11(spark, sf_dir):
    aligned, _ = cross_align.align_tokenizers(scan_table(spark, sf_dir, "documents"), digests=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


@register("op12_order_minhash")
def op12(spark, sf_dir):
    return order_minhash.against_next(scan_table(spark, sf_dir, "documents"))


@register("op13_turn_repair")
def op13(spark, sf_dir):
    table = scan_table(spark, sf_dir, "conversations")
    rows = turn_repair.damaged(table)
    found = staged(turn_repair.diagnose(rows), "diagnoses")
    hashes = turn_repair.digests(turn_repair.repair(rows, found))
    every = table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").drop(found["conv_id"])
            .join(hashes, every["conv_id"].eqNullSafe(hashes["conv_id"]), "left").drop(hashes["conv_id"])
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")))


def queries():
    return dict(REGISTRY)


def oracle_sql():
    return dict(ORACLE)
